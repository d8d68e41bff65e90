"""Recorded fetches as files of JSON lines, read at once or as a stream: a file is read once, whenever the stream is stopped.

Spark plans the files and keeps what it has read in the stream's checkpoint, in any store; nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fetch import BODY_LIMIT, FETCH_SCHEMA, REDIRECT_LIMIT

#: What a recording holds; its status is a code or a word.
RECORDED = "url string, identity string, status string, final_url string, redirects int, headers map<string,string>, content string"


def typed(rows: DataFrame) -> DataFrame:
    """Recordings in the columns of a fetch: codes and words apart, redirects and bodies bounded, as a live reader has them."""
    hops = F.coalesce("redirects", F.lit(0))
    code = F.expr("try_cast(status as int)")
    return rows.where("url is not null").select(
        "url",
        F.coalesce("identity", F.lit("browser")).alias("identity"),
        F.when(hops <= REDIRECT_LIMIT, code).alias("status"),
        F.when(hops > REDIRECT_LIMIT, "too_many_redirects").when(code.isNull(), F.col("status")).alias("state"),
        F.coalesce("final_url", "url").alias("final_url"),
        hops.alias("redirects"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        F.substring(F.coalesce("content", F.lit("")), 1, BODY_LIMIT).alias("content"),
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    return typed(spark.read.schema(RECORDED).json(folder))


def stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """New files of a folder, so many in a batch at most."""
    return typed(spark.readStream.schema(RECORDED).option("maxFilesPerTrigger", files_at_once).json(folder))


def into_table(spark: SparkSession, folder: str, out: str, marks: str, files_at_once: int = 1000) -> None:
    """Append what is new in a folder to a table; ``marks`` remembers what was read, so that no recording comes twice."""
    query = stream(spark, folder, files_at_once).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()


__all__ = ["FETCH_SCHEMA", "RECORDED", "into_table", "read", "stream", "typed"]
