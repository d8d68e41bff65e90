"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Where it is unset, as in tests, a folder of this machine will do for a session that runs on this machine alone; on
    a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="siteloom-", ignore_cleanup_errors=True))
    return f"file://{_LOCAL[0].name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read of a file, not a recomputation of the stages before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siteloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folder of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("siteloom-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Of so many documents, one is looked at for keys that come very often.
GLANCE = 32


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], by: str | None = "doc_id") -> DataFrame:
    """``rows`` with what ``facts``, a row a key, knows of their keys; rows of other keys go. Any split gives the same rows.

    Keys that hold over 1 / partitions of the rows of every 32nd value of ``by`` - as many as partitions at most,
    whatever the size - meet their facts by broadcast and are no task's burden; all others shuffle. ``rows`` are a
    written table. With ``by`` null a sample of single rows is looked at, which sees keys whose rows share one id too.
    """
    glance = (rows.sample(1 / GLANCE, seed=GLANCE) if by is None else rows.where(F.pmod(F.xxhash64(by), F.lit(GLANCE)) == 0)).select(F.xxhash64(*keys).alias("k"))
    bound = max(GLANCE, glance.count() // partitions(rows.sparkSession))
    hot = [r["k"] for r in glance.groupBy("k").count().where(F.col("count") > bound).collect()]
    if not hot:
        return rows.join(facts, keys)
    often = F.xxhash64(*keys).isin(hot)
    return rows.where(often).join(F.broadcast(facts.where(often)), keys).unionByName(rows.where(~often).join(facts.where(~often), keys))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id) -> "F.Column":
    """Rows that no model may learn from: crc32 of the decimal doc_id leaves 2 modulo 4."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2


def labelled_texts(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, text, y): one text for each row of ``picked`` (id, y), whose ids are distinct and few: of texts that share an id, the least by hash."""
    met = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id"))
    return met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """A query over DataFrames named ``{name}`` in its text; other braces stay as they are."""
    views = {}
    for name, df in tables.items():
        views[name] = f"siteloom_{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(views[name])
        text = text.replace("{" + name + "}", views[name])
    try:
        return spark.sql(text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
