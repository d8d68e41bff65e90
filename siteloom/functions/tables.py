"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session of this machine alone, as in tests, does without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="siteloom-", ignore_cleanup_errors=True))
    return f"file://{_LOCAL[0].name}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/siteloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: lineage ends here, so that plans don't grow and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Of so many rows, one is looked at for keys that come very often.
GLANCE = 32


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to ``facts``, which have a row a key; both are written tables. Any split gives the same rows.

    Keys that hold over 1 / partitions of a sample of the rows - as many as partitions at most - meet their facts by
    broadcast, where they lie; all others shuffle. Null keys meet nothing.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = F.xxhash64(*keys)
    glance = rows.sample(1 / GLANCE, seed=GLANCE).select(h.alias("k"))
    least = max(GLANCE, glance.count() // parts)
    hot = [r["k"] for r in glance.groupBy("k").count().where(F.col("count") > least).collect()]
    if not hot:
        return rows.join(facts, keys)
    often = h.isin(hot)
    return rows.where(often).join(F.broadcast(facts.where(often)), keys).unionByName(rows.where(~often).join(facts.where(~often), keys))
