"""Lookup tables as DataFrames: each is a constant list, so a broadcast of it is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.access import VERIFY
from ..operators.robots import AGENTS
from ..plans.page_queries import BANDS


def lookup(spark: SparkSession, name: str) -> DataFrame:
    """crawlers, word_bands or verify_codes."""
    tables = {"crawlers": (AGENTS, "token string, class string, role string, honours boolean"), "word_bands": (BANDS, "intent string, advisory int"), "verify_codes": (list(VERIFY.items()), "code int, kind string")}
    rows, schema = tables[name]
    return F.broadcast(spark.createDataFrame(rows, schema))
