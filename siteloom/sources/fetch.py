"""Sources: recorded fetches as a Python Data Source, seeds, and permissive signal ingestion.

Live fetching is an ingestion job and needs a network; the data source here reads recordings with the same schema, one
partition per host, so that the spacing a site asks for is a matter of one task. A live reader replaces ``_Reader.read``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The most of a body that is kept, and the most redirects that are followed. Fixed values.
BODY_LIMIT, REDIRECT_LIMIT = 500_000, 10

FETCH_SCHEMA = "url string, identity string, status int, state string, final_url string, redirects int, headers map<string,string>, content string"


class _Host(InputPartition):
    def __init__(self, host: str, rows: list[dict]):
        self.host, self.rows = host, rows


class _Reader(DataSourceReader):
    def __init__(self, recordings: list[dict]):
        self.recordings = recordings

    def partitions(self) -> list[InputPartition]:
        by_host: dict[str, list[dict]] = {}
        for r in self.recordings:
            by_host.setdefault(urlsplit(r["url"]).netloc.lower(), []).append(r)
        return [_Host(h, rows) for h, rows in sorted(by_host.items())]

    def read(self, partition: _Host) -> Iterator[tuple]:
        for r in partition.rows:
            hops = r.get("redirects", 0)
            status, state = r.get("status"), None
            if hops > REDIRECT_LIMIT:
                status, state = None, "too_many_redirects"
            elif not isinstance(status, int):
                status, state = None, status
            yield r["url"], r.get("identity", "browser"), status, state, r.get("final_url", r["url"]), hops, r.get("headers", {}), (r.get("content") or "")[:BODY_LIMIT]


class RecordedFetches(DataSource):
    """``spark.read.format("recorded_fetches").option("recordings", <JSON list>)``: a few recordings, given as text."""

    @classmethod
    def name(cls) -> str:
        return "recorded_fetches"

    def schema(self) -> str:
        return FETCH_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("recordings", "[]")))


def recorded_fetches(spark: SparkSession, recordings: list[dict]) -> DataFrame:
    spark.dataSource.register(RecordedFetches)
    return spark.read.format("recorded_fetches").option("recordings", json.dumps(recordings)).load()


def signals_from_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Signals (site, signal, value) from JSON lines, and the lines that are no signals: nothing is dropped unseen."""
    raw = spark.read.schema("site string, signal string, value string, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    raw = raw.select("site", "signal", "value", "_corrupt_record")
    bad = raw.where("_corrupt_record is not null or site is null or signal is null").select("_corrupt_record", "site", "signal")
    return raw.where("_corrupt_record is null and site is not null and signal is not null").select("site", "signal", "value"), bad


def pdf_files(spark: SparkSession, path: str, limit: int = 10 * 1024 * 1024) -> DataFrame:
    """(path, data, truncated): PDF files from any store that Spark reads, the first bytes of large ones."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", F.substring("content", 1, limit).alias("data"), (F.col("length") > limit).alias("truncated"))
