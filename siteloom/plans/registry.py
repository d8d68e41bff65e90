"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with equivalent DuckDB SQL where there is some."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def values(spark: SparkSession, seed: str) -> DataFrame:
    """A seed table: the same VALUES text that the SQL uses."""
    return spark.sql(f"select * from {seed}")


def literal(value) -> str:
    """A Python value as SQL."""
    if value is None:
        return "null"
    if isinstance(value, (bool, int, float)):
        return str(value).lower()
    return "'" + str(value).replace("'", "''") + "'"


def seed_sql(rows: list[tuple], columns: str) -> str:
    """Rows that a query starts from, for its SQL to start from too."""
    return f"(select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) as seed({columns}))"


def cases_sql(text: str, known: list[tuple[str, str]]) -> str:
    """The labels of the patterns that a text matches, in their order, as a list."""
    return "list_filter([" + ", ".join(f"case when regexp_matches({text}, {literal(rx)}) then {literal(label)} end" for rx, label in known) + "], lambda x: x is not null)"


#: What takes the cases: every page, every host or every address, each with the number that says which case is its own.
_TAKERS = {
    "page": "select page_id as taker, page_id as turn, html as own from pages",
    "host": "select regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') as taker, min(page_id) as turn, null as own from pages group by 1",
    "url": "select url as taker, min(page_id) as turn, null as own from pages group by 1",
}


def dealt(seed: str, key: str, to: str = "page", mixed: str | None = None, keys: list | None = None) -> str:
    """SQL of the cases of ``seed`` dealt out over ``pages``: each page, host or address in turn has the rows of one key, under its own name.

    The markup or text in the column ``mixed`` is followed by the page's own. ``keys`` names all keys where some have no row.
    """
    listed = f"[{', '.join(map(literal, keys))}]" if keys else f"(select list_sort(list(distinct {key})) from {seed})"
    own = f", s.{mixed} || p.own as {mixed}" if mixed else ""
    return f"""(select p.taker as {key}, s.* exclude ({key}{f", {mixed}" if mixed else ""}){own} from (select t.*, {listed} as ks from ({_TAKERS[to]}) t) p join (select * from {seed}) s on s.{key} = p.ks[p.turn % len(p.ks) + 1])"""


def spread(spark: SparkSession, sf_dir: str, seed: str | DataFrame, key: str, to: str = "page", mixed: str | None = None) -> DataFrame:
    """The same as a DataFrame: what it holds grows with ``pages``, and with it the work of what reads it."""
    cases = values(spark, seed) if isinstance(seed, str) else seed
    keys = sorted(r[0] for r in cases.select(key).distinct().collect())  # cases are a constant list
    p = pages(spark, sf_dir)
    if to == "page":
        takers = p.select(F.col("page_id").alias("taker"), F.col("page_id").alias("turn"), *([F.col("html").alias("own")] if mixed else []))
    else:
        takers = p.groupBy((U.host(F.col("url")) if to == "host" else F.col("url")).alias("taker")).agg(F.min("page_id").alias("turn"))
    takers = takers.withColumn("case", F.element_at(F.array(*[F.lit(k) for k in keys]), (F.pmod("turn", F.lit(len(keys))) + 1).cast("int")))
    met = takers.join(F.broadcast(cases), takers["case"] == cases[key])
    return met.select(*[F.col("taker").alias(c) if c == key else F.concat(cases[c], "own").alias(c) if c == mixed else cases[c] for c in cases.columns])
