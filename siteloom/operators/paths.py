"""The way from a site's start to each of its pages, by doubling: each round joins every way to the one that its page hangs on.

A forest of any depth takes as many rounds as its depth has binary digits. A page that a great part of all pages hangs on is
met by broadcast (``with_facts``), so no task holds all its children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import with_facts, written

#: Rounds at most: a way has fewer pages than two to this power, or the parents go round in a circle.
ROUNDS = 40


def ways(parents: DataFrame) -> DataFrame:
    """(site, url, depth, way): way lists the pages from the start to the page; ``parents`` (site, url, parent), null for a start.

    A page has one row. Pages whose parents are no pages, or go round in a circle, have no way and no row.
    """
    key = lambda name: F.xxhash64("site", name)  # noqa: E731  names a page in the joins; the addresses themselves are compared too
    now = parents.select("site", "url", key("url").alias("k"), F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), key("parent")).alias("up_k"), F.array("url").alias("way"))
    now = written(now, "ways-0")
    for i in range(ROUNDS):
        done, open_ = now.where("up is null"), now.where("up is not null")
        if open_.isEmpty():
            break
        above = now.select(F.col("k").alias("up_k"), F.col("url").alias("up"), F.col("up").alias("up2"), F.col("up_k").alias("up_k2"), F.col("way").alias("way2"), F.col("site").alias("site2"))
        met = with_facts(open_, above, ["up_k", "up"]).where(F.col("site") == F.col("site2"))
        step = met.select("site", "url", "k", F.col("up2").alias("up"), F.col("up_k2").alias("up_k"), F.concat("way2", "way").alias("way"))
        # A way that comes back to one of its own pages goes round in a circle: it has no start.
        step = step.where(F.col("up").isNull() | ~F.array_contains("way", F.col("up")))
        now = written(done.unionByName(step), f"ways-{i + 1}")
    return now.where("up is null").select("site", "url", (F.size("way") - 1).alias("depth"), "way")
