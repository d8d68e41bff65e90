"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: hang each node's greater neighbours on its least one; small star: its lesser ones and itself.

    The least neighbour is a partial aggregate and comes back by an equi-join that adaptive execution may split,
    so a hub with a third of all edges is never gathered in one task.
    """
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # u: the centre, v: a neighbour
    around = both.select(F.col("a").alias("u"), F.col("b").alias("v")) if large else edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("m", "u").alias("m"))
    met = around.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "cc", most: int = 200) -> DataFrame:
    """(node, label) of every node in ``edges`` (columns a, b): label is the least node of its component.

    Self-links, nulls and repeats are ignored; an empty table gives an empty one. Each round is written to the
    shared folder, so no lineage grows, and the one before is removed; stars are reached in a number of rounds that is
    logarithmic in practice. Should ``most`` rounds not be enough, that is an error: unfinished labels are never returned.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    seen = None
    for i in range(most):
        # A forest of stars is a fixed point: no node is both a centre and a leaf, and no leaf has two centres.
        stats = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if stats == seen or not stats[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        seen = stats
        after = materialize(_star(_star(now, large=True), large=False), f"{name}-{i + 1}")
        discard(now)
        now = after
    raise RuntimeError(f"components: no fixed point after {most} rounds")
