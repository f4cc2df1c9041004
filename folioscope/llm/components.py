"""Connected components of an edge table, by alternating large-star and small-star
rewiring. Only group minima and joins are used, so a hub's rows are never gathered in
one task; every round is cut by a written table, of which the last two are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, distinct."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(a, b) links -> (node, root): root is the smallest node of the component.

    Nodes without a link are absent. Nulls and self links are ignored; an empty table
    gives an empty table.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.put(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        after = scratch.put(_star(_star(now, True), False))
        scratch.drop(now)
        now = after
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(row)
    raise RuntimeError("components did not settle")
