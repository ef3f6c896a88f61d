"""Connected components (R7): alternating large and small stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (u, v) that is not the smallest of its component; the caller may discard it."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = mark(now)
    while last[0]:
        before, now = now, materialize(_small(_large(now)), "stars")
        discard(before)
        this = mark(now)
        if this == last:
            break
        last = this
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._table_path = now._table_path
    return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every row of ``nodes`` (node); a component is named by its smallest node."""
    return nodes.select("node").join(component_roots(edges), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
