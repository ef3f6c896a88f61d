"""Variable regions of the adjacency graph (R3-R6): short cycles, fused, and typed by their flanks."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialize
from .components import components
from .neighbors import degrees, pc_edges


def route(fathers: dict, node) -> list:
    """From the root to ``node`` by its fathers."""
    out = [node]
    while fathers.get(out[-1]) is not None:
        out.append(fathers[out[-1]])
    return out[::-1]


def cycles_at(root, near: dict) -> list[tuple]:
    """Cycles through ``root`` within its ball: two tree routes that part at the root and meet by an edge; those sharing two vertices are fused.

    Every edge outside the breadth-first tree closes a cycle, also one between vertices that have children in the tree; a rule that
    starts at the tree's leaves only would miss a triangle with a tail on each vertex.
    """
    father, seen = {root: None}, deque([root])
    while seen:
        v = seen.popleft()
        for w in sorted(near.get(v, ())):
            if w not in father:
                father[w] = v
                seen.append(w)
    found: list[set] = []
    for v in sorted(father):
        for w in sorted(near.get(v, ())):
            if v < w and w in father and father[v] != w and father[w] != v:
                a, b = route(father, v), route(father, w)
                if len(a) > 1 and len(b) > 1 and a[1] == b[1]:
                    continue
                found.append(set(a) | set(b))
    fused: list[set] = []
    for c in found:
        rest = []
        for f in fused:
            if len(f & c) > 1:
                c = c | f  # noqa: PLW2901
            else:
                rest.append(f)
        fused = [*rest, c]
    return [tuple(sorted(c)) for c in fused if len(c) > 2]


def _cycle_scan(rows: pd.DataFrame) -> pd.DataFrame:
    root, near = rows["root"].iloc[0], {}
    for a, b in zip(rows["a"], rows["b"], strict=True):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return pd.DataFrame({"members": [list(c) for c in cycles_at(root, near)]}, columns=["members"])


def locate_cycles(edges: DataFrame, max_length: int = 4) -> DataFrame:
    """(members): distinct cycles near every vertex of degree > 2; balls grow by joins, one grouped function per root."""
    edges = materialize(edges.filter("a <> b").select("a", "b").distinct(), "graph")
    both = edges.union(edges.select("b", "a")).toDF("at", "to")
    ball = degrees(edges).filter("degree > 2").select(F.col("group_id").alias("root"), F.col("group_id").alias("at"))
    for _ in range(max_length):
        ball = materialize(ball.union(ball.join(both, "at").select("root", F.col("to").alias("at"))).distinct(), "ball")
    inside = ball.join(edges.withColumnRenamed("a", "at"), "at").select("root", F.col("at").alias("a"), F.col("b").alias("at")).join(ball, ["root", "at"]).select("root", "a", F.col("at").alias("b"))
    return inside.groupBy("root").applyInPandas(_cycle_scan, "members array<string>").distinct()


def merge_cycles(cycles: DataFrame) -> DataFrame:
    """(members) after cycles that share two or more vertices are united."""
    named = materialize(cycles.select(F.array_join("members", "\u0001").alias("c"), "members"), "cycles")
    flat = named.select("c", F.explode("members").alias("m"))
    shared = flat.join(flat.withColumnRenamed("c", "d"), "m").filter("c < d").groupBy("c", "d").agg(F.count("*").alias("n")).filter("n >= 2")
    label = components(named.select(F.col("c").alias("node")), shared.select(F.col("c").alias("u"), F.col("d").alias("v")))
    return flat.join(label.withColumnRenamed("node", "c"), "c").groupBy("component").agg(F.sort_array(F.collect_set("m")).alias("members")).select("members")


def summarize_cycles(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(members, flank, connects_to, type): members with outside neighbors are the flank; regions without one go."""
    edges = edges.filter("a <> b").select("a", "b").distinct()
    both = edges.union(edges.select("b", "a")).toDF("m", "to")
    region = materialize(cycles.withColumn("region", F.xxhash64(F.array_join("members", "\u0001"))), "regions")
    near = region.select("region", "members", F.explode("members").alias("m")).join(both, "m").withColumn("inside", F.array_contains("members", F.col("to")))
    per = near.groupBy("region", "m").agg(F.sum(F.col("inside").cast("int")).alias("degree"), F.sum((~F.col("inside")).cast("int")).alias("outside"), F.collect_set(F.when(~F.col("inside"), F.col("to"))).alias("out"))
    flank = F.sort_array(F.collect_set(F.when(F.col("outside") > 0, F.col("m"))))
    summary = per.groupBy("region").agg(flank.alias("flank"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("out")))).alias("connects_to"), F.max("degree").alias("degree"))
    joined = summary.filter(F.size("flank") > 0).join(region, "region")
    tied = edges.select(F.array(F.least("a", "b"), F.greatest("a", "b")).alias("flank"), F.lit(True).alias("tied")).distinct()
    kind = F.when(F.size("flank") == 1, "end").when(F.size("flank") > 2, "hub").when(F.coalesce("tied", F.lit(False)), "ins/del").when(F.col("degree") <= 2, "frameshift").otherwise("plastic")
    return joined.join(tied, "flank", "left").select("members", "flank", "connects_to", kind.alias("type"))


def variable_regions(genes: DataFrame, flank_size: int = 4) -> DataFrame:
    """R4, R5 and R6 on the slim adjacency graph."""
    edges = materialize(pc_edges(genes, slim=True), "slim")
    return summarize_cycles(merge_cycles(locate_cycles(edges, flank_size)), edges)
