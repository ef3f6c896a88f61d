"""Chromosomal neighborhood: windows over genes in contig order, and the gene-adjacency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along(genes_order: tuple[str, ...] = ("start", "end", "gene_id")) -> WindowSpec:
    """Genes of one contig of one organism, in order; ties by id."""
    return Window.partitionBy("org_id", "contig").orderBy(*genes_order)


def neighbors(genes: DataFrame, value: str = "gene_id", stranded: bool = False) -> DataFrame:
    """(gene_id, down, up, reverse): the previous and next ``value``; swapped on the minus strand if ``stranded``."""
    w = along()
    reverse = F.col("strand") == -1
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    if stranded:
        before, after = F.when(reverse, after).otherwise(before), F.when(reverse, before).otherwise(after)
    return genes.select("gene_id", before.alias("down"), after.alias("up"), reverse.alias("reverse"))


def flank_string(value: str, n: int, forward: bool = True) -> Column:
    """Next (or previous) ``n`` values joined by ";"; a missing one is the text NA, but null if n is 1."""
    w, step = along(), F.lead if forward else F.lag
    if n == 1:
        return step(value, 1).over(w).cast("string")
    return F.concat_ws(";", *[F.coalesce(step(value, k).over(w).cast("string"), F.lit("NA")) for k in range(1, n + 1)])


def flanks(genes: DataFrame, n: int, value: str = "group_id") -> DataFrame:
    """(gene_id, flank): up to ``n`` values to either side, nearest first, downs then ups by strand, center excluded."""
    w = along()
    before, after = F.reverse(F.collect_list(value).over(w.rowsBetween(-n, -1))), F.collect_list(value).over(w.rowsBetween(1, n))
    reverse = F.col("strand") == -1
    return genes.withColumn("flank", F.when(reverse, F.concat(after, before)).otherwise(F.concat(before, after)))


def trails(genes: DataFrame, vicinity: int = 4, value: str = "group_id") -> DataFrame:
    """(gene_id, trail): values within ``vicinity`` places, clipped at contig ends, reversed on the minus strand."""
    trail = F.collect_list(value).over(along().rowsBetween(-vicinity, vicinity))
    return genes.select("gene_id", value, F.when(F.col("strand") == -1, F.reverse(trail)).otherwise(trail).alias("trail"))


def trail_edges(trails_: DataFrame) -> DataFrame:
    """(from, to, n): how often one value follows another in the trails."""
    steps = F.transform(F.sequence(F.lit(1), F.size("trail") - 1), lambda i: F.struct(F.element_at("trail", i).alias("from"), F.element_at("trail", i + 1).alias("to")))
    pairs = trails_.filter(F.size("trail") > 1).select(F.explode(steps).alias("s")).select("s.from", "s.to")
    return pairs.groupBy("from", "to").agg(F.count("*").alias("n"))


def neighborhood(genes: DataFrame, group, vicinity: int = 4) -> DataFrame:
    """(from, to, n, from_center, to_center): directed edges of the trails through one group (R2)."""
    edges = trail_edges(trails(genes, vicinity).filter(F.col("group_id") == group))
    return edges.select("from", "to", "n", (F.col("from") == group).alias("from_center"), (F.col("to") == group).alias("to_center"))


def group_neighbors(genes: DataFrame) -> DataFrame:
    """(group_id, neighbor): distinct groups next to a gene of each group, on either side."""
    near = neighbors(genes, "group_id").join(genes.select("gene_id", "group_id"), "gene_id")
    return near.select("group_id", F.explode(F.array("down", "up")).alias("neighbor")).filter("neighbor IS NOT NULL").distinct()


def adjacent(genes: DataFrame) -> DataFrame:
    """(a, b, org_id): groups of every gene and the next one, smaller group first; one row per adjacency."""
    follow = genes.select("org_id", F.col("group_id").alias("g"), F.lead("group_id").over(along()).alias("h")).filter("h IS NOT NULL")
    return follow.select(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), "org_id")


def pc_edges(genes: DataFrame, slim: bool = False) -> DataFrame:
    """Undirected edges of the adjacency graph, self loops kept; with weight and organisms unless ``slim``."""
    pairs = adjacent(genes)
    if slim:
        return pairs.select("a", "b").distinct()
    per_org = pairs.groupBy("a", "b", "org_id").agg(F.count("*").alias("n"))
    return per_org.groupBy("a", "b").agg(F.sum("n").alias("weight"), F.array_join(F.sort_array(F.collect_list("org_id")), ";").alias("organisms"))


def pc_vertices(genes: DataFrame) -> DataFrame:
    """(group_id, organisms, upstream, downstream): distinct values as sorted arrays."""
    near = neighbors(genes, "group_id", stranded=True)
    own = genes.select("gene_id", "group_id", "org_id").join(near, "gene_id")
    sets = [F.sort_array(F.collect_set(c)) for c in ("org_id", "up", "down")]
    return own.groupBy("group_id").agg(*[s.alias(n) for s, n in zip(sets, ("organisms", "upstream", "downstream"), strict=True)])


def degrees(edges: DataFrame) -> DataFrame:
    """(group_id, degree) over undirected (a, b); a self loop adds two."""
    return edges.select(F.explode(F.array("a", "b")).alias("group_id")).groupBy("group_id").agg(F.count("*").alias("degree"))


def org_graphs(genes: DataFrame) -> DataFrame:
    """(org_id, a, b, weight): each organism's own adjacency graph."""
    return adjacent(genes).groupBy("org_id", "a", "b").agg(F.count("*").alias("weight"))


def ego(edges: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """(root, at, hops): what is within ``radius`` steps of each root (group_id) along (a, b), by breadth first search."""
    both = edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).toDF("at", "to").distinct()
    ball = roots.select(F.col("group_id").alias("root"), F.col("group_id").alias("at"), F.lit(0).alias("hops"))
    for k in range(1, radius + 1):
        step = ball.filter(F.col("hops") == k - 1).join(both, "at").select("root", F.col("to").alias("at"), F.lit(k).alias("hops"))
        ball = ball.unionByName(step).groupBy("root", "at").agg(F.min("hops").alias("hops"))
    return ball


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges (a, b, ...) whose ends are both among ``vertices`` (group_id)."""
    own = vertices.select("group_id").distinct()
    return edges.join(own.toDF("a"), "a", "left_semi").join(own.toDF("b"), "b", "left_semi").select(*edges.columns)
