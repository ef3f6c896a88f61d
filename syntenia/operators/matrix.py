"""Presence/absence analytics over genes(gene_id, org_id, group_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranks import ranked

#: Organisms in one word of a presence mask.
WORD_BITS = 64


def pan_matrix(genes: DataFrame) -> DataFrame:
    """(group_id, org_id, n): genes of each organism in each group; the sparse matrix in long form."""
    return genes.groupBy("group_id", "org_id").agg(F.count("*").alias("n"))


def pan_pivot(genes: DataFrame, orgs: list, prefix: str = "org_") -> DataFrame:
    """One row per group, one column per organism, 0 where absent."""
    wide = genes.groupBy("group_id").pivot("org_id", orgs).agg(F.count(F.lit(1)))
    return wide.select("group_id", *[F.coalesce(F.col(f"`{o}`"), F.lit(0)).alias(f"{prefix}{o}") for o in orgs])


def class_of(n_org: Column, orgs: Column | int, threshold: float) -> Column:
    """Core if the share of organisms reaches the threshold (tested first), then Singleton, else Accessory."""
    return F.when(n_org / orgs >= threshold, "Core").when(n_org == 1, "Singleton").otherwise("Accessory")


def group_info(genes: DataFrame, n_orgs: int, threshold: float = 1.0) -> DataFrame:
    """(group_id, n_org, n_genes, class); one pass by (group, organism), pre-aggregated."""
    sums = pan_matrix(genes).groupBy("group_id").agg(F.count("*").alias("n_org"), F.sum("n").alias("n_genes"))
    return sums.withColumn("class", class_of(F.col("n_org"), n_orgs, threshold))


def class_percent(info: DataFrame) -> DataFrame:
    """(class, n_groups, percent)."""
    counts = info.groupBy("class").agg(F.count("*").alias("n_groups"))
    return counts.withColumn("percent", F.col("n_groups") * 100.0 / F.sum("n_groups").over(W.partitionBy()))


def with_paralogues(genes: DataFrame) -> DataFrame:
    """(group_id, has_paralogues): some organism has two genes in the group."""
    return pan_matrix(genes).groupBy("group_id").agg((F.max("n") > 1).alias("has_paralogues"))


def paralogue_counts(genes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(org_id, n_gene_groups, n_paralogues) (A6): an organism's groups, and those with more than one of its genes;
    with ``links`` (group_id, paralogue) the linked groups that together have more than one."""
    own = pan_matrix(genes)
    if links is None:
        return own.groupBy("org_id").agg(F.count("*").alias("n_gene_groups"), F.sum((F.col("n") > 1).cast("long")).alias("n_paralogues"))
    linked = own.join(links.select("group_id", "paralogue"), "group_id").groupBy("org_id", "paralogue").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))
    return linked.groupBy("org_id").agg(F.sum("groups").alias("n_gene_groups"), F.sum((F.col("n") > 1).cast("long")).alias("n_paralogues"))


def pan_counts(n: Column, orgs: Column | int, threshold: float) -> list[Column]:
    """Counts of groups present in ``n`` of ``orgs`` organisms; classes may overlap for one organism."""
    return [
        F.sum((n == 1).cast("long")).alias("singleton"),
        F.sum(((n > 1) & (n / orgs < threshold)).cast("long")).alias("accessory"),
        F.sum(((n != 0) & (n / orgs >= threshold)).cast("long")).alias("core"),
        F.sum((n != 0).cast("long")).alias("total"),
    ]


def pan_groups(genes: DataFrame, n_orgs: int, threshold: float = 1.0) -> DataFrame:
    present = genes.select("group_id", "org_id").distinct().groupBy("group_id").agg(F.count("*").alias("n"))
    return present.agg(*pan_counts(F.col("n"), n_orgs, threshold))


def evolution(genes: DataFrame, order: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(k, singleton, accessory, core, total) over the first k organisms of ``order`` (org_id, pos).

    A group's count is a step function of k that rises where its organisms stand, so
    each group gives one row per interval and intervals are joined with the few k's.
    """
    at = genes.select("group_id", "org_id").distinct().join(order, "org_id")
    w = W.partitionBy("group_id").orderBy("pos")
    steps = at.select("group_id", "pos", F.row_number().over(w).alias("n"), F.lead("pos").over(w).alias("until"))
    # many groups share an interval and a count
    steps = steps.groupBy("pos", "until", "n").agg(F.count("*").alias("groups"))
    ks = order.select(F.col("pos").alias("k"))
    c = F.col("groups")
    n, k = F.col("n"), F.col("k")
    return (
        ks.join(steps, (k >= F.col("pos")) & (k < F.coalesce("until", F.lit(2**62))))
        .groupBy("k")
        .agg(*[F.sum(F.when(test, c).otherwise(0)).alias(x) for x, test in (("singleton", n == 1), ("accessory", (n > 1) & (n / k < threshold)), ("core", n / k >= threshold), ("total", n != 0))])
    )


def evolution_bootstrap(genes: DataFrame, n_orgs: int, orgs: DataFrame, threshold: float = 1.0, times: int = 10, seed: int = 1) -> DataFrame:
    """(n, rep, ...): for n = 1..N, ``times`` samples of n organisms with replacement; repeated draws count as columns.

    A group is a mask of its organisms, so a group and a sample cost a few bit counts and groups of the same organisms count once.
    """
    spark = genes.sparkSession
    numbered = orgs.select("org_id", (F.row_number().over(W.orderBy("org_id")) - 1).alias("at"))
    draws = (
        spark.range(1, n_orgs + 1).select(F.col("id").alias("n")).crossJoin(spark.range(1, times + 1).select(F.col("id").alias("rep")))
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("at", (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("n").cast("string"), F.col("rep").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("long") % n_orgs).cast("int"))
    )
    # presence of a group is a bit for each organism, in words; a sample's columns are planes, by the bits of how often it draws an organism
    words = range(-(-n_orgs // WORD_BITS))
    bit = F.expr(f"shiftleft(1L, at % {WORD_BITS})")

    def masks(where: Column, name: str) -> list[Column]:
        word = F.floor(F.col("at") / WORD_BITS)
        return [F.bit_or(F.when((word == w) & where, bit).otherwise(F.lit(0).cast("long"))).alias(f"{name}{w}") for w in words]

    planes = range(n_orgs.bit_length())
    drawn = draws.join(numbered, "at").groupBy("n", "rep", "at").agg(F.count("*").alias("columns"))
    drawn = drawn.groupBy("n", "rep").agg(*[m for p in planes for m in masks(F.shiftright("columns", p).bitwiseAND(F.lit(1)) == 1, f"p{p}_")])
    inside = numbered.filter(F.col("at") < n_orgs)
    groups = genes.select("group_id", "org_id").join(F.broadcast(inside), "org_id").groupBy("group_id").agg(*masks(F.lit(True), "g"))
    groups = groups.groupBy(*[f"g{w}" for w in words]).agg(F.count("*").alias("groups"))
    present = reduce(Column.__add__, [F.bit_count(F.col(f"g{w}").bitwiseAND(F.col(f"p{p}_{w}"))).cast("long") * (1 << p) for p in planes for w in words])
    seen = groups.crossJoin(F.broadcast(drawn)).select("n", "rep", "groups", present.alias("present")).filter("present > 0").withColumn("share", F.col("present") / F.col("n"))
    return seen.groupBy("n", "rep").agg(*[F.sum(F.when(test, F.col("groups")).otherwise(0)).alias(name) for name, test in (("singleton", F.col("present") == 1), ("accessory", (F.col("present") > 1) & (F.col("share") < threshold)), ("core", F.col("share") >= threshold))], F.sum("groups").alias("total"))


def org_similarity(genes: DataFrame, compat: bool = False) -> DataFrame:
    """(org_a, org_b, jaccard) of group sets for a < b; organisms are few, groups many.

    ``compat`` leaves each organism's highest group out of the sets, as an older
    implementation does.
    """
    sets = genes.select("org_id", "group_id").distinct()
    if compat:
        top = sets.groupBy("org_id").agg(F.max("group_id").alias("group_id"))
        sets = sets.join(top, ["org_id", "group_id"], "left_anti")
    size = sets.groupBy("org_id").agg(F.count("*").alias("size"))
    a, b = sets.select(F.col("org_id").alias("org_a"), "group_id"), sets.select(F.col("org_id").alias("org_b"), "group_id")
    both = a.join(b, "group_id").filter("org_a < org_b").groupBy("org_a", "org_b").agg(F.count("*").alias("both"))
    sizes = size.select(F.col("org_id").alias("org_a"), F.col("size").alias("size_a")).crossJoin(size.select(F.col("org_id").alias("org_b"), F.col("size").alias("size_b"))).filter("org_a < org_b")
    shared = F.coalesce("both", F.lit(0))
    return sizes.join(both, ["org_a", "org_b"], "left").select("org_a", "org_b", (shared / (F.col("size_a") + F.col("size_b") - shared)).alias("jaccard"))


def org_distance(genes: DataFrame, method: str = "euclidean", p: float = 2.0) -> DataFrame:
    """(org_a, org_b, distance) for a < b over count vectors.

    Absent pairs need no rows: a group's part where only one organism has it follows from
    that organism's own sums less what the pair shares.
    """
    m = pan_matrix(genes)
    a, b = m.select(F.col("org_id").alias("org_a"), "group_id", F.col("n").alias("x")), m.select(F.col("org_id").alias("org_b"), "group_id", F.col("n").alias("y"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    pairs = a.join(b, "group_id").filter("org_a < org_b")
    if method == "maximum":
        # the greatest difference may be at a group that one of them lacks: full vectors by pair
        orgs = m.select("org_id").distinct()
        full = orgs.select(F.col("org_id").alias("org_a")).crossJoin(orgs.select(F.col("org_id").alias("org_b"))).filter("org_a < org_b")
        left = full.join(a, "org_a").select("org_a", "org_b", "group_id", "x", F.lit(0).alias("y"))
        right = full.join(b, "org_b").select("org_a", "org_b", "group_id", F.lit(0).alias("x"), "y")
        cells = left.unionByName(right).groupBy("org_a", "org_b", "group_id").agg(F.abs(F.sum("x") - F.sum("y")).alias("d"))
        return cells.groupBy("org_a", "org_b").agg(F.max("d").cast("double").alias("distance"))
    power = {"euclidean": 2.0, "manhattan": 1.0, "minkowski": p}.get(method)
    alone = {"canberra": lambda v: F.lit(1.0), "binary": lambda v: F.lit(1.0)}.get(method, lambda v: F.pow(v, F.lit(power)))
    together = {"canberra": F.abs(x - y) / (x + y), "binary": F.lit(0.0)}.get(method, F.pow(F.abs(x - y), F.lit(power or 1.0)))
    own = m.groupBy("org_id").agg(F.sum(alone(F.col("n").cast("double"))).alias("own"), F.count("*").alias("groups"))
    shared = pairs.groupBy("org_a", "org_b").agg(F.sum(together).alias("diff"), F.sum(alone(x)).alias("in_a"), F.sum(alone(y)).alias("in_b"), F.count("*").alias("both"))
    sides = own.select(F.col("org_id").alias("org_a"), F.col("own").alias("own_a"), F.col("groups").alias("g_a")).crossJoin(own.select(F.col("org_id").alias("org_b"), F.col("own").alias("own_b"), F.col("groups").alias("g_b"))).filter("org_a < org_b")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = F.col("own_a") + F.col("own_b") - z("in_a") - z("in_b") + z("diff")
    union = F.col("g_a") + F.col("g_b") - F.coalesce("both", F.lit(0))
    if method == "canberra":
        n_groups = m.select(F.countDistinct("group_id").alias("all_groups"))
        # terms 0/0 are left out and the sum is scaled up to all groups
        distance = total * F.col("all_groups") / union
        return sides.join(shared, ["org_a", "org_b"], "left").crossJoin(n_groups).select("org_a", "org_b", distance.alias("distance"))
    distance = total / union if method == "binary" else F.pow(total, F.lit(1.0 / power))
    return sides.join(shared, ["org_a", "org_b"], "left").select("org_a", "org_b", distance.alias("distance"))


def org_stat(genes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Per organism: n_genes, min_length, max_length, sd_length, n_gene_groups, n_paralogues."""
    lengths = genes.groupBy("org_id").agg(F.count("*").alias("n_genes"), F.min("width").alias("min_length"), F.max("width").alias("max_length"), F.stddev_samp("width").alias("sd_length"))
    return lengths.join(paralogue_counts(genes, links), "org_id")


def residue_frequency(genes: DataFrame) -> DataFrame:
    """(org_id, residue, n): letters of all sequences; counted within each row's map task first."""
    letters = genes.select("org_id", F.explode(F.split("sequence", "")).alias("residue")).filter("residue <> ''")
    return letters.groupBy("org_id", "residue").agg(F.count("*").alias("n"))


def group_stat(genes: DataFrame) -> DataFrame:
    """Per group: max_org (most genes of one organism), min/max/sd of length, number of genes (A4)."""
    per_org = pan_matrix(genes).groupBy("group_id").agg(F.max("n").alias("max_org"))
    lengths = genes.groupBy("group_id").agg(F.count("*").alias("n_genes"), F.min("width").alias("min_length"), F.max("width").alias("max_length"), F.stddev_samp("width").alias("sd_length"))
    return lengths.join(per_org, "group_id")


def representatives(genes: DataFrame, method: str = "longest", seed: int = 0) -> DataFrame:
    """One gene per group: longest, shortest (first on ties), or random (by a hash of id and seed)."""
    if method == "random":
        key = F.struct(F.md5(F.concat_ws(":", F.col("gene_id").cast("string"), F.lit(seed))).alias("o"), F.col("gene_id").alias("gene_id"))
        return genes.groupBy("group_id").agg(F.min(key)["gene_id"].alias("gene_id"))
    o = -F.col("width") if method == "longest" else F.col("width")
    best = F.min(F.struct(o.alias("o"), F.col("gene_id").alias("gene_id")))
    return genes.groupBy("group_id").agg(best["gene_id"].alias("gene_id"), F.abs(best["o"]).alias("width"))


def scale_range(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``column`` stretched to [low, high]; a constant column becomes their mean."""
    lo, hi = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    return df.withColumn(column, F.when(lo == hi, F.lit((low + high) / 2)).otherwise(F.lit(low) + (F.col(column) - lo) * (high - low) / (hi - lo)))


def renumber(df: DataFrame, column: str) -> DataFrame:
    """Dense numbers from 1 in the order of the old ones (P19): only the distinct values are ranked."""
    ranks = ranked(df.select(column).distinct(), column)
    return df.join(ranks, column).withColumn(column, F.col("_rank").cast("long")).drop("_rank")


def group_numbers(genes: DataFrame, key: str) -> DataFrame:
    """``genes`` with group_id 1.. by size descending, then by ``key`` (the canonical order of groups)."""
    sizes = genes.groupBy(key).agg(F.count("*").alias("_n"))
    order = ranked(sizes, F.col("_n").desc(), key, name="_group").select(key, "_group")
    return genes.drop("group_id").join(order, key).withColumnRenamed("_group", "group_id") if key != "group_id" else genes.join(order, key).drop("group_id").withColumnRenamed("_group", "group_id")


def merge_info(groups: DataFrame, key: str, columns: list[str], sep: str | None = None) -> DataFrame:
    """Distinct values of each column by ``key`` (A19), sorted, as lists or joined by ``sep``."""
    lists = [F.sort_array(F.collect_set(F.col(c).cast("string"))) for c in columns]
    return groups.groupBy(key).agg(*[(v if sep is None else F.array_join(v, sep)).alias(c) for v, c in zip(lists, columns, strict=True)])


def largest_info(groups: DataFrame, key: str, size: str, id_col: str) -> DataFrame:
    """Of each ``key`` the row of the greatest ``size``, the smallest ``id_col`` on ties."""
    rest = [c for c in groups.columns if c not in (key, size, id_col)]
    best = F.min(F.struct((-F.col(size)).alias("_o"), F.col(id_col).alias(id_col), *[F.col(c).alias(c) for c in rest])).alias("_b")
    return groups.groupBy(key).agg(best).select(key, (-F.col("_b")["_o"]).alias(size), *[F.col("_b")[c].alias(c) for c in [id_col, *rest]])


def stack(first: DataFrame, *others: DataFrame, fill: int | float | str | None = None) -> DataFrame:
    """Rows of all tables over the union of their columns (A22); cells that a table lacks are ``fill``, nulls of its own stay."""
    names = list(dict.fromkeys(c for t in (first, *others) for c in t.columns))
    out = None
    for t in (first, *others):
        one = t.select(*[F.col(c) if c in t.columns else F.lit(fill).alias(c) for c in names])
        out = one if out is None else out.unionByName(one)
    return out


def pair_to_index(row: Column | int, col: Column | int, n_rows: Column | int) -> Column | int:
    """Place of (row, col), both from 1, in a matrix stored by columns (P20)."""
    return n_rows * (col - 1) + row


def resize(df: DataFrame, n: int, order: str, name: str | None = None, names: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by ``order``, or all and rows of nulls up to ``n``.

    ``name``: a text column whose added values are ``names``, by default the row numbers, each made
    unique by a suffix where it is taken.
    """
    have = df.count()
    if n <= have:
        return df.orderBy(order).limit(n)
    spark = df.sparkSession
    added = spark.range(have + 1, n + 1).select(F.col("id").alias("_n"))
    if name is None:
        return df.unionByName(added.select(), allowMissingColumns=True)
    wanted = F.col("_n").cast("string") if names is None else F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("_n") - have).cast("int"))
    wanted = added.select("_n", wanted.alias("_w")).withColumn("_k", F.row_number().over(W.partitionBy("_w").orderBy("_n")))
    taken = df.select(F.col(name).alias("_w"), F.lit(1).alias("_t")).distinct()
    fresh = wanted.join(taken, "_w", "left").withColumn("_k", F.col("_k") - 1 + F.coalesce("_t", F.lit(0)))
    fresh = fresh.select(F.when(F.col("_k") == 0, F.col("_w")).otherwise(F.concat_ws(".", "_w", F.col("_k").cast("string"))).alias(name))
    return df.unionByName(fresh, allowMissingColumns=True)


def group_lists(genes: DataFrame) -> DataFrame:
    """(group_id, genes): a grouping as sorted lists of gene ids."""
    return genes.groupBy("group_id").agg(F.sort_array(F.collect_list("gene_id")).alias("genes"))
