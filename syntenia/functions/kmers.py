"""K-mer tables and cosine similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that start in one part of a sequence.
PART = 256


def kmers(genes: DataFrame, k: int, keys: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """(keys, kmer, n): counts of all words of length k; sequences shorter than k have none."""
    # substr walks from the start of its string: cut long sequences into overlapping parts first
    at = F.sequence(F.lit(0), F.floor((F.length("sequence") - k) / PART).cast("int"))
    parts = F.transform(at, lambda c: F.col("sequence").substr(c * PART + 1, F.lit(PART + k - 1)))
    words = F.transform(F.sequence(F.lit(1), F.length("part") - F.lit(k - 1)), lambda i: F.col("part").substr(i, F.lit(k)))
    cut = genes.filter(F.length("sequence") >= k).select(*keys, F.explode(parts).alias("part"))
    return cut.select(*keys, F.explode(words).alias("kmer")).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))


def weights(spectrum: DataFrame, key: str) -> DataFrame:
    """``spectrum`` with w = n / norm, so that a cosine is a sum of products."""
    norms = spectrum.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return spectrum.join(norms, key).select(*[c for c in spectrum.columns if c != "n"], (F.col("n") / F.col("norm")).alias("w"))


def cosine(spectrum: DataFrame, key: str, limit: float = 0.0, block: str | None = None) -> DataFrame:
    """(i, j, sim) for i < j of cosine >= limit (> 0 if the limit is 0), within ``block`` if given.

    With a limit the join is pruned without loss: k-mers are ranked rarest first, and a
    vector needs an index entry only while the weight from there on can still reach
    the limit (Cauchy-Schwarz over the rest of it).  Pairs that meet in both prefixes are verified on all k-mers.
    """
    w = weights(spectrum, key)
    own = [] if block is None else [block]
    a, b = (w.select(*own, "kmer", F.col(key).alias(n), F.col("w").alias(f"w{n}")) for n in ("i", "j"))
    dot = F.sum(F.col("wi") * F.col("wj")).alias("sim")
    if limit <= 0:
        return a.join(b, [*own, "kmer"]).filter("i < j").groupBy("i", "j").agg(dot)
    often = spectrum.groupBy("kmer").agg(F.count("*").alias("often"))
    onward = W.partitionBy(key).orderBy("often", "kmer").rowsBetween(0, W.unboundedFollowing)
    ranked = w.join(often, "kmer").withColumn("left", F.sqrt(F.sum(F.col("w") * F.col("w")).over(onward)))
    prefix = ranked.filter(F.col("left") >= limit - 1e-9).select(*own, "kmer", key)
    pa, pb = (prefix.select(*own, "kmer", F.col(key).alias(n)) for n in ("i", "j"))
    candidates = pa.join(pb, [*own, "kmer"]).filter("i < j").select("i", "j").distinct()
    full_i, full_j = w.select(F.col(key).alias("i"), "kmer", F.col("w").alias("wi")), w.select(F.col(key).alias("j"), "kmer", F.col("w").alias("wj"))
    return candidates.join(full_i, "i").join(full_j, ["j", "kmer"]).groupBy("i", "j").agg(dot).filter(F.col("sim") >= limit - 1e-12)


def transform_sim(edges: DataFrame, low: float, rescale: bool = True, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """Similarities stretched from [low, 1] to [0, 1], then passed through ``transform``."""
    sim = F.col("sim")
    if rescale:
        sim = (sim - low) / (1.0 - low)
    return edges.withColumn("sim", transform(sim) if transform else sim)


def org_kmers(genes: DataFrame, k: int) -> DataFrame:
    """(org_id, kmer, n): k-mers of all an organism's genes, none across genes."""
    return kmers(genes, k, ("org_id",))


def org_kmer_similarity(genes: DataFrame, k: int) -> DataFrame:
    """(i, j, sim) of organisms, at least 0 (A15); the distance is sqrt(1 - sim).  Pairs that share no k-mer, of similarity 0, are left out."""
    return cosine(org_kmers(genes, k), "org_id").withColumn("sim", F.greatest("sim", F.lit(0.0)))


def org_kmer_distance(genes: DataFrame, organisms: DataFrame, k: int, method: str = "cosine", power: float = 2.0) -> DataFrame:
    """(org_a, org_b, distance) of every pair of ``organisms`` (org_id) (A15): sqrt(1 - cosine), or a distance of the k-mer counts.

    Organisms are few and all their pairs are the result, so they are paired by a cross join.
    """
    a, b = organisms.select(F.col("org_id").alias("org_a")), organisms.select(F.col("org_id").alias("org_b"))
    pairs = a.crossJoin(b).filter("org_a < org_b")
    counts = org_kmers(genes, k)
    if method == "cosine":
        sims = cosine(counts, "org_id").toDF("org_a", "org_b", "sim")
        return pairs.join(sims, ["org_a", "org_b"], "left").select("org_a", "org_b", F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce("sim", F.lit(0.0)))).alias("distance"))
    x, y = (counts.select("kmer", F.col("org_id").alias(o), F.col("n").cast("double").alias(v)) for o, v in (("org_a", "x"), ("org_b", "y")))
    # each organism's own sum counts where the other lacks the k-mer; shared k-mers correct it
    one, both = {"euclidean": (lambda v: v * v, lambda x, y: (x - y) * (x - y)), "manhattan": (lambda v: v, lambda x, y: F.abs(x - y)), "minkowski": (lambda v: F.pow(v, F.lit(power)), lambda x, y: F.pow(F.abs(x - y), F.lit(power)))}[method]
    own = counts.groupBy("org_id").agg(F.sum(one(F.col("n").cast("double"))).alias("own"))
    fix = x.join(y, "kmer").filter("org_a < org_b").groupBy("org_a", "org_b").agg(F.sum(both(F.col("x"), F.col("y")) - one(F.col("x")) - one(F.col("y"))).alias("fix"))
    sums = pairs.join(own.toDF("org_a", "p"), "org_a", "left").join(own.toDF("org_b", "q"), "org_b", "left").join(fix, ["org_a", "org_b"], "left")
    total = F.coalesce("p", F.lit(0.0)) + F.coalesce("q", F.lit(0.0)) + F.coalesce("fix", F.lit(0.0))
    root = {"euclidean": F.sqrt(total), "manhattan": total, "minkowski": F.pow(total, F.lit(1.0 / power))}[method]
    return sums.select("org_a", "org_b", root.alias("distance"))


def length_close(a: Column, b: Column, limit: float, strict_max: bool = False) -> Column:
    """Lengths differ by at most ``limit`` of the shorter (or absolutely, from 1 on); ``strict_max``: by less, of the longer."""
    diff = F.abs(a - b)
    if strict_max:
        return (diff < limit) if limit >= 1 else (diff / F.greatest(a, b) < limit)
    return (diff <= limit) if limit >= 1 else (diff / F.least(a, b) <= limit)
