"""Grouping genes (G1-G12): leader clustering, greedy identity clustering, community detection.

Greedy operators are order dependent, but a gene's decision depends only on genes
it could match.  So candidate pairs come from a distributed join, connected components
split the work, and the scan runs in one grouped function per component.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pairs import Shared, sharing_pairs, similar_pairs
from ..plans.ranks import ranked
from ..plans.tables import discard, materialize, scope
from .communities import fast_greedy, infomap, label_propagation, louvain, scan_of
from .components import component_roots, components


#: Pairs that are scanned by component at once, in leader clustering; rounds before the rest is, however many it has.
SCANNED, ROUNDS = 200_000, 25


def manual_grouping(genes: DataFrame, groups: DataFrame) -> DataFrame:
    """``genes`` with the given (gene_id, group_id) (G1)."""
    return genes.drop("group_id").join(groups.select("gene_id", "group_id"), "gene_id", "left")


def grouping_from_lists(spark, lists: list[list[int]]) -> DataFrame:
    """(gene_id, group_id) from lists of gene ids, numbered by size descending, stable."""
    order = sorted(range(len(lists)), key=lambda i: (-len(lists[i]), i))
    return spark.createDataFrame([(int(g), n + 1) for n, i in enumerate(order) for g in lists[i]], "gene_id long, group_id long")


def number_groups(members: DataFrame) -> DataFrame:
    """(gene_id, group_id) from (gene_id, root): 1.. by size descending, then by root."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    ranks = ranked(sizes, F.col("n").desc(), "root", name="group_id").select("root", "group_id")
    return members.join(ranks, "root").select("gene_id", "group_id")


def scan_components(genes: DataFrame, edges: DataFrame, scan: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """(gene_id, leader): ``scan(genes, edges)`` for each component of the candidate edges (i, j, ...); genes without an edge lead themselves."""
    edges = materialize(edges, "candidates")
    nodes = edges.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    label = materialize(components(nodes, edges.select(F.col("i").alias("u"), F.col("j").alias("v"))), "components")
    inside = genes.join(label.withColumnRenamed("node", "gene_id"), "gene_id")
    links = edges.join(label.select(F.col("node").alias("i"), F.col("component").alias("block")), "i")
    found = inside.groupBy("component").cogroup(links.groupBy("block")).applyInPandas(scan, "gene_id long, leader long")
    alone = genes.select("gene_id").join(nodes.withColumnRenamed("node", "gene_id"), "gene_id", "left_anti").select("gene_id", F.col("gene_id").alias("leader"))
    return found.unionByName(alone)


def _leaders(genes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """In order of sequence and id, join the newest leader that is similar, else lead."""
    near: dict[int, set[int]] = {}
    for i, j in zip(edges["i"], edges["j"], strict=True):
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    when: dict[int, int] = {}
    out = []
    order = genes.assign(_key=genes["sequence"].map(lambda s: s.encode())).sort_values(["_key", "gene_id"], kind="stable")
    for n, g in enumerate(order["gene_id"]):
        mine = [x for x in near.get(g, ()) if x in when]
        leader = max(mine, key=when.__getitem__) if mine else g
        if leader == g:
            when[g] = n
        out.append((g, leader))
    return pd.DataFrame(out, columns=["gene_id", "leader"])


def first_of_equal(genes: DataFrame, text: Column, *by: str) -> DataFrame:
    """(gene_id, rep): the smallest id of those with the same text (and ``by``).  A greedy scan treats equal genes alike, so one of them stands for all."""
    own = genes.select("gene_id", *by, text.alias("_text"))
    least = own.groupBy(*by, "_text").agg(F.min("gene_id").alias("rep"), F.count("*").alias("_n"))
    same = [F.col("_text").eqNullSafe(F.col("_t")), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]]
    repeated = least.filter("_n > 1").select("rep", F.col("_text").alias("_t"), *[F.col(c).alias(f"_{c}") for c in by])
    on = same[0]
    for c in same[1:]:
        on = on & c
    return own.join(repeated, on, "left").select("gene_id", F.coalesce("rep", "gene_id").alias("rep"))


def _for_all(reps: DataFrame, found: DataFrame) -> DataFrame:
    """(gene_id, leader) of every gene from those of the representatives."""
    return reps.join(found.withColumnRenamed("gene_id", "rep"), "rep").select("gene_id", "leader")


def _covered(links: DataFrame) -> list[DataFrame]:
    """Written tables (node) of all nodes of (lo, hi), written, that are no leaders: in ascending order a node leads unless it is tied to a leader before it.

    Round by round: nodes with no open node before them lead, those tied to them are covered, and links of these go.  What is
    left when it is small, or after some rounds (a chain needs many), is scanned, a component in one task.
    """
    out = []
    for _ in range(ROUNDS):
        if links.limit(SCANNED + 1).count() <= SCANNED:
            break
        first = links.select(F.col("lo").alias("node")).distinct().join(links.select(F.col("hi").alias("node")).distinct(), "node", "left_anti")
        out.append(materialize(links.join(first.withColumnRenamed("node", "lo"), "lo", "left_semi").select(F.col("hi").alias("node")).distinct(), "covered"))
        left = links
        for side in ("hi", "lo"):
            left = left.join(out[-1].withColumnRenamed("node", side), side, "left_anti")
        before, links = links, materialize(left.select("lo", "hi"), "links")
        discard(before)
    nodes = links.select(F.explode(F.array("lo", "hi")).alias("gene_id")).distinct()
    found = scan_components(nodes, links.select(F.col("lo").alias("i"), F.col("hi").alias("j")), _first)
    return [*out, materialize(found.filter("gene_id <> leader").select(F.col("gene_id").alias("node")), "covered")]


def _first(genes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """In order of id, join the newest leader that is tied, else lead."""
    return _leaders(genes.assign(sequence=""), edges)


def _led(one: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene_id, leader) as :func:`_leaders` over all of ``one`` (gene_id, sequence) and the written (i, j), without a task for a whole component."""
    with scope() as spared:
        tied = one.join(edges.select(F.explode(F.array("i", "j")).alias("gene_id")).distinct(), "gene_id", "left_semi")
        place = materialize(ranked(tied, "sequence", "gene_id", name="at").select("gene_id", "at"), "places")
        a, b = (place.select(F.col("gene_id").alias(x), F.col("at").alias(f"at_{x}")) for x in ("i", "j"))
        links = edges.join(a, "i").join(b, "j").select(F.least("at_i", "at_j").alias("lo"), F.greatest("at_i", "at_j").alias("hi"))
        links = materialize(links, "links")
        kept = materialize(links, "all-links")
        covered = reduce(DataFrame.unionByName, _covered(links))
        newest = kept.join(covered.withColumnRenamed("node", "lo"), "lo", "left_anti").join(covered.withColumnRenamed("node", "hi"), "hi", "left_semi").groupBy("hi").agg(F.max("lo").alias("lo"))
        found = newest.join(place.toDF("gene_id", "hi"), "hi").join(place.toDF("leader", "lo"), "lo").select("gene_id", "leader")
        found = materialize(found, "led")
        spared.append(found)
    return one.select("gene_id").join(found, "gene_id", "left").select("gene_id", F.coalesce("leader", "gene_id").alias("leader"))


def leader_clusters(genes: DataFrame, k: int = 5, limit: float = 0.5, block: str | None = None, kind: str | None = None) -> DataFrame:
    """(gene_id, leader) by cosine of k-mers >= limit (G9); ``block`` keeps to pairs of equal value of that column; ``kind`` as of :func:`similar_pairs`."""
    keys = ("gene_id",) if block is None else ("gene_id", block)
    long = F.length("sequence") >= k  # shorter ones have no k-mer and lead themselves
    reps = materialize(first_of_equal(genes.filter(long), F.col("sequence"), *keys[1:]), "equal")
    one = genes.join(reps.filter("gene_id = rep").select("gene_id"), "gene_id", "left_semi")
    edges = similar_pairs(one, k, limit, block, kind)
    own = one.select("gene_id", "sequence")
    few = edges.limit(SCANNED + 1).count() <= SCANNED
    found = _for_all(reps, scan_components(own, edges.select("i", "j"), _leaders) if few else _led(own, edges))
    return found.unionByName(genes.filter(F.coalesce(~long, F.lit(True))).select("gene_id", F.col("gene_id").alias("leader")))


def group_similarity(genes: DataFrame, k: int, limit: float) -> DataFrame:
    """(i, j, sim) of pairs in the same group with cosine > limit."""
    return similar_pairs(genes, k, limit, "group_id").filter(F.col("sim") > limit)


# -- identity clustering -------------------------------------------------------------------


@dataclass(frozen=True)
class IdentityOptions:
    """Options of greedy identity clustering; c identity, k word length, s/S length cut (share, residues), g 1 best instead of first,
    aL/aS alignment coverage of the representative/shorter, scores of residue pairs ("protein", "dna", or "plain": match, mismatch),
    cost of a gap's first and of each further residue."""

    c: float = 0.9
    k: int = 5
    s: float = 0.0
    S: int = 999_999
    g: int = 0
    aL: float = 0.0
    aS: float = 0.0
    scores: str = "protein"
    match: int = 5
    mismatch: int = -4
    opening: int = 11
    extension: int = 1

    def __post_init__(self):
        if not (0 < self.c <= 1 and self.k >= 1 and 0 <= self.s <= 1 and self.S >= 0 and self.g in (0, 1) and self.scores in ("protein", "dna", "plain")):
            raise ValueError(f"bad clustering options: {self}")


def normalize(sequence: str) -> str:
    """Upper case, no trailing stop sign."""
    return sequence.upper().rstrip("*")


#: The BLOSUM62 scores of the 20 amino acids, each against itself and those before it.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def _protein_scores() -> np.ndarray:
    """Scores by code point up to 127: B as N, Z as E; any other character -1 with all."""
    out = np.full((128, 128), -1, np.int64)
    for a, row in zip(RESIDUES, BLOSUM62.split("\n")[1:], strict=False):
        for b, v in zip(RESIDUES, row.split(), strict=False):
            out[ord(a), ord(b)] = out[ord(b), ord(a)] = int(v)
    for same, as_ in (("B", "N"), ("Z", "E")):
        out[ord(same)], out[:, ord(same)] = out[ord(as_)], out[:, ord(as_)]
        out[ord(same), ord(same)] = out[ord(as_), ord(as_)]
    return out


def _dna_scores() -> np.ndarray:
    """2 for equal bases, 1 for T with U and for N with itself, else -2."""
    out = np.full((128, 128), -2, np.int64)
    for a, b, v in (*((x, x, 2) for x in "ACGTU"), ("T", "U", 1), ("N", "N", 1)):
        out[ord(a), ord(b)] = out[ord(b), ord(a)] = v
    return out


_SCORES = {"protein": _protein_scores(), "dna": _dna_scores()}


def dna_options(c: float = 0.95, **more) -> IdentityOptions:
    """Options for nucleotides (G13): their own scores, gaps of 6 and 1, identity 0.95 unless given."""
    return IdentityOptions(**{"c": c, "scores": "dna", "opening": 6, "extension": 1} | more)


def identity(query: str, rep: str, o: IdentityOptions = IdentityOptions()) -> tuple[float, int]:
    """Identical residues of the best alignment with affine gaps over the query's length, and the aligned residues.

    Ends are free.  Score and identical residues are one number, so ties go to more identities.
    """
    if query == rep:
        return 1.0, len(query)
    if not query or not rep:
        return 0.0, 0
    a, b = np.frombuffer(query.encode("utf-32-le"), np.uint32), np.frombuffer(rep.encode("utf-32-le"), np.uint32)
    shift = np.int64(1) << np.int64(24)
    wide = len(b) + 1
    at = np.arange(wide, dtype=np.int64) * (o.extension * shift)
    pair: dict[int, np.ndarray] = {}
    for x in np.unique(a).tolist():
        same = b == x
        pair[x] = np.where(same, o.match, o.mismatch) if o.scores == "plain" else _SCORES[o.scores][min(x, 127), np.minimum(b, 127)]
        pair[x] = pair[x] * shift + same
    h, down = np.zeros(wide, np.int64), np.full(wide, -(np.int64(1) << np.int64(60)))
    best = np.int64(0)
    for x in a.tolist():
        slant = np.zeros(wide, np.int64)
        slant[1:] = h[:-1] + pair[x]
        down = np.maximum(h - o.opening * shift, down - o.extension * shift)
        row = np.maximum(slant, down)
        # a gap from any place before: its first residue costs the opening, each further one the extension
        across = np.maximum.accumulate(row + at) - at - (o.opening - o.extension) * shift
        row[1:] = np.maximum(row[1:], across[:-1] - o.extension * shift)
        row[0] = 0
        h = row
        best = max(best, h[-1])
    best = max(best, h.max())
    same = int(best & (shift - 1)) if best >= shift else 0
    return same / len(query), same


def _greedy(o: IdentityOptions):
    def scan(genes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        text = {g: normalize(s) for g, s in zip(genes["gene_id"], genes["sequence"], strict=True)}
        near: dict[int, list[int]] = {}
        for i, j in zip(edges["i"], edges["j"], strict=True):
            near.setdefault(i, []).append(j)
            near.setdefault(j, []).append(i)
        place: dict[int, int] = {}
        out = []
        for g in sorted(text, key=lambda x: (-len(text[x]), x)):
            size, found, top = len(text[g]), None, -1.0
            for rep in sorted((x for x in near.get(g, ()) if x in place), key=place.__getitem__):
                longer = len(text[rep])
                if longer > min(size / o.s if o.s else longer, size + o.S):
                    continue
                share, same = identity(text[g], text[rep], o)
                if share >= o.c and same >= o.aL * longer and same >= o.aS * size and share > top:
                    found, top = rep, share
                    if not o.g:
                        break
            if found is None:
                place[g] = len(place)
            out.append((g, g if found is None else found))
        return pd.DataFrame(out, columns=["gene_id", "leader"])

    return scan


def identity_candidates(genes: DataFrame, o: IdentityOptions) -> DataFrame:
    """Pairs sharing enough words: sum of the lesser counts >= L - k + 1 - (1 - c) L k (lossless), and at least one (G12a-c); by blocks of like length."""
    clean = genes.select("gene_id", F.regexp_replace(F.upper("sequence"), r"\*+$", "").alias("sequence"))
    return sharing_pairs(clean, Shared(o.k, o.c, o.s, o.S)).select("i", "j")


def identity_clusters(genes: DataFrame, options: IdentityOptions = IdentityOptions()) -> DataFrame:
    """(gene_id, leader): longest first, each gene joins the first (or best) representative of identity >= c.

    Genes shorter than the word length are alone (or lead themselves).  Equal sequences are compared once
    (but where the best representative is asked for, as one made meanwhile may be better).
    """
    if options.g:
        return scan_components(genes.select("gene_id", "sequence"), identity_candidates(genes, options), _greedy(options))
    clean = F.regexp_replace(F.upper("sequence"), r"\*+$", "")
    long = F.coalesce(F.length(clean) >= options.k, F.lit(False))
    reps = materialize(first_of_equal(genes.filter(long), clean), "equal")
    one = genes.join(reps.filter("gene_id = rep").select("gene_id"), "gene_id", "left_semi").select("gene_id", "sequence")
    found = _for_all(reps, scan_components(one, identity_candidates(one, options), _greedy(options)))
    return found.unionByName(genes.filter(~long).select("gene_id", F.col("gene_id").alias("leader")))


def word_size(limit: float) -> int:
    """Word length for an identity limit."""
    return 5 if limit >= 0.7 else 4 if limit >= 0.6 else 3 if limit >= 0.5 else 2


def _lift(members: DataFrame, merged: DataFrame) -> DataFrame:
    """(gene_id, leader) after representatives themselves were clustered."""
    up = merged.select(F.col("gene_id").alias("leader"), F.col("leader").alias("_up"))
    return members.join(up, "leader", "left").select("gene_id", F.coalesce("_up", "leader").alias("leader"))


def _drawn(members: DataFrame, seed: int) -> DataFrame:
    """(gene_id, leader) with another member of each cluster as its leader, drawn by a hash."""
    one = members.groupBy("leader").agg(F.min(F.struct(F.xxhash64("gene_id", F.lit(seed)).alias("h"), "gene_id"))["gene_id"].alias("_one"))
    return members.join(one, "leader").select("gene_id", F.col("_one").alias("leader"))


def precluster(genes: DataFrame, *, max_length_dif: float = 0.1, k: int = 5, dna: bool = False) -> DataFrame:
    """(gene_id, leader) at the default identity, 0.9 for proteins and 0.95 for nucleotides."""
    cut = {"s": 1 - max_length_dif} if max_length_dif < 1 else {"S": int(max_length_dif)}
    return identity_clusters(genes, dna_options(k=k, **cut) if dna else IdentityOptions(k=k, **cut))


def identity_grouping(genes: DataFrame, *, lower: float = 0.5, start: float = 0.9, by: float = 0.05, max_length_dif: float = 0.1, k: int = 5, iterate: bool = True, rep: str = "longest", seed: int = 0) -> DataFrame:
    """(gene_id, group_id): cluster at ``start``, then cluster representatives, the longest or ("random") drawn anew, at ever lower limits (G5, G6);
    ``iterate=False``: leader clustering of the representatives at ``lower`` (G7)."""
    if rep not in ("longest", "random"):
        raise ValueError(f"unknown representatives {rep!r}")
    cut = {"s": 1 - max_length_dif} if max_length_dif < 1 else {"S": int(max_length_dif)}
    members = materialize(identity_clusters(genes, IdentityOptions(c=start, k=k, **cut)), "level")
    level, turn = start - by, seed
    while iterate and level >= lower - 1e-9:
        if rep == "random":
            members, turn = materialize(_drawn(members, turn), "drawn"), turn + 1
        reps = genes.join(members.select(F.col("leader").alias("gene_id")).distinct(), "gene_id", "left_semi")
        old, members = members, materialize(_lift(members, identity_clusters(reps, IdentityOptions(c=level, k=word_size(level), **cut))), "level")
        discard(old)
        level -= by
    if not iterate:
        reps = genes.join(members.select(F.col("leader").alias("gene_id")).distinct(), "gene_id", "left_semi")
        members = _lift(members, leader_clusters(reps, k, lower))
    return number_groups(members.withColumnRenamed("leader", "root"))


# -- community detection -------------------------------------------------------------------


def _label_prop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = label_propagation(edges).select(F.col("node").alias("gene_id"), F.col("label").alias("leader"))
    return nodes.join(found, "gene_id", "left").select("gene_id", F.coalesce("leader", "gene_id").alias("leader"))


def _scanned(find: Callable) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def run(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        total = 2 * (edges.agg(F.sum("sim")).first()[0] or 0.0)
        return scan_components(nodes, edges.select("i", "j", "sim"), scan_of(find, total))

    return run


#: Community algorithms by name (U4); a plug-in maps (nodes(gene_id), edges(i, j, sim)) to (gene_id, leader).
ALGORITHMS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "label_prop": _label_prop,
    "louvain": _scanned(louvain),
    "fast_greedy": _scanned(fast_greedy),
    "infomap": _scanned(infomap),
}


def graph_grouping(genes: DataFrame, edges: DataFrame, algorithm: str = "infomap") -> DataFrame:
    """(gene_id, group_id) by community detection on (i, j, sim).

    infomap minimises the two-level map equation with one component's exits at a time, as components are found
    apart.  The spectral, betweenness, annealing and random-walk-distance methods and the exact optimum are refused.
    """
    name = algorithm.removeprefix("cluster_")
    if name not in ALGORITHMS:
        raise ValueError(f"unsupported community algorithm {algorithm!r}; one of {sorted(ALGORITHMS)}")
    return number_groups(ALGORITHMS[name](genes.select("gene_id"), edges).withColumnRenamed("leader", "root"))


def _joined_by(members: DataFrame, preclusters: DataFrame) -> DataFrame:
    """Groups (node, leader) that are active and have members of one precluster become one."""
    pre = preclusters.select("gene_id", F.col("leader").alias("_pre"))
    seen = members.filter("now").join(pre, "gene_id").select("node", "leader", "_pre").distinct()
    # a group's leader and a precluster's, as nodes of one graph; both name genes, so preclusters are negative
    edges = seen.select("leader", (-F.col("_pre") - 1).alias("_p"), "node")
    first = edges.groupBy("node", "_p").agg(F.min("leader").alias("_f"))
    links = edges.join(first, ["node", "_p"]).filter("leader <> _f").select(F.col("leader").alias("u"), F.col("_f").alias("v"))
    label = component_roots(links).select(F.col("node").alias("leader"), F.col("root").alias("_root"))
    return members.join(label, "leader", "left").select("gene_id", "node", F.coalesce(F.when(F.col("now"), F.col("_root")), "leader").alias("leader"), "now")


def tree_grouping(genes: DataFrame, tree: list[tuple[int, int, int]], *, k: int = 5, lower: float = 0.5, preclusters: DataFrame | None = None) -> DataFrame:
    """(gene_id, group_id) bottom-up along a tree of organisms.

    ``tree`` lists merges (left, right, parent), children before parents; leaves are org ids.
    All nodes of a level are one job: representatives (by a hash of id) of the children's
    groups are leader-clustered with the node as block.  Children's groups that share a precluster
    (gene_id, leader) are joined first, so that their representatives need no comparison.
    """
    spark = genes.sparkSession
    height: dict[int, int] = {}
    for left, right, parent in tree:
        height[parent] = 1 + max(height.get(left, 0), height.get(right, 0))
    members = genes.select("gene_id", F.col("org_id").cast("long").alias("node"), F.col("gene_id").alias("leader"))
    for level in range(1, max(height.values(), default=0) + 1):
        moves = [(int(c), int(p)) for left, right, p in tree if height[p] == level for c in (left, right)]
        up = spark.createDataFrame(moves, "node long, parent long")
        members = materialize(members.join(F.broadcast(up), "node", "left").select("gene_id", F.coalesce("parent", "node").alias("node"), "leader", F.col("parent").isNotNull().alias("now")), "tree")
        if preclusters is not None:
            members = materialize(_joined_by(members, preclusters), "joined")
        reps = members.filter("now").groupBy("node", "leader").agg(F.min(F.struct(F.xxhash64("gene_id").alias("h"), "gene_id"))["gene_id"].alias("gene_id"))
        found = leader_clusters(reps.join(genes.select("gene_id", "sequence"), "gene_id"), k, lower, "node")
        new = reps.select("leader", F.col("gene_id").alias("rep")).join(found.select(F.col("gene_id").alias("rep"), F.col("leader").alias("_up")), "rep").select("leader", "_up")
        members = materialize(members.join(new, "leader", "left").select("gene_id", "node", F.coalesce("_up", "leader").alias("leader")), "tree")
    return number_groups(members.select("gene_id", F.col("leader").alias("root")))

