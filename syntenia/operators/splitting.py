"""Splitting, merging and linking gene groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kmers import length_close, transform_sim
from ..functions.pairs import similar_pairs
from ..plans.tables import materialize
from .clustering import IdentityOptions, graph_grouping, group_similarity, identity_clusters, number_groups
from .components import components
from .matrix import representatives, with_paralogues
from .neighbors import degrees, flanks, neighbors, pc_edges

#: Genes of a part of a group, whose pairs with another part are compared in one task; pairs compared, and sent, at once.
PART, TILE, BATCH = 1 << 15, 1 << 16, 1 << 18


def pairs_in_group(genes: DataFrame, *columns: str) -> DataFrame:
    """(group_id, i, j, <column>_i, <column>_j) for i < j of the same group."""
    a, b = (genes.select("group_id", F.col("gene_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in ("i", "j"))
    return a.join(b, "group_id").filter("i < j")


def width_band(width: Column, limit: float) -> Column:
    """The band of a width, of :func:`band_pairs`."""
    return F.floor(width / limit) if limit >= 1 else F.floor(F.log(F.greatest(width, F.lit(1e-9))) / (F.log(F.lit(1.0 + limit)) * (1 + 1e-6))) if limit > 0 else F.xxhash64(width)


def band_pairs(genes: DataFrame, limit: float, *columns: str) -> DataFrame:
    """:func:`pairs_in_group` of genes whose ``width`` differs by at most ``limit`` of the shorter (or absolutely, from 1 on).

    Widths are cut into bands so wide, by a little more than the limit for the rounding of logarithms, that close ones
    are in the same or the next, so only those meet and a large group is many keys.
    """
    own = genes.select("group_id", "gene_id", "width", *columns, width_band(F.col("width").cast("double"), limit).alias("_band"))
    a = own.select("group_id", F.col("gene_id").alias("i"), "_band", *[F.col(c).alias(f"{c}_i") for c in ("width", *columns)])
    reach = F.array("_band", F.col("_band") + 1) if limit > 0 else F.array("_band")
    b = own.select("group_id", F.col("gene_id").alias("j"), F.explode(reach).alias("_band"), F.col("_band").alias("_own"), *[F.col(c).alias(f"{c}_j") for c in ("width", *columns)])
    met = a.join(b, ["group_id", "_band"]).filter(length_close(F.col("width_i"), F.col("width_j"), limit) & ((F.col("_band") != F.col("_own")) | (F.col("i") < F.col("j"))))
    swap = F.col("i") > F.col("j")
    sides = [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in ("width", *columns) for x, y in (("i", "j"), ("j", "i"))]
    return met.select("group_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *sides)


def _split(genes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene_id, group_id): components of edges (i, j) inside groups."""
    label = components(genes.select(F.col("gene_id").alias("node")), edges.select(F.col("i").alias("u"), F.col("j").alias("v")))
    return number_groups(label.select(F.col("node").alias("gene_id"), F.col("component").alias("root")))


def width_components(genes: DataFrame, limit: float = 0.1) -> DataFrame:
    """(gene_id, component): genes of a group linked while lengths are close, in a chain.

    Sorted by length, genes are linked to the next one or to none: a gap test over
    neighbors gives the same components as all pairs, without a join.
    """
    w = W.partitionBy("group_id").orderBy("width", "gene_id")
    before = F.lag("width").over(w)
    cut = F.when(before.isNotNull() & length_close(F.col("width"), before, limit), 0).otherwise(1)
    run = genes.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(w))
    return run.withColumn("component", F.min("gene_id").over(W.partitionBy("group_id", "_run"))).select("gene_id", "component")


def kmer_split(genes: DataFrame, k: int = 5, limit: float = 0.5, max_length_dif: float = 0.1) -> DataFrame:
    """(gene_id, group_id): components of pairs of a group with cosine >= limit and lengths close (strictly, of the longer)."""
    sims = similar_pairs(genes, k, limit, "group_id")
    width = genes.select("gene_id", "width")
    close = sims.join(width.toDF("i", "wi"), "i").join(width.toDF("j", "wj"), "j").filter(length_close(F.col("wi"), F.col("wj"), max_length_dif, strict_max=True))
    return _split(genes, close)


def neighborhood_similarity(genes: DataFrame, flank_size: int = 4, force_paralogues: bool = True, max_length_dif: float = 0.1) -> DataFrame:
    """(group_id, i, j, n_sim): equal places of the two flanks after each is cut down to common groups; pairs above 0."""
    return neighborhood_similarity_of(flanks(genes, flank_size), force_paralogues, max_length_dif)


def merge_sims(n_sims: DataFrame, s_sims: DataFrame, genes: DataFrame | None = None, guide: str | None = None) -> DataFrame:
    """Pairs in both tables, with g_sim = 1 where the guide column agrees."""
    both = n_sims.join(s_sims.select("i", "j", F.col("sim").alias("s_sim")), ["i", "j"])
    if guide is None:
        return both.withColumn("g_sim", F.lit(0))
    own = genes.select("gene_id", F.col(guide).alias("g"))
    out = both.join(own.toDF("i", "g_i"), "i").join(own.toDF("j", "g_j"), "j")
    return out.withColumn("g_sim", F.coalesce((F.col("g_i") == F.col("g_j")).cast("int"), F.lit(0))).drop("g_i", "g_j")


def _grown(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes ascending, place of the first node of each one's clique) of the edges i < j, best first.

    An edge's rank is its place.  A clique's common neighbors keep their best rank to any member, so that the next
    member is found among them, and each node's neighbors are looked through once, when it joins.
    """
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    n, m, at = len(nodes), len(i), at.astype(np.int32)
    a, b = at[:m], at[m:]
    key = np.concatenate([a, b]).astype(np.int64) * n
    key += np.concatenate([b, a])
    key, first = np.unique(key, return_index=True)
    rank, to = (first % m).astype(np.int32), (key % n).astype(np.int32)
    del first
    start = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * n)
    del key
    left, root = np.ones(n, bool), np.arange(n)

    def meet(c: np.ndarray, r: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``c`` that are neighbors of ``node`` too, with the lesser ranks."""
        near, by = to[start[node] : start[node + 1]], rank[start[node] : start[node + 1]]
        p = np.minimum(np.searchsorted(near, c), len(near) - 1)
        hit = near[p] == c
        return c[hit], np.minimum(r[hit], by[p[hit]])

    for base in range(0, m, 1 << 16):
        part = slice(base, base + (1 << 16))
        for e in (np.flatnonzero(left[a[part]] & left[b[part]]) + base).tolist():
            x, y = int(a[e]), int(b[e])
            if not left[x] or not left[y]:
                continue
            own = [x, y]
            c = to[start[x] : start[x + 1]]
            open_ = left[c]
            c, r = meet(c[open_], rank[start[x] : start[x + 1]][open_], y)
            while len(c):
                own.append(int(c[np.argmin(r)]))
                c, r = meet(c, r, own[-1])
            left[own], root[own] = False, min(own)
    return nodes, root


def extract_cliques(edges: list[tuple]) -> list[list[int]]:
    """Cliques of (i, j, n_sim, s_sim, g_sim), taken greedily from the best edge.

    The best remaining edge starts a clique; it grows by the best edge that ties a common
    neighbor of all members to it; its members leave the graph; nodes left without an
    edge are cliques of one.
    """
    if not edges:
        return []
    ranked = sorted(edges, key=lambda e: (-e[2], -e[3], -e[4], e[0], e[1]))
    nodes, root = _grown(*(np.array([e[k] for e in ranked], np.int64) for k in (0, 1)))
    out: dict[int, list[int]] = {}
    for g, c in zip(nodes.tolist(), root.tolist(), strict=True):
        out.setdefault(c, []).append(g)
    return list(out.values())


def _clique_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gene_id, root) of rows (component, i, j), a component's together and best first."""
    now, held = None, []

    def found() -> pa.RecordBatch:
        i, j = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        held.clear()
        nodes, root = _grown(i, j)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["gene_id", "root"])

    for batch in batches:
        c, i, j = (batch.column(k).to_numpy() for k in range(3))
        cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1], [True]))) if len(c) else np.zeros(1, np.int64)
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if held and c[s] != now:
                yield found()
            now = c[s]
            held.append((i[s:e].copy(), j[s:e].copy()))
    if held:
        yield found()


def cliques(genes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene_id, root): cliques of (i, j, n_sim, s_sim, g_sim), a component in one task, to which its edges come sorted; genes without an edge are alone."""
    edges = materialize(edges.select("i", "j", F.col("n_sim").cast("long").alias("n_sim"), "s_sim", F.col("g_sim").cast("long").alias("g_sim")), "cliques")
    nodes = edges.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    label = components(nodes, edges.select(F.col("i").alias("u"), F.col("j").alias("v")))
    ranked = edges.join(label.withColumnRenamed("node", "i"), "i").repartition("component").sortWithinPartitions("component", F.desc("n_sim"), F.desc("s_sim"), F.desc("g_sim"), "i", "j")
    found = ranked.select("component", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).mapInArrow(_clique_scan, "gene_id long, root long")
    alone = genes.select("gene_id").join(nodes.withColumnRenamed("node", "gene_id"), "gene_id", "left_anti").select("gene_id", F.col("gene_id").alias("root"))
    return found.unionByName(alone)


def neighbor_split(genes: DataFrame, groups: DataFrame, *, flank_size: int, force_paralogues: bool, k: int, limit: float, max_length_dif: float, guide: str | None = None) -> DataFrame:
    """(gene_id, root) for the genes of ``groups``: X3, cosine, X4, X5 of all of them in one job."""
    f = flanks(genes, flank_size).join(groups, "group_id", "left_semi")
    n = neighborhood_similarity_of(f, force_paralogues, max_length_dif)
    s = group_similarity(f, k, limit)
    return cliques(f, merge_sims(n, s, f, guide))


def _places(own: pa.Array, other: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flanks of two sides as small whole numbers, a row for each place and a column for each gene; what is missing equals nothing."""
    sides = [(x.flatten(), np.nan_to_num(np.asarray(pc.list_value_length(x).to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)) for x in (own, other)]
    code = pa.concat_arrays([flat for flat, _ in sides]).dictionary_encode()
    codes, known = code.indices.fill_null(-1).to_numpy(zero_copy_only=False), len(code.dictionary)
    kind = np.uint8 if known < 254 else np.uint16 if known < 65534 else np.uint32
    most, done, out = max([1, *(int(n.max(initial=0)) for _, n in sides)]), 0, []
    for number, (flat, n) in enumerate(sides):
        table, mine = np.full((most, len(n)), known + number, kind), codes[done : done + len(flat)]
        at, column = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(n)), n)
        table[at, column] = np.where(mine < 0, known + number, mine)
        out.append(table)
        done += len(flat)
    return out[0], out[1]


def _equal_places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For all pairs of the columns of ``x`` and ``y`` (places, genes): equal places after each is cut down to common values."""
    shape = (x.shape[1], y.shape[1])
    same = [[a[:, None] == b for b in y] for a in x]

    def before(found: list[np.ndarray]) -> list[np.ndarray]:
        """How many places before each one stay."""
        out = [np.zeros(shape, np.uint8)]
        for f in found:
            out.append(out[-1] + f.view(np.uint8))
        return out

    def any_of(parts: Iterable[np.ndarray]) -> np.ndarray:
        out = np.zeros(shape, bool)
        for part in parts:
            out |= part
        return out

    at_x = before([any_of(row) for row in same[:-1]])
    at_y = before([any_of(column) for column in list(zip(*same, strict=True))[:-1]])
    total, hit = np.zeros(shape, np.uint8), np.empty(shape, bool)
    for row, p in zip(same, at_x, strict=True):
        for s, q in zip(row, at_y, strict=True):
            np.equal(p, q, out=hit)
            hit &= s
            total += hit.view(np.uint8)
    return total


def _alike(limit: float, apart: bool, names: list[str]):
    """(group_id, i, n_sim, j: list) of rows (group_id, _band, _next, _p, _q, _side, gene_id, org_id, width, flank), those of one meeting together."""

    def met(group, within: bool, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side, ids = rows.column("_side").to_numpy(), rows.column("gene_id").combine_chunks()
        order = pc.sort_indices(ids).to_numpy()
        x, y = (rows.take(pa.array(order[side[order] == n])).combine_chunks() for n in (0, 0 if within else 1))
        if not x.num_rows or not y.num_rows:
            return
        (xi, yi), (xo, yo), (xf, yf) = (tuple(t.column(c).combine_chunks() for t in (x, y)) for c in ("gene_id", "org_id", "flank"))
        flank_x, flank_y = _places(xf, yf)
        org = pa.concat_arrays([xo, yo]).dictionary_encode()
        orgs = org.indices.fill_null(0).to_numpy().astype(np.uint8 if len(org.dictionary) <= 256 else np.uint32)
        org_x, org_y = orgs[: len(xo)], orgs[len(xo) :]
        width_x, width_y = (t.column("width").to_numpy() for t in (x, y))
        level = np.ptp(np.concatenate([width_x, width_y])) == 0 and width_x[0] > 0
        rank = np.concatenate([[0], np.cumsum(pc.not_equal(xi[1:], xi[:-1]).to_numpy(zero_copy_only=False))]) if within else None
        step = max(1, TILE // len(yi))
        held, n_held = [], 0

        def sent() -> pa.RecordBatch:
            left, n_sim, count, right = (np.concatenate(c) for c in zip(*held, strict=True))
            js = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), yi.take(pa.array(right)))
            return pa.RecordBatch.from_arrays([group.take(pa.array(np.zeros(len(left), np.int64))), xi.take(pa.array(left)), pa.array(n_sim, pa.int32()), js], names)

        for s in range(0, len(xi), step):
            e, first = min(s + step, len(xi)), s if within else 0  # of one part, only those of larger ids
            total = _equal_places(flank_x[:, s:e], flank_y[:, first:])
            if apart:
                total *= (org_x[s:e, None] != org_y[first:]).view(np.uint8)
            if not level:
                a, b = width_x[s:e, None], width_y[first:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    total *= (np.abs(a - b) <= limit if limit >= 1 else np.abs(a - b) / np.minimum(a, b) <= limit).view(np.uint8)
            if within:
                upto = int(np.searchsorted(rank, rank[e - 1], "right")) - first  # those beyond are larger than all of x
                total[:, :upto] *= (rank[s:e, None] < rank[first : first + upto]).view(np.uint8)
            flat, line = total.ravel(), np.arange(e - s + 1) * total.shape[1]
            for v in range(1, len(flank_x) + 1):
                at = np.flatnonzero(flat == v)
                if len(at):
                    count = np.diff(np.searchsorted(at, line))
                    at -= np.repeat(line[:-1] - first, count)
                    has = np.flatnonzero(count)
                    held.append((has + s, np.full(len(has), v, np.int32), count[has], at))
                    n_held += len(at)
            if n_held >= BATCH:
                yield sent()
                held, n_held = [], 0
        if held:
            yield sent()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cut = np.zeros(n - 1, bool)
            for c in batch.columns[:5]:
                cut |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                key = tuple(c[s].as_py() for c in batch.columns[:5])
                if held and key != now:
                    yield from met(held[0].column(0)[:1], not now[2] and now[3] == now[4], pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(s, e - s))
        if held:
            yield from met(held[0].column(0)[:1], not now[2] and now[3] == now[4], pa.Table.from_batches(held))

    return run


def _meetings(f: DataFrame, apart: bool, limit: float) -> tuple[DataFrame, list[str]]:
    """A row for each gene and meeting of parts that it is in, and the columns that name a meeting."""
    own = (f.filter("org_id IS NOT NULL") if apart else f).filter("group_id IS NOT NULL AND gene_id IS NOT NULL AND width IS NOT NULL").select("group_id", "gene_id", "org_id", F.col("width").cast("double").alias("width"), "flank").withColumn("_band", width_band(F.col("width"), limit))
    sizes = own.groupBy("group_id", "_band").agg(F.ceil(F.count("*") / PART).cast("int").alias("_n"))
    near = [sizes.select("group_id", (F.col("_band") - by).alias("_band"), F.col("_n").alias(name)) for by, name in (((1, "_after"), (-1, "_before")) if limit > 0 else ())]
    dealt = own.join(sizes, ["group_id", "_band"])
    for x in near:
        dealt = dealt.join(x, ["group_id", "_band"], "left")
    p = F.pmod(F.xxhash64("gene_id"), F.col("_n")).cast("int")

    def meetings(first: Column, last: Column, of) -> Column:
        """``of`` each part from first up to last, none if there is none."""
        return F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), of)

    def at(band: Column, next_: int, p: Column, q: Column, side: int) -> Column:
        return F.struct(band.alias("_band"), F.lit(next_).alias("_next"), p.alias("_p"), q.alias("_q"), F.lit(side).alias("_side"))

    zero, band, mine = F.lit(0), F.col("_band"), F.col("_mine")
    where = [meetings(mine, F.col("_n") - 1, lambda q: at(band, 0, mine, q, 0)), meetings(zero, mine - 1, lambda q: at(band, 0, q, mine, 1))]
    if limit > 0:
        where += [meetings(zero, F.coalesce("_after", zero) - 1, lambda q: at(band, 1, mine, q, 0)), meetings(zero, F.coalesce("_before", zero) - 1, lambda q: at(band - 1, 1, q, mine, 1))]
    key = ["group_id", "_band", "_next", "_p", "_q"]
    rows = dealt.withColumn("_mine", p).select("group_id", F.explode(F.concat(*where)).alias("_at"), "gene_id", "org_id", "width", "flank").select("group_id", "_at.*", "gene_id", "org_id", "width", "flank")
    return rows, key


def neighborhood_similarity_of(f: DataFrame, force_paralogues: bool, max_length_dif: float) -> DataFrame:
    """X3 for genes that already have their ``flank``.

    A group's genes of one band of widths, cut as in :func:`band_pairs`, are dealt into parts of some PART; two parts of
    a band, or of it and the next, meet in a task, where all their pairs are compared at once, so a large group is many keys.
    """
    spark = f.sparkSession
    rows, key = _meetings(f, force_paralogues, max_length_dif)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    kind = dict(f.dtypes)
    names = ["group_id", "i", "n_sim", "j"]
    found = rows.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(_alike(max_length_dif, force_paralogues, names), f"group_id {kind['group_id']}, i {kind['gene_id']}, n_sim int, j array<{kind['gene_id']}>")
    return found.select("group_id", "i", F.explode("j").alias("j"), "n_sim").select("group_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "n_sim")


def potentials(genes: DataFrame, pending: DataFrame) -> DataFrame:
    """(group_id) of pending groups with no pending group upstream, or none downstream."""
    near = neighbors(genes, "group_id", stranded=True)
    wait = pending.select(F.col("group_id").alias("g"), F.lit(1).alias("waits"))
    own = genes.select("gene_id", "group_id").join(pending, "group_id", "left_semi").join(near, "gene_id")
    sides = own.join(wait.toDF("down", "d"), "down", "left").join(wait.toDF("up", "u"), "up", "left")
    return sides.groupBy("group_id").agg(F.max(F.coalesce("d", F.lit(0))).alias("d"), F.max(F.coalesce("u", F.lit(0))).alias("u")).filter("d = 0 OR u = 0").select("group_id")


def neighborhood_split(genes: DataFrame, *, flank_size: int = 4, force_paralogues: bool = True, k: int = 5, limit: float = 0.5, max_length_dif: float = 0.1, guide: str | None = None, merge: bool = True, rounds: int = 1000) -> DataFrame:
    """``genes`` with refined group_id (X7): presplit by length, split groups without paralogues, then those with
    paralogues in rounds (each sees the ids of the round before), then merge groups of like neighborhood (X8).
    """
    how = {"flank_size": flank_size, "force_paralogues": force_paralogues, "k": k, "limit": limit, "max_length_dif": max_length_dif, "guide": guide}

    def regroup(g: DataFrame, roots: DataFrame) -> DataFrame:
        """Genes of split groups get the id of their root gene, kept apart from other ids."""
        new = roots.select("gene_id", (-F.col("root") - 1).alias("_new"))
        return materialize(g.join(new, "gene_id", "left").withColumn("group_id", F.coalesce("_new", "group_id")).drop("_new"), "split")

    pre = width_components(genes, max_length_dif).withColumnRenamed("component", "root")
    now = materialize(genes.drop("group_id").join(number_groups(pre), "gene_id"), "presplit")
    many = now.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select("group_id")
    para = with_paralogues(now)
    easy = many.join(para.filter("NOT has_paralogues"), "group_id", "left_semi")
    pending = materialize(many.join(para.filter("has_paralogues"), "group_id", "left_semi"), "pending")
    now = regroup(now, neighbor_split(now, easy, **how))
    stalls = 0
    for _ in range(rounds):
        if pending.isEmpty():
            break
        take = materialize(potentials(now, pending), "take")
        if take.isEmpty():
            stalls += 1
            sizes = now.join(pending, "group_id", "left_semi").groupBy("group_id").agg(F.count("*").alias("n"))
            take = pending if stalls > 5 else materialize(sizes.orderBy("n", "group_id").limit(10).select("group_id"), "take")
        now, pending = regroup(now, neighbor_split(now, take, **how)), materialize(pending.join(take, "group_id", "left_anti"), "pending")
    ids = number_groups(now.select("gene_id", F.col("group_id").alias("root")))
    now = materialize(now.drop("group_id").join(ids, "gene_id"), "renumbered")
    return neighborhood_merge(now) if merge else now


def merge_candidates(genes: DataFrame) -> DataFrame:
    """(a, b) of groups that share a neighbor set of a branching vertex (degree > 2)."""
    knots = degrees(pc_edges(genes, slim=True)).filter("degree > 2").select("group_id")
    near = neighbors(genes, "group_id", stranded=True).join(genes.select("gene_id", "group_id"), "gene_id").join(knots, "group_id", "left_semi")
    sides = near.select("group_id", F.explode(F.array(F.struct(F.lit("down").alias("side"), F.col("down").alias("g")), F.struct(F.lit("up").alias("side"), F.col("up").alias("g")))).alias("s")).select("group_id", "s.side", "s.g").filter("g IS NOT NULL").distinct()
    a, b = sides.withColumnRenamed("g", "a"), sides.withColumnRenamed("g", "b")
    return a.join(b, ["group_id", "side"]).filter("a < b").select("a", "b").distinct()


def neighborhood_merge(genes: DataFrame, options: IdentityOptions = IdentityOptions(c=0.9, k=5)) -> DataFrame:
    """Merge groups that share a neighborhood and whose longest members are one identity cluster, until none is left."""
    turn = 0
    while True:
        pairs = materialize(merge_candidates(genes), "merge")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("group_id")).distinct()
        reps = representatives(genes, "longest").join(wanted, "group_id", "left_semi").join(genes.select("gene_id", "sequence"), "gene_id")
        label = identity_clusters(reps, options).join(reps.select("gene_id", "group_id"), "gene_id").select("group_id", "leader")
        like = pairs.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").filter("la = lb")
        # one partner each: a pair stands if it is the first of both its groups, in an order drawn anew in each round, so one at least does
        drawn = materialize(like.select("a", "b", F.struct(F.xxhash64("a", "b", F.lit(turn)).alias("h"), "a", "b").alias("p")), "drawn")
        first = drawn.select(F.explode(F.array("a", "b")).alias("g"), "p").groupBy("g").agg(F.min("p").alias("p"))
        both = first.groupBy("p").agg(F.count("*").alias("n")).filter("n = 2")
        chosen = materialize(both.select(F.col("p.b").alias("group_id"), F.col("p.a").alias("_into")), "chosen")
        if chosen.isEmpty():
            return genes
        genes = materialize(genes.join(chosen, "group_id", "left").withColumn("group_id", F.coalesce("_into", "group_id")).drop("_into"), "merged")
        turn += 1


def paralogue_links(genes: DataFrame, k: int = 5, limit: float = 0.5, algorithm: str = "infomap", rescale: bool = True, seed: int = 0) -> DataFrame:
    """(group_id, paralogue): communities of groups whose representatives are alike."""
    reps = representatives(genes, "random", seed).join(genes.select("gene_id", "sequence"), "gene_id")
    edges = transform_sim(similar_pairs(reps, k, limit), limit, rescale)
    found = graph_grouping(reps, edges, algorithm)
    return reps.select("gene_id", "group_id").join(found.withColumnRenamed("group_id", "paralogue"), "gene_id").select("group_id", "paralogue")


def collapse_paralogues(genes: DataFrame, links: DataFrame) -> DataFrame:
    """``genes`` regrouped by paralogue link (group_id, paralogue) (X10); metadata: merge_info or largest_info by the same link."""
    joined = genes.join(links, "group_id")
    return joined.drop("group_id").withColumnRenamed("paralogue", "group_id")
