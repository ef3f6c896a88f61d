"""SimHash near-dedup by multi-index hashing.

A text's fingerprint has a bit where over half of its 3-word shingles' XXH64 have
it.  Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit
of one 32-bit half.  So the table holds each distinct fingerprint under both
halves, and each fingerprint also probes the halves of the Hamming ball around its
own: those with one of its set bits cleared, which is enough, as of two halves that
differ in one bit one has it set.  Whoever meets under a key is compared on all 64
bits.

Plan.  Copies collapse to one distinct fingerprint before anything else.  Keys are
dealt out by hash and sorted; a run of equal keys without an owner is skipped, any
other gives a spanning forest of its true links (never all pairs), found by breadth
first search with array comparisons; a run of over LARGE fingerprints is split
again by the halves of the other 32 bits.  Components come from alternating stars,
and rows look up theirs by fingerprint.

:func:`similar_duplicates` is the verified form: components of 0.8 or more in the Jaccard similarity of
5-word shingle sets, without loss.  Links of 5-word fingerprints come first, confirmed on the sets.  What
is out of their reach meets under a shingle: of a set of n, the first n - ceil(0.8 n) + 1 in any one order
must hold a common one, and from there on there must be as many left in both as two similar sets share.  The order is
frequent shingles last, so runs are short; a set is first compared with one member of its runs, one that has few rare
shingles as an unedited copy has, and all of a run only across components that are still apart, where parity maps of the
sets do not show that they differ too much.  A set's name is a 64-bit hash of it,
and sets are compared by 48 bits of each shingle, read again from the texts of candidate pairs only.

Defined cases: null or empty text, or white space only, has fingerprint zero and
links like any other; fewer than 3 words are one shingle; equal rows share their
component; a null id counts only where a component has no other; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.components import component_roots
from . import store
from .bloom_lm import Tally
from .packed import expand, gaps, squeeze
from .ragged import chain, distinct, lowered, tidy, word_runs

SEED, SHINGLE, NEAR = 42, 3, 3
#: Shingles hashed at once; fingerprints of a run compared without a further index.
PART, LARGE = 1 << 16, 4096
#: Words of a shingle and Jaccard similarity of :func:`similar_duplicates`; shingles that are known as frequent.
WIDTH, SIMILAR, FREQUENT = 5, 0.8, 1 << 20
#: Copies that a task remembers, beyond which it repeats some; distinct shingles of a stretch; parts in which shingles are shuffled;
#: turns in which a set is compared with one other before runs are compared in full.
SEEN, STRETCH, PASSES, TURNS = 1 << 18, 1 << 18, 2, 2
#: 64-bit words of a set's parity map.
MAP = 16


def bit_counts(digests: bytes) -> np.ndarray:
    """How many of the 8-byte digests have each bit, most significant first."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a lower-cased text."""
    words = text.split()
    n = len(words) - width + 1
    if not words:
        return 0
    if n <= 1:
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), SEED), "big", signed=True)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        part = words[at : min(at + PART, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        counts += bit_counts(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))))
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([fingerprint(t) for t in lowered(batch.column(3))], pa.int64())], ["k", "l", "id", "fp"])


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the true links among distinct fingerprints."""
    out, rest = [], fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            ahead, found = [], np.zeros(len(rest), bool)
            for f in front:
                hit = ~found
                hit[hit] = np.bitwise_count(rest[hit] ^ f) <= NEAR
                if hit.any():
                    ahead.append(rest[hit])
                    out.append((np.full(len(ahead[-1]), f), ahead[-1]))
                    found |= hit
            front, rest = (np.concatenate(ahead) if ahead else rest[:0]), rest[~found]
    return out


def _keys(half: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, owner): each half, and it with one set bit cleared."""
    key, at, owner = [half], [np.arange(len(half))], [np.ones(len(half), bool)]
    for b in range(bits):
        has = np.flatnonzero(half >> np.uint64(b) & np.uint64(1))
        key.append(half[has] ^ np.uint64(1 << b))
        at.append(has)
        owner.append(np.zeros(len(has), bool))
    return np.concatenate(key), np.concatenate(at), np.concatenate(owner)


def run_links(fps: np.ndarray, half: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within a run that met under a key of ``half`` (0: low 32 bits); a large run goes by the other half's quarters."""
    fps = np.unique(fps)
    if len(fps) <= LARGE:
        return forest(fps)
    out = []
    other = (fps >> np.uint64(0 if half else 32)) & np.uint64(0xFFFFFFFF)
    for shift in (0, 16):
        key, at, owner = _keys((other >> np.uint64(shift)) & np.uint64(0xFFFF), 16)
        order = np.argsort(key, kind="stable")
        key, at, owner = key[order], at[order], owner[order]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a > 1 and owner[a:b].any():
                out += forest(np.unique(fps[at[a:b]]))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (half, key, fp, owner) sorted by half and key; runs may go on over batches."""

    def emit(half: np.ndarray, key: np.ndarray, fp: np.ndarray, owner: np.ndarray) -> pa.RecordBatch | None:
        edge = np.concatenate(([True], (key[1:] != key[:-1]) | (half[1:] != half[:-1]), [True]))
        cut = np.flatnonzero(edge)
        size, owned = np.diff(cut), np.add.reduceat(owner.astype(np.int64), cut[:-1])
        out = []
        two = cut[:-1][(size == 2) & (owned > 0)]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= NEAR]
        out.append((fp[near], fp[near + 1]))
        many = np.flatnonzero((size > 2) & (owned > 0))
        for a, b in zip(cut[many].tolist(), cut[many + 1].tolist(), strict=True):
            out += run_links(fp[a:b], int(half[a]))
        u, v = (np.concatenate([e[k] for e in out]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]) if len(u) else None

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        half, key, fp, owner = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        now = (half, key, fp.view(np.uint64), owner.astype(bool))
        if held and (held[0][1][0], held[0][0][0]) == (key[-1], half[-1]):
            held.append(now)
            continue
        # all before the last key can be told; the last key's rows wait
        last = int(np.flatnonzero((key != key[-1]) | (half != half[-1]))[-1]) + 1 if ((key != key[-1]) | (half != half[-1])).any() else 0
        done = [*held, tuple(x[:last] for x in now)]
        held = [tuple(x[last:] for x in now)]
        if (out := emit(*(np.concatenate(x) for x in zip(*done, strict=True)))) is not None:
            yield out
    if held and (out := emit(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
        yield out


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): true links between distinct fingerprints ``fp``, enough to connect all that are linked."""
    halves = F.array(*[F.struct(F.lit(k).alias("half"), (F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))).alias("own")) for k in (0, 1)])
    sides = distinct.select("fp", F.explode(halves).alias("s")).select("fp", "s.half", "s.own")
    ball = F.expr("filter(transform(sequence(0, 31), b -> if((shiftright(own, b) & 1L) = 1L, own ^ shiftleft(1L, b), -1L)), k -> k >= 0)")
    probes = sides.select("half", F.explode(ball).alias("key"), "fp", F.lit(False).alias("owner"))
    met = sides.select("half", F.col("own").alias("key"), "fp", F.lit(True).alias("owner")).unionByName(probes)
    return met.repartition("half", "key").sortWithinPartitions("half", "key").mapInArrow(_links, "u long, v long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, l, id, text) of every row."""
    return docs.select(*store.row_keys(F.col(id_col), F.col(text_col)), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _near_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables (k, l, id, fp) of every row of (k, l, id, text) and (fp, root) of every fingerprint."""
    kind = dict(rows.dtypes)["id"]
    fps = store.keep(rows.mapInArrow(tidy(_fingerprints), f"k long, l long, id {kind}, fp long"), "fingerprints")
    distinct = store.keep(fps.select("fp").distinct(), "distinct")
    roots = component_roots(links(distinct))
    classes = store.keep(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "classes")
    store.drop(distinct, roots)
    return fps, classes


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    fps, classes = _near_classes(docs.select(*[F.lit(0).cast("long").alias(c) for c in ("k", "l")], F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    least = fps.groupBy("fp").agg(F.min("id").alias("least")).join(classes, "fp")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = store.keep(classes.join(named, "root").select("fp", "component_id"), "named")
    store.drop(classes)
    return fps.join(named, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _one_of_each(docs: DataFrame, of: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row for each class of ``of`` (k, l, id, root): the smallest id's."""
    first = of.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "l")).alias("first"))
    lost = store.keep(of.join(first, "root").filter("k <> first.k OR l <> first.l").select("k", "l").distinct(), "lost")
    repeated = of.groupBy("k", "l").agg(F.count("*").alias("n")).filter("n > 1").select("k", "l")
    repeated = store.keep(repeated, "repeated")
    store.drop(of)
    return store.kept_rows(docs, store.row_keys(F.col(id_col), F.col(text_col)), lost, repeated)


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component only: the smallest id's; of rows with that id (in any number, of any text) one."""
    digests, classes = _near_classes(_rows(docs, id_col, text_col))
    member = store.keep(digests.join(classes, "fp").select("k", "l", "id", "root"), "near")
    store.drop(digests, classes)
    return _one_of_each(docs, member, id_col, text_col)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """``(from, to, sets)`` for runs of texts: each text's distinct shingles, ascending."""
    for i, j, h, first in word_runs(texts):
        found = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = min(width, b - a)
            g = h[a : b - n + 1] if n else h[:0]
            for k in range(1, n):
                g = chain(g, h[a + k : b - n + 1 + k])
            found.append(distinct(g))
        yield i, j, found


def _own(g: np.ndarray) -> int:
    """A set's name."""
    return int.from_bytes(xxhash.xxh64_digest(g.tobytes(), SEED), "big", signed=True)


def parity(g: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * MAP classes of shingles: whether the set has an odd number of it.  Sets that differ in d shingles have maps that differ in d bits at most."""
    odd = np.bincount(((g >> np.uint64(20)) % np.uint64(64 * MAP)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _digests(width: int, id_type: pa.DataType):
    """For each text its keys, id, the name of its set and its fingerprint; and shingles (in place of k) with their number
    where seen three times or more within a stretch, on which only an order depends, never a result."""
    names = ["k", "l", "id", "own", "fp", "n", "map"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(STRETCH)

        def often() -> pa.RecordBatch:
            keys, n = tally.take()
            keys, n = keys[n > 2], n[n > 2]
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), none, pa.nulls(len(n), id_type), none, none, pa.array(n), pa.nulls(len(n), pa.list_(pa.int64()))], names)

        for batch in batches:
            texts = lowered(batch.column(3))
            for i, j, found in shingle_sets(texts, width):
                own, fps = [_own(g) for g in found], [fingerprint(t, width) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(own, pa.int64()), pa.array(fps, pa.int64()), pa.nulls(j - i, pa.int64()), pa.array([parity(g) for g in found], pa.list_(pa.int64()))], names)
                for g in found:
                    if tally.add(g):
                        yield often()
        yield often()

    return run


def _prefixes(frequent, width: int, similar: float):
    """(s, own, n, at): the first shingles of each set, frequent ones last, and their places; a copy that the task has seen is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = frequent.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, found in shingle_sets(lowered(batch.column(0)), width):
                s, own, n = [np.empty(0, np.uint64)], [], []
                for g in found:
                    name = _own(g)
                    if not len(g) or name in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(name)
                    at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
                    last = np.where(keys[at] == g, rank[at], 0) if len(keys) else np.zeros(len(g), np.int64)
                    s.append(g[np.lexsort((g, last))][: len(g) - int(np.ceil(similar * len(g) - 1e-9)) + 1])
                    own.append(name)
                    n.append(len(g))
                times = [len(x) for x in s[1:]]
                at = np.concatenate([np.empty(0, np.int32), *(np.arange(x, dtype=np.int32) for x in times)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s).view(np.int64)), pa.array(np.repeat(np.array(own, np.int64), times)), pa.array(np.repeat(np.array(n, np.int32), times)), pa.array(at)], ["s", "own", "n", "at"])

    return run


def _packed_sets(width: int):
    """(own, set): each set as ascending 48-bit numbers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in shingle_sets(lowered(batch.column(1)), width):
                packed = [squeeze(gaps(distinct(g >> np.uint64(16)))) for g in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, pa.binary())], ["own", "shingles"])

    return run


def wide_map(g: np.ndarray) -> bytes:
    """A set's parity map of as many bits as it has shingles, rounded up to a power of two, 64 at least."""
    bits = max(64, 1 << (len(g) - 1).bit_length()) if len(g) else 64
    odd = np.bincount((g & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two wide maps differ, the larger folded to the smaller's bits: no more than their sets differ in shingles."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    small = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, small), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _wide_maps(width: int):
    """(own, n, wide): size and wide parity map of each set of 48-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in shingle_sets(lowered(batch.column(1)), width):
                sets = [distinct(g >> np.uint64(16)) for g in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(g) for g in sets], pa.int64()), pa.array([wide_map(g) for g in sets], pa.binary())], ["own", "n", "wide"])

    return run


def _may_be_alike(similar: float):
    """(u, v) of the rows (u, v, nu, nv, wu, wv) whose wide maps do not show that they differ too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nu, nv, wu, wv = (batch.column(c).to_pylist() for c in range(2, 6))
            good = [k for k in range(batch.num_rows) if differing(wu[k], wv[k]) <= (1 - similar) / (1 + similar) * (nu[k] + nv[k]) + 1e-6]
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["u", "v"])

    return run


def _alike(similar: float):
    """(u, v) of the rows (u, v, su, sv) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = (np.cumsum(expand(x, np.uint64)[0], dtype=np.uint64) for x in (a, b))
                both = np.intersect1d(a, b, assume_unique=True).size
                if both >= similar * (len(a) + len(b) - both) - 1e-9:
                    good.append(k)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["u", "v"])

    return run


def _similar_classes(rows: DataFrame, width: int, similar: float) -> DataFrame:
    """(k, l, id, root) for every row of ``rows`` (k, l, id, text), which must be the same whenever read."""
    spark = rows.sparkSession
    kind, id_type = dict(rows.dtypes)["id"], to_arrow_type(rows.schema["id"].dataType)
    found = store.keep(rows.mapInArrow(tidy(_digests(width, id_type)), f"k long, l long, id {kind}, own long, fp long, n long, map array<long>"), "digests")
    digests = found.filter("n IS NULL").select("k", "l", "id", "own", "fp", "map")
    reps = store.keep(digests.groupBy("own").agg(F.min(F.struct("k", "l", "fp", "map")).alias("r")).select("own", "r.k", "r.l", "r.fp", *[F.col("r.map")[w].alias(f"m{w}") for w in range(MAP)]), "reps")

    def may_reach(n: str, at: str, m: str, to: str) -> Column:
        """Sets of these sizes whose first common shingle has these places may be similar enough: so many shingles are left from there on."""
        return F.least(F.col(n) - F.col(at), F.col(m) - F.col(to)) >= F.lit(similar / (1 + similar)) * (F.col(n) + F.col(m)) - 1e-6

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar enough; only texts that are in a pair are read again."""
        pairs = store.keep(pairs, "pairs")

        def of_texts(some: DataFrame, make, columns: str, label: str) -> tuple[DataFrame, DataFrame]:
            """What ``make`` gives of each set in a pair, once."""
            own = some.select(F.col("u").alias("own")).union(some.select("v")).distinct()
            wanted = store.keep(reps.join(own, "own", "left_semi").select("own", "k", "l"), "wanted")
            texts = rows.select("k", "l", "text").join(store.small(wanted), ["k", "l"]).select("own", "text")
            return wanted, store.keep(texts.mapInArrow(tidy(make(width)), f"own long, {columns}").dropDuplicates(["own"]), label)

        # most pairs are of unrelated texts, which their wide maps show; only the sets of the others, many times larger, are sent with each pair
        wanted, maps = of_texts(pairs, _wide_maps, "n long, wide binary", "maps")
        a, b = (maps.toDF(x, f"n{x}", f"w{x}") for x in ("u", "v"))
        met = pairs.join(a, "u").join(b, "v").select("u", "v", "nu", "nv", "wu", "wv")
        near = store.keep(met.mapInArrow(tidy(_may_be_alike(similar)), "u long, v long"), "maybe")
        store.drop(pairs, wanted, maps)
        wanted, sets = of_texts(near, _packed_sets, "shingles binary", "sets")
        a, b = (sets.toDF(x, f"s{x}") for x in ("u", "v"))
        met = near.join(a, "u").join(b, "v").select("u", "v", "su", "sv")
        out = store.keep(met.mapInArrow(tidy(_alike(similar)), "u long, v long"), "close")
        store.drop(near, wanted, sets)
        return out

    def now(root: DataFrame | None, close: DataFrame) -> DataFrame:
        """(own, root) with more links."""
        links = close if root is None else close.unionByName(root.filter("own <> root").select(F.col("own").alias("u"), F.col("root").alias("v")))
        found = component_roots(links)
        new = store.keep(reps.select("own").join(found, F.col("own") == F.col("node"), "left").select("own", F.coalesce("root", "own").alias("root")), "roots")
        store.drop(close, found, *([root] if root is not None else []))
        return new

    # sets of one fingerprint are linked to the first of them, fingerprints to each other
    heads = store.keep(reps.groupBy("fp").agg(F.min("own").alias("head")), "heads")
    same = reps.join(heads, "fp").filter("own <> head").select(F.col("own").alias("u"), F.col("head").alias("v"))
    met = links(heads.select("fp")).join(heads.toDF("u", "hu"), "u").join(heads.toDF("v", "hv"), "v").select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    root = now(None, confirmed(same.unionByName(met).distinct()))
    store.drop(heads)

    often = found.filter("n IS NOT NULL").groupBy(F.col("k").alias("s")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    s, n = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    order = np.argsort(s)
    frequent = spark.sparkContext.broadcast((s[order], n[order]))
    prefixes = store.keep(rows.select("text").mapInArrow(tidy(_prefixes(frequent, width, similar)), "s long, own long, n int, at int"), "prefixes")
    frequent.unpersist()

    def open_runs(turn: int) -> DataFrame:
        """(s, own, n, at, root, head): runs of a part of the shingles that reach over several components, each with a head:
        in the first turn the member that has fewest rarer shingles, then one drawn anew for each turn."""
        part = prefixes.filter(F.pmod("s", F.lit(PASSES)) == turn % PASSES).join(root, "own")
        first = F.xxhash64("own", F.lit(turn)) if turn else F.col("at").cast("long")
        runs = part.groupBy("s").agg(F.min(F.struct(first.alias("first"), "own", "n", "at", "root")).alias("head"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
        return part.join(runs.select("s", "head"), "s")

    for turn in range(TURNS):  # each set is compared with the one head that it meets most often; what is linked needs no comparison in the next turn
        star = open_runs(turn).filter("root <> head.root").filter(may_reach("n", "at", "head.n", "head.at")).groupBy("own", F.col("head.own").alias("v")).agg(F.count("*").alias("times"))
        best = star.groupBy("own").agg(F.max(F.struct("times", "v"))["v"].alias("v"))
        root = now(root, confirmed(best.select(F.col("own").alias("u"), "v")))
    # what is still apart is compared in full
    maps = [f"m{w}" for w in range(MAP)]
    parts = [store.keep(open_runs(p).select("s", "own", "n", "at", "root").dropDuplicates(["s", "own"]).join(reps.select("own", *maps), "own").select("s", "own", "n", "at", "root", *maps), "open") for p in range(PASSES)]
    store.drop(prefixes)
    a = reduce(DataFrame.unionByName, parts).toDF("s", "u", "nu", "au", "ru", *[f"u{m}" for m in maps])
    b = a.toDF("s", "v", "nv", "av", "rv", *[f"v{m}" for m in maps])
    # as many shingles at least are in one set only as bits of the parity maps differ
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"u{m}").bitwiseXOR(F.col(f"v{m}"))) for m in maps])
    may_be = may_reach("nu", "au", "nv", "av") & (apart <= F.lit((1 - similar) / (1 + similar)) * (F.col("nu") + F.col("nv")) + 1e-6)
    met = a.join(b, (a["s"] == b["s"]) & (F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & may_be)
    root = now(root, confirmed(met.select("u", "v").distinct()))
    store.drop(*parts)
    out = store.keep(digests.join(root, "own").select("k", "l", "id", "root"), "similar")
    store.drop(root, reps, found)
    return out


def similar_duplicates(docs: DataFrame, *, width: int = WIDTH, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row: components of ``similar`` or more in the Jaccard similarity of shingle sets."""
    member = _similar_classes(_rows(docs, id_col, text_col), width, similar)
    least = member.groupBy("root").agg(F.min("id").alias("component_id"))
    return member.join(least, "root").select(F.col("id").alias("doc_id"), "component_id")


def drop_similar(docs: DataFrame, *, width: int = WIDTH, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of :func:`similar_duplicates` only: the smallest id's; of several rows with that id one."""
    member = _similar_classes(_rows(docs, id_col, text_col), width, similar)
    return _one_of_each(docs, member, id_col, text_col)
