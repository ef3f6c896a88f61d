"""LM scoring with a log-frequency Bloom filter.

Tokens are words and one end for each text.  A count c is held as its level
1 + floor(log(c / least) / log STEP): the filter gets one entry (n-gram, j) for every j up to
the level, and a lookup probes from the first entry on until one is missing.  Probabilities interpolate the orders:

    p1(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p_n(w|h)  = (max(c(hw) - D, 0) + B(h) p_(n-1)(w|h')) / c(h)
    B(h)      = D T(h) + c(h) - K(h)

(absolute discounting), where T(h) is the number of held n-grams hw and K(h) the occurrences of h
before one, so what is not held goes to the lower order and probabilities add up to one but for
the rounding of counts.  B(h) is held as the level of c(h) / B(h).  Levels that no whole count has get no entry.

Plan.  Every n-gram that occurs is held, at every corpus size (``share`` asks for fewer: those that
make up at least 1/2**share of the N tokens).  Nothing that grows with the corpus is broadcast or
sent to the driver.  An n-gram goes to a bucket, a range of its hash, whose number grows with the
corpus, and is told from the others there by 32 more bits, which err less often than the filter does.  Map tasks
send compressed arrays of distinct n-grams with their contexts; the task that adds a bucket up makes
its segment of the filter, and contexts' T and K are added up by bucket again.  Texts are scored in
blocks of about BLOCK tokens, written once: a block asks each bucket for its distinct n-grams, the bucket probes
its segment and answers one byte of level for each (and words' exact counts), and the block, which
knows its own hashes, puts the answers back in place by their order.  Buckets are asked in PASSES
parts, one after the other, so that only a part of the questions is on the way at once.

Defined cases: null and empty texts are the end alone; with no training rows N and V are 0 and
every token has the base probability of an unseen one; a null id is in the training part; equal rows
count each; a text longer than a block is a block of its own; other columns are ignored.  Words' exact counts go by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .packed import expand, gaps, squeeze
from .ragged import chain, distinct, lowered, mix, ranks, tidied, tidied_pair, tidy, word_runs

ORDER, STEP, D = 3, 2**0.25, 0.75
END = np.uint64(0xE7D5C3B1A5F70E4D)
#: Bits of the filter for each entry; tokens of a bucket, taken as 4 bytes of text each.
ROOM, BUCKET = 16, 1 << 20
HELD = 1 << 20
#: Tokens of a block of texts that is scored at once, taken as 4 bytes each; parts in which buckets are asked.
BLOCK, PASSES = 1 << 20, 2
#: Keys whose entries are set at once.
CHUNK = 1 << 18
#: Texts lower-cased at once.
ROWS = 512


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The segment that a key belongs to: a range of hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def level_of(values: np.ndarray, least: float) -> np.ndarray:
    c = np.maximum(np.asarray(values, float) / least, 1.0)
    return 1 + np.floor(np.log(c) / np.log(STEP) + 1e-9).astype(np.int64)


def entry(keys: np.ndarray, j: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in its segment (32 bits of a fraction) and which 4 bits of a word stand for (key, j)."""
    h = mix(keys + np.asarray(j, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    one, six = np.uint64(1), np.uint64(63)
    mask = (one << (h & six)) | (one << ((h >> np.uint64(6)) & six)) | (one << ((h >> np.uint64(12)) & six)) | (one << ((h >> np.uint64(18)) & six))
    return h >> np.uint64(32), mask


#: Levels that a whole count can have, and for each level the number of those up to it.
RUNGS = np.union1d(level_of(np.arange(1, 64), 1.0), np.arange(int(level_of(np.array([64]), 1.0)[0]), 256))
RANK = np.searchsorted(RUNGS, np.arange(256), side="right")


def segment(keys: np.ndarray, values: np.ndarray, least: float, whole: bool = False) -> tuple[int, np.ndarray]:
    """The greatest number of entries of a key, and the words of one segment of the filter.  ``whole``: values are whole numbers, ``least`` is 1."""

    def ranks(at: int) -> np.ndarray:
        level = level_of(values[at : at + CHUNK], least)
        return RANK[level] if whole else level

    top, entries = 0, 0
    for at in range(0, len(keys), CHUNK):
        rank = ranks(at)
        top, entries = max(top, int(rank.max())), entries + int(rank.sum())
    words = np.zeros(max(1, entries * ROOM // 64), np.uint64)
    for at in range(0, len(keys), CHUNK):
        key, rank = keys[at : at + CHUNK], ranks(at)
        for j in range(1, int(rank.max()) + 1):
            if j > 1:
                key, rank = key[rank >= j], rank[rank >= j]
            place, mask = entry(key, j)
            np.bitwise_or.at(words, (place * np.uint64(len(words))) >> np.uint64(32), mask)
    return top, words


class LogBloom:
    """Quantised values (``least`` or more) of 64-bit keys: one array of 64-bit words, in segments by ranges of the keys."""

    def __init__(self, least: float, segments: dict[int, tuple[int, np.ndarray]], buckets: int, whole: bool = False):
        self.least, self.buckets, self.whole = float(least), buckets, whole
        self.top = max((t for t, _ in segments.values()), default=0)
        self.size = np.ones(buckets, np.uint64)
        for b, (_, words) in segments.items():
            self.size[b] = len(words)
        self.begin = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.uint64)
        self.words = np.zeros(int(self.size.sum()), np.uint64)
        for b, (_, words) in segments.items():
            self.words[int(self.begin[b]) : int(self.begin[b]) + len(words)] = words

    def has(self, keys: np.ndarray, j: int | np.ndarray = 1) -> np.ndarray:
        if not self.top:
            return np.zeros(len(keys), bool)
        place, mask = entry(keys, j)
        if self.buckets == 1:
            at = (place * self.size[0]) >> np.uint64(32)
        else:
            own = bucket_of(keys, self.buckets)
            at = self.begin[own] + ((place * self.size[own]) >> np.uint64(32))
        return self.words[at] & mask == mask

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, 0 if it isn't held."""
        rank, some = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for j in range(1, self.top + 1):  # from the first entry up, so that errors of many levels are rarer by a power
            some = some[self.has(keys[some], j)]
            if not len(some):
                break
            rank[some] = j
        return np.append(0, RUNGS)[rank] if self.whole else rank

    def values(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, 0 if it isn't held."""
        return values_of(self.levels(keys), self.least)


def values_of(levels: np.ndarray, least: float) -> np.ndarray:
    """The middle of each level (the least itself on the first), 0 for level 0."""
    each = np.arange(int(levels.max(initial=0)) + 1)
    low = least * STEP ** (each - 1.0)
    return np.where(each == 0, 0.0, np.where(each == 1, low, low * STEP**0.5))[levels]


class Tally:
    """Counts of keys within a task; gives them out when there are many."""

    def __init__(self, held: int = HELD):
        self.held = held
        self.raw: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.size, self.keys, self.n = 0, np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, weights: np.ndarray | None = None) -> bool:
        """Count each key once, or by its weight.  True if it is time to give out."""
        self.raw.append(keys)
        if weights is not None:
            self.weights.append(weights)
        self.size += len(keys)
        if self.size >= self.held:
            self.settle()
        return len(self.keys) >= self.held

    def settle(self) -> None:
        raw = np.concatenate([self.keys[:0], *self.raw])
        fresh, n = add_up(raw, np.concatenate(self.weights)) if self.weights else np.unique(raw, return_counts=True)
        self.keys, self.n = add_up(np.concatenate((self.keys, fresh)), np.concatenate((self.n, n)))
        self.raw, self.weights, self.size = [], [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        out = self.keys, self.n
        self.keys, self.n = self.keys[:0], self.n[:0]
        return out


def add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, tokens, first)`` for runs of texts, each text's words followed by END."""
    for at in range(0, len(column), ROWS):
        for i, j, h, first in word_runs(lowered(column.slice(at, ROWS))):
            yield at + i, at + j, np.insert(h, first[1:], END), first + np.arange(len(first))


def places(first: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def all_grams(t: np.ndarray, first: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2 to ``order``: ends, hashes and contexts' hashes of the n-grams within texts."""
    place, gram = places(first), t
    for k in range(2, order + 1):
        at = np.flatnonzero(place >= k - 1)
        longer = np.zeros(len(t), np.uint64)
        longer[at] = chain(gram[at - 1], t[at])
        yield at, longer[at], gram[at - 1]
        gram = longer


def cells(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket, and 32 bits that tell apart what is in it."""
    return (bucket_of(h, buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def cut_up(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of an ascending array."""
    if len(bucket):
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        yield from zip(bucket[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def with_contexts(keys: np.ndarray, contexts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`add_up` for keys that have a context each."""
    if not len(keys):
        return keys, contexts, n
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], contexts[order[first]], np.add.reduceat(n[order], first)


COUNTED = "bucket int, kind int, packed binary"


def _counted(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "packed"])


def _count(order: int, buckets: int):
    """Counts of words (kind 1: hashes, counts) and n-grams of 2 to ``order`` tokens (kind: length; contexts' cells, low bits, counts), packed by bucket."""

    def pack(k: int, keys: np.ndarray, contexts: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        if k == 1:
            return _counted([(b, 1, squeeze(gaps(keys[i:j]), n[i:j])) for b, i, j in cut_up(bucket_of(keys, buckets))])
        bucket = keys >> np.uint64(32)
        rows = []
        for b, i, j in cut_up(bucket):
            by = i + np.argsort(contexts[i:j])  # neighbouring contexts differ by little
            rows.append((b, k, squeeze(gaps(contexts[by]), keys[by].astype(np.uint32), n[by])))
        return _counted(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))
        held = {k: none for k in range(2, order + 1)}
        raw: dict[int, list[tuple[np.ndarray, ...]]] = {k: [] for k in held}
        size = dict.fromkeys(held, 0)
        words = Tally()

        def settle(k: int) -> None:
            held[k] = with_contexts(*(np.concatenate(x) for x in zip(held[k], *raw[k], strict=True)))
            raw[k], size[k] = [], 0

        for batch in batches:
            for _, _, t, first in tokens(batch.column(0)):
                if words.add(t):
                    keys, n = words.take()
                    yield pack(1, keys, keys, n)
                for k, (_, grams, contexts) in enumerate(all_grams(t, first, order), 2):
                    raw[k].append((cells(grams, buckets), cells(contexts, buckets), np.ones(len(grams), np.int64)))
                    size[k] += len(grams)
                    if size[k] >= HELD:
                        settle(k)
                        if len(held[k][0]) >= HELD:
                            # what has occurred again is likely to once more, and stays unless it is too much itself
                            again = held[k][2] > 1
                            again &= again.sum() <= HELD // 2
                            yield pack(k, *(x[~again] for x in held[k]))
                            held[k] = tuple(x[again] for x in held[k])
        keys, n = words.take()
        yield pack(1, keys, keys, n)
        for k in held:
            settle(k)
            yield pack(k, *held[k])

    return run


def unpack(parts: list[bytes], *types: type) -> list[np.ndarray]:
    """The arrays of many packs, end to end; the first of each pack is of gaps."""
    found = [expand(x, *types) for x in parts]
    first = [np.cumsum(x[0], dtype=types[0]) for x in found]
    return [np.concatenate([np.empty(0, types[0]), *first]), *(np.concatenate([np.empty(0, t), *(x[k] for x in found)]) for k, t in enumerate(types[1:], 1))]


#: kind 0: a bucket's segment, its words with exact counts, and the number of its tokens and words; 1: contexts with K, T and own counts.
MERGED = "kind int, bucket int, top int, bits binary, packed binary, tokens long, types long"
_MERGED = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _rows(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in schema.split(", ")])


def _merge(least: float, order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind").to_numpy(), table.column("bucket")[0].as_py()
        of = lambda k: table.filter(pa.array(kind == k)).column("packed").to_pylist()
        words, exact = add_up(*unpack(of(1), np.uint64, np.int64))
        some = exact >= least
        held, out = [((words[some] & np.uint64(0xFFFFFFFF)), exact[some])], []
        followed = [(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)]
        for k in range(2, order + 1):
            contexts, keys, n = unpack(of(k), np.uint64, np.uint32, np.int64)
            keys, contexts, n = with_contexts(keys, contexts, n)
            some = n >= least
            keys, contexts, n = keys[some].astype(np.uint64), contexts[some], n[some]
            held.append((keys, n))
            followed.append((contexts, n, np.ones(len(n), np.int64), np.zeros(len(n), np.int64)))
        if least > 1:  # else a context's own count is K
            for keys, n in held[:-1]:
                followed.append((keys | np.uint64(bucket << 32), *[np.zeros(len(n), np.int64)] * 2, n))
        contexts, *sums = (np.concatenate(x) for x in zip(*followed, strict=True))
        by = np.argsort(contexts)
        contexts = contexts[by]
        first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(by) else by
        if least > 1:
            sums = [np.add.reduceat(x[by], first) if len(by) else x for x in sums]
        else:  # each row is one n-gram
            sums = [np.add.reduceat(sums[0][by], first) if len(by) else by, np.diff(first, append=len(by)), np.zeros(len(first), np.int64)]
        contexts = contexts[first]
        for b, i, j in cut_up(contexts >> np.uint64(32)):
            out.append((1, b, 0, None, squeeze(gaps(contexts[i:j].astype(np.uint32)), *(x[i:j] for x in sums)), None, None))
        top, bits = segment(*(np.concatenate(x) for x in zip(*held, strict=True)), least, least == 1)
        out.append((0, bucket, top, bits.tobytes(), squeeze(gaps(words), exact), int(exact.sum()), len(words)))
        return _rows(out, _MERGED, MERGED)

    return run


#: what 0: the segment of a bucket's counts, and words with their exact counts; 1: the segment of c / B.
SEGMENTS = "bucket int, what int, top int, bits binary, packed binary"
_SEGMENTS = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _finish(least: float):
    def run(table: pa.Table) -> pa.Table:
        keys, followed, types, own = unpack(table.column("packed").to_pylist(), np.uint32, np.int64, np.int64, np.int64)
        by = np.argsort(keys)
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys[by]) != 0)))
        keys, (followed, types, own) = keys[by][first].astype(np.uint64), (np.add.reduceat(x[by], first) for x in (followed, types, own))
        # B: the context's count, less its held continuations but for their discounts
        n = own if least > 1 else followed
        left = n - followed + D * types
        some = (left > 0) & (n > left)
        top, bits = segment(keys[some], n[some] / left[some], 1.0)
        return _rows([(table.column("bucket")[0].as_py(), 1, top, bits.tobytes(), None)], _SEGMENTS, SEGMENTS)

    return run


class Model:
    """Sizes of the training part, and the table of the filter's segments by bucket."""

    def __init__(self, n: int, v: int, order: int, least: float, buckets: int, segments: DataFrame):
        self.n, self.v, self.order, self.least, self.buckets, self.segments = n, v, order, least, buckets, segments

    @property
    def total(self) -> float:
        return self.n + 0.5 * (self.v + 1)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(t) for _, _, t, _ in tokens(batch.column(0)))], pa.int64())], ["n"])


def train(rows: DataFrame, *, text_col: str = "text", order: int = ORDER, share: int | None = None) -> Model:
    """The model, from every row."""
    texts = rows.select(F.col(text_col).alias("text"))
    least = 1.0
    if share is not None:
        least = max(1.0, (texts.mapInArrow(_tokens, "n long").agg(F.sum("n")).first()[0] or 0) / 2**share)
    about = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / 4 + F.count("*")).first()[0]
    buckets = max(1, -(-int(about) // BUCKET))
    counted = texts.mapInArrow(tidy(_count(order, buckets)), COUNTED)
    merged = store.keep(counted.groupBy("bucket").applyInArrow(tidied(_merge(least, order, buckets)), MERGED), "merged")
    n, v = (int(x) for x in merged.filter("kind = 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first())
    back = merged.filter("kind = 1").select("bucket", "packed").groupBy("bucket").applyInArrow(tidied(_finish(least)), SEGMENTS)
    segments = store.keep(merged.filter("kind = 0").select("bucket", F.lit(0).alias("what"), "top", "bits", "packed").unionByName(back), "segments")
    store.drop(merged)
    return Model(n, v, order, least, buckets, segments)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, texts): ids and texts of about BLOCK tokens, as a compressed table."""
    number, size, held = TaskContext.get().partitionId() << 32, 0, []

    def out() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            for x in held:
                stream.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "texts"])

    for batch in batches:
        at = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            size += n // 4 + 1
            if size >= BLOCK:
                held.append(batch.slice(at, i + 1 - at))
                yield out()
                at, number, size, held = i + 1, number + 1, 0, []
        if at < len(batch):
            held.append(batch.slice(at))
    if held:
        yield out()


def _texts(blob: bytes) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """Ids of a block, and the runs of its tokens."""
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    ids, column = (table.column(k).chunk(0) if table.num_rows else pa.array([], table.schema.field(k).type) for k in (0, 1))
    return ids, [(t, first) for _, _, t, first in tokens(column)]


def _ask(order: int, buckets: int, part: int):
    """(block, bucket, keys): the block's distinct words, and low bits of its n-grams, in each bucket of the part."""
    mine = lambda keys, bucket: keys[bucket % np.uint64(PASSES) == part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found: list[list[np.ndarray]] = [[] for _ in range(order)]
                for t, first in _texts(blob.as_py())[1]:
                    found[0].append(mine(t, bucket_of(t, buckets)))
                    for k, (_, grams, _) in enumerate(all_grams(t, first, order), 1):
                        keys = cells(grams, buckets)
                        found[k].append(mine(keys, keys >> np.uint64(32)))
                keys = [distinct(np.concatenate([np.empty(0, np.uint64), *x])) for x in found]
                del found
                own = [bucket_of(keys[0], buckets), *(x >> np.uint64(32) for x in keys[1:])]
                asked = distinct(np.concatenate(own))
                cuts = [np.searchsorted(x, np.append(asked, np.uint64(buckets))) for x in own]
                keys = [keys[0], *(x.astype(np.uint32) for x in keys[1:])]
                packed = [squeeze(*(gaps(x[c[i] : c[i + 1]]) for x, c in zip(keys, cuts, strict=True))) for i in range(len(asked))]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(asked), pa.int64()), pa.array(asked.astype(np.int32)), pa.array(packed, pa.binary())], ["block", "bucket", "keys"])

    return run


ANSWERS = "block long, bucket int, told binary"


def _answer(least: float, order: int):
    kinds = [np.uint64, *[np.uint32] * (order - 1)]

    def run(asked: pa.Table, made: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _rows([], [pa.int64(), pa.int32(), pa.binary()], ANSWERS)
        # all blocks' questions are probed together, then dealt out again
        found = [expand(x, *kinds) for x in asked.column("keys").to_pylist()]
        told, ends = [], []
        segments = {r["what"]: r for r in made.to_pylist()}
        held, back = (LogBloom(x, {0: (r["top"], np.frombuffer(r["bits"], np.uint64))}, 1, whole) if (r := segments.get(w)) else None for w, x, whole in ((0, least, least == 1), (1, 1.0, False)))
        for k in range(order):
            keys = np.concatenate([np.cumsum(x[k], dtype=kinds[k]) for x in found])
            ends.append(np.cumsum([0, *(len(x[k]) for x in found)]))
            low = keys.astype(np.uint64) & np.uint64(0xFFFFFFFF)
            probe = lambda f: np.concatenate([np.empty(0, np.int64), *(f.levels(low[i : i + CHUNK]) for i in range(0, len(low), CHUNK))]).astype(np.uint8) if f else np.zeros(len(low), np.uint8)  # noqa: B023, E731
            told.append(probe(held))
            if k == 0:
                n = np.zeros(len(keys), np.int64)
                words, exact = unpack([segments[0]["packed"]], np.uint64, np.int64) if 0 in segments else (keys[:0], n[:0])
                if len(words):
                    at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
                    n = np.where(words[at] == keys, exact[at], 0)
                told.append(n)
                ends.append(ends[-1])
            if k < order - 1:
                told.append(probe(back))
                ends.append(ends[-1])
        rows = zip(asked.column("block").to_pylist(), asked.column("bucket").to_pylist(), strict=True)
        return _rows([(block, bucket, squeeze(*(x[e[i] : e[i + 1]] for x, e in zip(told, ends, strict=True)))) for i, (block, bucket) in enumerate(rows)], [pa.int64(), pa.int32(), pa.binary()], ANSWERS)

    return run


def _score(order: int, least: float, total: float, buckets: int):
    #: Of words: level, exact count and back-off; of longer n-grams level and back-off; of the longest the level.
    kinds = [np.uint8, np.int64, *[np.uint8] * (2 * order - 2)] if order > 1 else [np.uint8, np.int64]

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, runs = _texts(block.column("texts")[0].as_py())
        found = [expand(x, *kinds) for x in answers.sort_by("bucket").column("told").to_pylist()]
        flat = [np.concatenate([np.empty(0, t), *(x[k] for x in found)]) for k, t in enumerate(kinds)]
        none = np.empty(0, np.uint8)
        told = {1: (flat[0], flat[2] if order > 1 else none, flat[1]), **{k: (flat[2 * k - 1], flat[2 * k] if k < order else none) for k in range(2, order + 1)}}
        # where each token's word and each n-gram's answer is: answers are in the order of the distinct ones
        grams = [[t, *(cells(g, buckets) for _, g, _ in all_grams(t, first, order))] for t, first in runs]
        at_of = [np.split(ranks(np.concatenate([np.empty(0, np.uint64), *own])), np.cumsum([len(x) for x in own])[:-1]) for own in zip(*grams, strict=True)]
        del grams
        out: list[list[np.ndarray]] = [[], [], [], []]
        for (t, first), *own in zip(runs, *at_of, strict=True):
            at = own[0]
            level, back, exact = (x[at] if len(x) else np.zeros(len(t), np.uint8) for x in told[1])
            count = values_of(level, least)
            base = np.log10((exact + 0.5) / total)
            p = (np.where(level > 0, count, exact) + 0.5) / total
            held, left, place = level > 0, values_of(back, 1.0), places(first)
            for k in range(2, order + 1):
                # contexts: grams of length k - 1 that are held, by their end
                end = np.flatnonzero(place >= k - 1)
                at = own[k - 1]
                level = np.zeros(len(t), np.uint8)
                level[end] = told[k][0][at]
                after = end[count[end - 1] > 0]
                c = count[after - 1]
                found = np.zeros(len(t))
                may = after[held[after]]
                found[may] = np.minimum(values_of(level[may], least), count[may - 1])
                p[after] = np.minimum(np.maximum(found[after] - D, 0.0) / c + p[after] / np.maximum(left[after - 1], 1.0), 1.0)
                if k < order:
                    left = np.zeros(len(t))
                    left[end] = values_of(told[k][1][at], 1.0)
                count, held = found, found > 0
            p = np.maximum(p, 1e-30)  # a filter's false answer never makes a text impossible
            for x, y in zip(out, (np.diff(first), np.add.reduceat((exact > 0).astype(np.int64), first[:-1]), np.add.reduceat(base, first[:-1]), np.add.reduceat(np.log10(p), first[:-1])), strict=True):
                x.append(y)
        columns = [pa.array(np.concatenate([np.empty(0, d), *x]).astype(d)) for x, d in zip(out, (np.int64, np.int64, float, float), strict=True)]
        return pa.Table.from_arrays([ids, *columns], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, *, train_rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, share: int | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), the scores as log10, for every row; trained on ``train_rows`` (default: all)."""
    model = train(docs if train_rows is None else docs.filter(train_rows), text_col=text_col, order=order, share=share)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = store.keep(rows.mapInArrow(tidy(_block), "block long, texts binary"), "blocks")
    answers = []
    for part in range(PASSES):
        asked = blocks.mapInArrow(tidy(_ask(order, model.buckets, part)), "block long, bucket int, keys binary")
        made = model.segments.filter(F.col("bucket") % PASSES == part)
        answers.append(store.keep(asked.groupBy("bucket").cogroup(made.groupBy("bucket")).applyInArrow(tidied_pair(_answer(model.least, order)), ANSWERS), "answers"))
    store.drop(model.segments)
    told = reduce(DataFrame.unionByName, answers)
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tidied_pair(_score(order, model.least, model.total, model.buckets)), f"id {dict(rows.dtypes)['id']}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
