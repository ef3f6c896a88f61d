"""Benchmark decontamination: short n-gram seeds, then Smith-Waterman alignment.

Every run of three words of a test item is a seed, however frequent; a copy with at most a fifth
of its words replaced or dropped has one intact, but of an item of five words only two words, which
are its seeds then.  A text with a seed of an item is a candidate at the seed's diagonal;
seeds on near diagonals share a window of the text, the item's length and a quarter
more to either side.  A window without 0.8 of the item's words, in any order, is left out.
Item and window are aligned word by word (Smith-Waterman:
match 2, mismatch and gap -1), and the similarity is the matched words over the
item's words.  Pairs of 0.8 or more are contaminated, so copies with replaced,
dropped or added words are found as well as whole ones.

Plan.  The benchmark is a query set: it is broadcast in blocks of at most BLOCK_WORDS
words, each block scanning the corpus once, with no shuffle of texts.  A worker looks hashes up in a bitmap, then in a
sorted array.  Only hits leave it.

Defined cases: null and empty texts match nothing; items of no words are skipped,
items of fewer than five words are one seed as a whole (then the window must hold
all of it); repeated items and documents are reported each; texts of any length are
scanned whole, and aligned in a step for each of the item's words; other columns are
ignored, and documents to be dropped are told by their own text, so their ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import chain, lowered, tidy, trim, word_runs

SHORT, LONG, SIMILAR = 3, 5, 0.8
BLOCK_WORDS = 2_000_000
MATCH, OTHER = 2, -1
#: Places of the matched words in a cell, which holds the score above them.
_SHIFT = np.int64(31)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and the places where they start."""
    if len(hashes) < n:
        return hashes[:0], np.empty(0, np.int64)
    g = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        g = chain(g, hashes[k : len(hashes) - n + 1 + k])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(text[: len(g)] == text[n - 1 :])
    return g[inside], inside


class Lookup:
    """Membership of hashes in a fixed set: a bitmap first, then the sorted hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = max(16, int(len(self.keys)).bit_length() + 4)
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self.keys >> np.uint64(64 - self.bits)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are in the set, and their places in ``keys``."""
        maybe = np.flatnonzero(self.map[h >> np.uint64(64 - self.bits)])
        at = np.searchsorted(self.keys, h[maybe])
        at = np.minimum(at, max(len(self.keys) - 1, 0))
        sure = self.keys[at] == h[maybe] if len(self.keys) else np.empty(0, bool)
        return maybe[sure], at[sure]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair: score, matched words, and the window's place after its end.

    All pairs advance together, one item word a step.  Score and matches are one
    number, so that of equal scores the one with more matches is kept.
    """
    pairs, long, wide = len(items), max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((pairs, long), np.uint64), np.zeros((pairs, wide), np.uint64)
    a_in, b_in = np.zeros((pairs, long), bool), np.zeros((pairs, wide), bool)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], a_in[k, : len(x)] = x, True
        b[k, : len(y)], b_in[k, : len(y)] = y, True
    gap = np.int64(-OTHER) << _SHIFT
    slope = np.arange(wide, dtype=np.int64) * gap
    row = np.zeros((pairs, wide), np.int64)
    best, end = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    for i in range(long):
        same = (b == a[:, i : i + 1]) & b_in & a_in[:, i : i + 1]
        slant = np.zeros_like(row)
        slant[:, 1:] = row[:, :-1]
        slant += np.where(same, (np.int64(MATCH) << _SHIFT) + 1, np.int64(OTHER) << _SHIFT)
        new = np.maximum(slant, row - gap)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        new[(new >> _SHIFT) <= 0] = 0
        top = new.argmax(axis=1)
        value = np.where(a_in[:, i], new[np.arange(pairs), top], 0)
        end = np.where(value > best, top + 1, end)
        best = np.maximum(best, value)
        row = new
    return best >> _SHIFT, best & ((np.int64(1) << _SHIFT) - 1), end


class Items:
    """One block of test items: word hashes, n-grams, and later their seeds."""

    def __init__(self, ids: list, texts: list[bytes]):
        h, first = [], [0]
        for t in texts:
            own = np.concatenate([np.empty(0, np.uint64), *(x for _, _, x, _ in word_runs([t]))])
            h.append(own)
            first.append(first[-1] + len(own))
        self.ids, self.first = ids, np.array(first)
        self.hashes = np.concatenate([np.empty(0, np.uint64), *h])
        self.whole = [int(n) for n in np.diff(self.first)]

    def words(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]

    def seeds(self, similar: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: hash, item and place of the seeds, by hash.

        With k words lost, the others lie in k + 1 runs at most, so the longest has an equal share at least.
        """
        whole = np.array(self.whole)
        lost = np.floor((1 - similar) * whole + 1e-9).astype(np.int64)
        length = np.clip(-(-(whole - lost) // (lost + 1)), 1, SHORT)
        length = np.where(whole < LONG, whole, length)
        out = {}
        for n in np.unique(length).tolist():
            g, at = grams(self.hashes, self.first, n)
            item = np.searchsorted(self.first, at, side="right") - 1
            own = np.flatnonzero(length[item] == n)
            own = own[np.argsort(g[own], kind="stable")]
            out[n] = g[own], item[own], at[own] - self.first[item[own]]
        return out


class Scanner:
    """Finds the items of one block in texts."""

    def __init__(self, items: Items, similar: float):
        self.items, self.similar, self.seeds = items, similar, items.seeds(similar)
        self.find = {n: Lookup(s[0]) for n, s in self.seeds.items()}

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, last word) of each contaminated text and item."""
        rows: list[tuple[int, int, float, int, int]] = []
        for i, _, h, first in word_runs(texts):
            text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            hits = [np.empty((3, 0), np.int64)]
            for n, f in self.find.items():
                g, at = grams(h, first, n)
                place, key = f.find(g)
                begin, end = (np.searchsorted(self.seeds[n][0], f.keys[key], side) for side in ("left", "right"))
                times = end - begin
                own = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())
                at = np.repeat(at[place], times)
                hits.append(np.stack((text_of[at], self.seeds[n][1][own], at - first[text_of[at]] - self.seeds[n][2][own])))
            rows += [(i + t, *found) for t, found in _verify(np.concatenate(hits, axis=1), self.items, h, first, self.similar)]
        return rows


def _scan(items: Items, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(items, similar)
        for batch in batches:
            rows = scanner.matches(lowered(batch.column(1)))
            if rows:
                doc, item, sim, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array([items.ids[k] for k in item], pa.int64()), pa.array(sim, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                    ["id", "item_id", "similarity", "first_word", "last_word"],
                )

    return run


def _verify(hits: np.ndarray, items: Items, h: np.ndarray, first: np.ndarray, similar: float) -> Iterator[tuple[int, tuple[int, float, int, int]]]:
    """The best alignment of each candidate pair (rows of ``hits``: text, item, diagonal), where similar enough, with its first and last word."""
    if not hits.size:
        return
    t, item, d = hits[:, np.lexsort(hits[::-1])]
    size = np.array(items.whole, np.int64)[item]
    slack = size // 4 + 2
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (item[1:] != item[:-1]) | (d[1:] > d[:-1] + slack[1:])))
    begin = np.flatnonzero(new)
    lo = np.maximum(0, d[begin] - slack[begin])
    hi = np.minimum(first[t[begin] + 1] - first[t[begin]], d[np.append(begin[1:], len(t)) - 1] + (size + slack)[begin])
    todo = []
    for one in zip(t[begin].tolist(), item[begin].tolist(), lo.tolist(), hi.tolist(), strict=True):
        words = items.words(one[1])
        if np.isin(words, h[first[one[0]] + one[2] : first[one[0]] + one[3]]).sum() >= similar * len(words) - 1e-9:
            todo.append(one)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    todo.sort(key=lambda x: (items.whole[x[1]], x[3] - x[2]))
    at = 0
    while at < len(todo):
        to, room = at, 0  # pairs of like size, up to four million cells for each step
        while to < len(todo) and (to == at or room < 1 << 22):
            room = (to + 1 - at) * max(todo[to][3] - todo[to][2], items.whole[todo[to][1]])
            to += 1
        part = todo[at:to]
        a, b = [items.words(k) for _, k, _, _ in part], [h[first[t] + lo : first[t] + hi] for t, _, lo, hi in part]
        _, matched, end = align(a, b)
        good = [k for k in range(len(part)) if matched[k] >= similar * len(a[k]) - 1e-9]
        if good:
            _, _, back = align([a[k][::-1] for k in good], [b[k][: end[k]][::-1] for k in good])
            for k, length in zip(good, back.tolist(), strict=True):
                t, item, lo, _ = part[k]
                found = (float(matched[k]) / len(a[k]), int(lo + end[k] - length), int(lo + end[k] - 1))
                if found[0] > best.get((t, item), (0.0,))[0]:
                    best[t, item] = found
        at = to
    for (t, item), (sim, a, b) in best.items():
        yield t, (item, min(sim, 1.0), a, b)


def item_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_words: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_words`` words; items without a word are left out."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("k"), F.col(item_text_col).alias("t")).filter("t IS NOT NULL").orderBy("k", "t").toLocalIterator():
        text = r["t"].encode().lower()
        n = len(text.split())
        if not n:
            continue
        if ids and size + n > block_words:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["k"])
        texts.append(text)
        size += n
    if ids:
        yield Items(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, last_word): one row per contaminated document and item."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, item_id long, similarity double, first_word long, last_word long"
    found = [rows.mapInArrow(tidy(_scan(items, similar)), schema) for items in item_blocks(benchmark, item_col, item_text_col, block_words)]
    out = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", "doc_id")


def _clean(items: Items, similar: float):
    """Which texts hold none of the items."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(items, similar)
        for column in columns:
            clean = np.ones(len(column), bool)
            for at in range(0, len(column), 512):
                clean[[at + t for t, *_ in scanner.matches(lowered(column.slice(at, 512)))]] = False
            yield pa.array(clean)
        trim()

    return F.arrow_udf(run, "boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, similar: float = SIMILAR, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows whose text is contaminated."""
    for items in item_blocks(benchmark, item_col, item_text_col, block_words):
        docs = docs.filter(_clean(items, similar)(docs[text_col]))
    return docs
