"""Token counts of a SentencePiece BPE model by rank-synchronous array merging.

Texts are cut where no piece of the vocabulary can reach across (before a space
that follows something else, and around characters that are in no longer piece),
and every distinct cut, a pre-token, is counted once for each batch.  New ones are
held as one ragged array of symbols.  In each round every pre-token finds its
best-scored pair and merges all of that pair's places at once, for all pre-tokens
together; what is left when no pair remains are the tokens, a symbol outside the
vocabulary counting as its UTF-8 bytes.

The library merges one place at a time, leftmost first.  Merging all places at once
differs only if a pair made on the way is as good as the one being merged; such
pre-tokens are told by that and are counted again one place at a time, with a heap.

Defined cases: null or empty text has 0 tokens; texts of any length are counted
whole; strings that look like special tokens are ordinary text; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import lone, tidy

SPACE = "▁"
#: Distinct pre-tokens whose counts a worker remembers (at some 150 bytes each); then it forgets those met once.  Longer ones aren't remembered.
REMEMBERED, LONGEST = 200_000, 32
#: Symbols held in one ragged array.
HELD = 1 << 20
_NONE = np.int64(1) << 62


class PieceMerger:
    """Counts tokens like the SentencePiece library does for a BPE model with identity normalisation."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        inner = {c for p, _ in pieces if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("pieces that go on after a space are not supported")
        # symbols: characters of the vocabulary, then longer pieces; rank: place of the score, best first
        self.char = {c: i for i, c in enumerate(sorted(inner | {p for p, _ in pieces if len(p) == 1}))}
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.bytes_of = [1 if c in self.single else len(c.encode()) for c in self.char]
        symbol = dict(self.char)
        for p, _ in pieces:
            symbol.setdefault(p, len(symbol))
        place = {s: i for i, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        score = dict(pieces)
        pairs: dict[int, tuple[int, int]] = {}
        self.base = len(symbol) + 1
        for p in symbol:
            if len(p) > 1:
                for cut in range(1, len(p)):
                    left, right = symbol.get(p[:cut]), symbol.get(p[cut:])
                    if left is not None and right is not None:
                        pairs[left * self.base + right] = (place[score[p]], symbol[p])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.cost = np.ones(self.base, np.int64)
        self.cost[: len(self.bytes_of)] = self.bytes_of
        edge = "".join(re.escape(c) for c in sorted(inner))
        # a pre-token: spaces and the joinable characters after them, or joinable characters, or others, each its own
        self.cut = re.compile(f"{SPACE}+[{edge.replace(re.escape(SPACE), '')}]*|[{edge.replace(re.escape(SPACE), '')}]+|[^{edge}]")
        self.known: dict[str, int] = {}
        self.again: set[str] = set()

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged symbol of each pair."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), np.where(hit, self.made[at], -1)

    def merge(self, pre: list[str]) -> list[int]:
        """Token counts of pre-tokens of joinable characters."""
        size = np.fromiter(map(len, pre), np.int64, len(pre))
        sym = np.fromiter(map(self.char.__getitem__, "".join(pre)), np.int64, int(size.sum()))
        own = np.repeat(np.arange(len(pre)), size)
        out, redo = np.zeros(len(pre), np.int64), np.zeros(len(pre), bool)
        last = np.full(len(pre), -1, np.int64)
        while len(sym):
            n = len(sym)
            rank, made = np.full(n, _NONE), np.full(n, -1, np.int64)
            same = own[1:] == own[:-1]
            r, m = self.lookup(sym[:-1], sym[1:])
            rank[:-1], made[:-1] = np.where(same, r, _NONE), m
            start = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, start)
            owner = own[start]
            redo[owner[best <= last[owner]]] = True  # as good as what was just merged: order may matter
            done = (best == _NONE) | redo[owner]
            last[owner] = best
            length = np.diff(np.concatenate((start, [n])))
            if done.any():
                over = np.repeat(done, length)
                np.add.at(out, own[over], self.cost[sym[over]])
            at = np.flatnonzero((rank == np.repeat(best, length)) & ~np.repeat(done, length))
            # of places that overlap take every other one, from the left
            run = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.empty(0, bool)
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0)) if len(at) else at
            at = at[nth % 2 == 0]
            sym[at] = made[at]
            left = ~np.repeat(done, length)
            left[at + 1] = False
            sym, own = sym[left], own[left]
        for i in np.flatnonzero(redo).tolist():
            out[i] = self.merge_one(pre[i])
        return out.tolist()

    def merge_one(self, pre: str) -> int:
        """The same, one place at a time: best score first, then leftmost."""
        sym = [self.char[c] for c in pre]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def add(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get(sym[i] * self.base + sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            add(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = self.pairs[a * self.base + b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                add(i)
            if before[i] >= 0:
                add(before[i])
        return int(sum(self.cost[s] for s in sym if s >= 0))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:  # pre-tokens that came back stay
            if len(self.again) > REMEMBERED // 2:
                self.again.clear()
            self.known = {p: self.known[p] for p in self.again}
        known, cut = self.known, self.cut.findall
        # every text gets a space in front; an inner word is cut only where a space follows something else
        parts = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        own = set().union(*parts)
        new = own.difference(known)
        self.again.update(own.difference(new))
        todo, size = [], 0
        for p in new:
            if p[0] not in self.char:
                known[p] = len(p.encode())
                continue
            todo.append(p)
            size += len(p)
            if size > HELD:
                known.update(zip(todo, self.merge(todo), strict=True))
                todo, size = [], 0
        known.update(zip(todo, self.merge(todo), strict=True))
        out = [sum(map(known.__getitem__, part)) for part in parts]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out


def merger_of(model_file: str) -> PieceMerger:
    """One merger for each worker process, with what it remembers."""
    return lone(("merger", model_file), lambda: PieceMerger(model_file))


def _run(model_file: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n: list[int] = []
            at = 0
            while at < len(texts):  # about a million characters at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size < HELD):
                    size += len(texts[to])
                    to += 1
                n += merger.count(texts[at:to])
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, model_file: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.  ``model_file`` must be readable on every worker."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_run(model_file, limit)), f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long, over_limit boolean")
