"""Token-ID output: one wavelet matrix per shard.

Texts are encoded with a tokenizers vocabulary, an end id is appended to each
document, and ids in ascending document order are cut into shards.  A shard is one
row of a Parquet table (compressed by Parquet): the documents' ids and lengths and
a blob with a succinct wavelet matrix.  The blob, little-endian, is

    8 bytes "WMATRIX1", then uint64 n (ids), uint64 b (bit-planes),
    b x uint64 (zeros in each plane),
    b x ceil(n / 512) x uint32 (ones of the plane before each 512 bits),
    b x ceil(n / 512) x 64 bytes (bits of the plane, most significant plane first).

:class:`WaveletMatrix` reads tokens, counts and occurrences from it in place.

Plan.  Documents are dealt out by ranges of their id, sorted inside a task and
written as they come, so a task holds one shard; a shard ends with the document that
reaches SHARD ids.  Starts are running sums over one row per shard.

Defined cases: a null or empty text is the end id alone; equal or null ids stay
separate documents, null first and equal ones in the order of their texts' hashes;
special strings inside texts are handled as the library does by default; an empty
table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store
from .ragged import blocks, lone, pieces, tidy
from .ragged import words as word_places

MAGIC = b"WMATRIX1"
SHARD = 1 << 20
#: Distinct words whose ids a worker remembers; then it forgets all.
REMEMBERED = 1_000_000
#: Letters of which neither normal form nor lower case ends in a combining mark, which would join what follows.
LETTERS = re.compile("[À-ÖØ-öø-įıĲ-ɏ]").match
#: ASCII characters that are neither letter, digit nor white space.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class WaveletMatrix:
    """Ids with access, rank, select, counting and occurrence lookup on bit-planes."""

    def __init__(self, n: int, zeros: np.ndarray, ones_before: np.ndarray, planes: np.ndarray):
        self.n, self.zeros, self.before, self.planes = n, zeros, ones_before, planes  # planes: (b, blocks, 8) uint64

    @property
    def bits(self) -> int:
        return len(self.zeros)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n = len(ids)
        blocks = -(-n // 512)
        zeros, planes = np.zeros(bits, np.uint64), np.zeros((bits, blocks * 64), np.uint8)
        for level in range(bits):
            one = (ids & ids.dtype.type(1 << (bits - 1 - level))) != 0
            packed = np.packbits(one, bitorder="little")
            planes[level, : len(packed)] = packed
            low = ids.take(np.flatnonzero(~one))
            zeros[level] = len(low)
            ids = np.concatenate((low, ids.take(np.flatnonzero(one))))
        words = planes.view("<u8").reshape(bits, blocks, 8)
        per_block = np.bitwise_count(words).sum(axis=2, dtype=np.uint32)
        before = np.zeros((bits, blocks), np.uint32)
        np.cumsum(per_block[:, :-1], axis=1, out=before[:, 1:]) if blocks > 1 else None
        return cls(n, zeros, before, words)

    def to_bytes(self) -> bytes:
        head = MAGIC + np.array([self.n, self.bits], "<u8").tobytes() + self.zeros.astype("<u8").tobytes()
        return head + self.before.astype("<u4").tobytes() + self.planes.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        if blob[:8] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits = (int(x) for x in np.frombuffer(blob, "<u8", 2, 8))
        blocks = -(-n // 512)
        zeros = np.frombuffer(blob, "<u8", bits, 24)
        before = np.frombuffer(blob, "<u4", bits * blocks, 24 + 8 * bits).reshape(bits, blocks)
        planes = np.frombuffer(blob[24 + 8 * bits + 4 * bits * blocks :], "<u8").reshape(bits, blocks, 8)
        return cls(n, zeros, before, planes)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level].reshape(-1)[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place (0 to n)."""
        if not self.n:
            return np.zeros(len(at), np.int64)
        block = np.minimum(at >> 9, len(self.before[level]) - 1)
        words = self.planes[level][block]
        inside = (at - (block << 9))[:, None] - 64 * np.arange(8)
        take = np.clip(inside, 0, 64)
        mask = np.where(take == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(take, 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level][block].astype(np.int64) + np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one, ones = self._bit(level, at).astype(bool), self._ones(level, at)
            out = (out << 1) | one
            at = np.where(one, int(self.zeros[level]) + ones, at - ones)
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = (int(x) for x in self._ones(level, np.array([lo, hi], np.int64)))
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if symbol >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``symbol`` in places lo to hi."""
        if symbol >> self.bits:
            return 0
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, symbol: int, at: int) -> int:
        return self.count(symbol, 0, at)

    def _select_bit(self, level: int, one: bool, nth: np.ndarray) -> np.ndarray:
        """Place of the nth (from 0) one or zero of a plane."""
        lo, hi = np.zeros(len(nth), np.int64), np.full(len(nth), self.n, np.int64)
        while (lo < hi).any():  # smallest place p with nth + 1 such bits before p + 1
            mid = (lo + hi) >> 1
            ones = self._ones(level, np.minimum(mid + 1, self.n))
            enough = (ones if one else np.minimum(mid + 1, self.n) - ones) > nth
            hi, lo = np.where(enough, mid, hi), np.where(enough, lo, np.minimum(mid + 1, hi))
        return lo

    def occurrences(self, symbol: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """All places of ``symbol`` among lo to hi, ascending."""
        if symbol >> self.bits:
            return np.empty(0, np.int64)
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        at = np.arange(a, b, dtype=np.int64)
        for level in reversed(range(self.bits)):
            one = bool(symbol >> (self.bits - 1 - level) & 1)
            at = self._select_bit(level, one, at - int(self.zeros[level]) if one else at)
        return at

    def select(self, symbol: int, nth: int) -> int:
        """Place of the nth occurrence (from 0), or -1."""
        if nth < 0 or nth >= self.count(symbol):
            return -1
        a, _ = self._range(symbol, 0, self.n)
        at = np.array([a + nth])
        for level in reversed(range(self.bits)):
            one = bool(symbol >> (self.bits - 1 - level) & 1)
            at = self._select_bit(level, one, at - int(self.zeros[level]) if one else at)
        return int(at[0])

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            one = np.unpackbits(np.ascontiguousarray(self.planes[level]).view(np.uint8).reshape(-1), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(out)
            above[np.flatnonzero(~one)] = out[: int(self.zeros[level])]
            above[np.flatnonzero(one)] = out[int(self.zeros[level]) :] | out.dtype.type(1 << (self.bits - 1 - level))
            out = above
        return out


class Encoder:
    """Ids of texts; equal to the library's on whole texts, as white space ends every word and is dropped.

    A word is known by a 64-bit hash of it: among a million words two meet with a chance of 3 in 10**8."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.dtype = np.dtype("<u2") if self.bits <= 16 else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {}
        self.memory = Memory(self.dtype)
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        # ids that end a run of letters
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.mark, self.mark_text = special[-1]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def learn(self, new: set[bytes]) -> None:
        """Encode new words, many in one call, with a special string between them."""
        known, tail = self.known, {}
        # a letter and marks after it are always parted, so such a word is its stem's ids and the marks'
        for w in new:
            if w[-1] in MARKS and (stem := w.rstrip(MARKS)) and b"<|" not in w and (97 <= stem[-1] <= 122 or stem[-1] > 127 and LETTERS(stem.decode()[-1])):
                tail[w] = stem
        need = {tail.get(w, w) for w in new}.union(w[len(t) :] for w, t in tail.items()).difference(known)
        need = self.learn_plain(need)
        plain = [w for w in need if b"<|" not in w]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = self._ids(self.mark_text.join(w.decode() for w in part))
            ends = np.concatenate((np.flatnonzero(ids == self.mark), [len(ids)]))
            data, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            begin = 0
            for w, end in zip(part, ends.tolist(), strict=True):
                known[w] = data[begin * size : end * size]
                begin = end + 1
        for w in need:
            if b"<|" in w and w not in known:
                known[w] = self._ids(w.decode()).astype(self.dtype).tobytes()
        for w, stem in tail.items():
            known[w] = known[stem] + known[w[len(stem) :]]

    def learn_plain(self, need: set[bytes]) -> list[bytes]:
        """Encode words of letters only, many in one call, each ending with its last id's end-of-word mark; returns the others."""
        words = [w for w in need if w.isalpha() or ((t := w.decode()).isalpha() and "\u0130" not in t)] if self.ends.any() else []
        size = self.dtype.itemsize
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = self._ids(b" ".join(part).decode())
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            if len(cut) != len(part):
                continue  # not one run of letters each: told apart by the special string below
            data = ids.astype(self.dtype).tobytes()
            self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))
        return [w for w in need if w not in self.known]

    def _ids_of(self, h: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each word's ids begin, and how many they are; words that aren't there are encoded first."""
        order = np.argsort(h)
        s = h[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        keys, one = s[new], order[new]
        begin, size = self.memory.find(keys)
        miss = np.flatnonzero(size < 0)
        if len(miss):
            words = [text[i:j] for i, j in zip(starts[one[miss]].tolist(), ends[one[miss]].tolist(), strict=True)]
            self.known = {}
            self.learn(set(words))
            ids = [self.known[w] for w in words]
            self.known = {}
            begin[miss], size[miss] = self.memory.add(keys[miss], np.frombuffer(b"".join(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        return begin[place], size[place]

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        # the vocabulary's text is lower case; texts with special strings or combining accents (U+0300 to U+037F) keep theirs for the library
        own = [t if not self.lowers or b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        out: list[bytes] = []
        for i, j, run in blocks(own):
            parts = pieces(run[0]) if j - i == 1 else [None]
            rows: list[bytes] = []
            for piece in parts:
                part = run if piece is None else [piece]
                w = word_places(part)
                if len(self.memory) > REMEMBERED:
                    self.memory = Memory(self.dtype)
                begin, size = self._ids_of(w.hashes, b"\n".join(part), w.starts, w.ends) if len(w.hashes) else (np.empty(0, np.int64),) * 2
                upto = np.concatenate(([0], np.cumsum(size)))
                ids = self.memory.pool[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
                data, cut = ids.tobytes(), (upto[w.first] * self.dtype.itemsize).tolist()
                rows += [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            out += [b"".join(rows) + end] if len(parts) > 1 else [r + end for r in rows]
        return out


class Memory:
    """Ids of words by the words' hashes: sorted arrays, of some 25 bytes a word, and a few new words beside them."""

    def __init__(self, dtype: np.dtype):
        none = np.empty(0, np.int64)
        self.parts = [(np.empty(0, np.uint64), none, none)] * 2  # many, and new ones
        self.pool = np.empty(1 << 16, dtype)
        self.used = 0

    def __len__(self) -> int:
        return sum(len(keys) for keys, _, _ in self.parts)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of each key's ids; -1 ids if it isn't there."""
        begin, size = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for have, b, n in self.parts:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = np.flatnonzero(have[at] == keys)
                begin[hit], size[hit] = b[at[hit]], n[at[hit]]
        return begin, size

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put ascending new keys with their ids; returns begin and number."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.parts[1] = self._joined(self.parts[1], (keys, begin, size))
        if len(self.parts[1][0]) > 1 << 16:
            self.parts = [self._joined(*self.parts), (keys[:0], begin[:0], size[:0])]
        return begin, size

    @staticmethod
    def _joined(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))


def encoder_of(tokenizer_file: str) -> Encoder:
    """One encoder for each worker process, with what it remembers."""
    return lone(("encoder", tokenizer_file), lambda: Encoder(tokenizer_file))


def _write(tokenizer_file: str, end_id: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_file)
        bits = max(encoder.bits, int(end_id).bit_length())
        end = np.array([end_id], encoder.dtype).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        rows: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(rows), encoder.dtype), bits)
            sizes = [len(r) // encoder.dtype.itemsize for r in rows]
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([matrix.n], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([matrix.to_bytes()], pa.binary())],
                ["part", "seq", "n_tokens", "doc_ids", "sizes", "matrix"],
            )
            seq, held = seq + 1, 0
            ids.clear()
            rows.clear()
            return out

        for batch in batches:
            id_type = batch.schema.field(0).type
            docs, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 1 << 22):
                    size += len(texts[to])
                    to += 1
                for doc, row in zip(docs[at:to], encoder.encode(texts[at:to], end), strict=True):
                    ids.append(doc)
                    rows.append(row)
                    held += len(row) // encoder.dtype.itemsize
                    if held >= shard:
                        yield flush()
                at = to
        if rows:
            yield flush()

    return run


def write_shards(docs: DataFrame, tokenizer_file: str, path: str, *, end_id: int = 2, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards of all rows to ``path`` (any store that Spark writes to)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    order = ["id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"part int, seq int, n_tokens long, doc_ids array<{kind}>, sizes array<long>, matrix binary"
    dealt.mapInArrow(tidy(_write(tokenizer_file, end_id, shard)), schema).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            docs, sizes = batch.column(2)[k].values, np.array(batch.column(3)[k].as_py(), np.int64)
            data = memoryview(WaveletMatrix.from_bytes(batch.column(4)[k].as_py()).ids().astype("<u4").tobytes())
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column(0)[k].as_py(), np.int32)), pa.array(np.full(n, batch.column(1)[k].as_py(), np.int32)), docs, pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards at ``path``, from their matrices."""
    shards = spark.read.parquet(path)
    kind = dict(shards.dtypes)["doc_ids"].removeprefix("array<")[:-1]
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    rows = shards.select("part", "seq", "doc_ids", "sizes", "matrix").mapInArrow(_read, f"part int, seq int, doc_id {kind}, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_file: str, **how) -> DataFrame:
    """Write all rows' shards below the shared folder and read them back."""
    spark = docs.sparkSession
    path = store.new_path(spark, "shards")
    write_shards(docs, tokenizer_file, path, **how)
    return read_documents(spark, path)
