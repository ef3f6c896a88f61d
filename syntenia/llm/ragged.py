"""Words of many texts as flat numpy arrays.

Words are runs of bytes other than 20 and 09-0D after lower-casing A-Z.  A word's
64-bit hash is a polynomial over randomised byte values, taken from prefix sums,
so hashes of words, and of their leading bytes, cost a few array operations per
byte and no Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
U = np.uint64
#: Odd, and 3 modulo 4: powers of it differ early in their low bits.
_STEP = 0x94D049BB133111EB
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_power: list[np.ndarray] = []
_lone: dict[Hashable, object] = {}


def lone(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept for the worker process's next tasks; another key's object goes first, so that a reused worker holds one."""
    if key not in _lone:
        _lone.clear()
        _lone[key] = make()
    return _lone[key]


def trim() -> None:
    """Give the memory of freed arrays back to the system, as a reused worker would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that few texts are held as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(run: Callable) -> Callable:
    """A function over a task's batches, taken in small ones, that gives its memory back at the end."""

    def out(batches):
        yield from run(small_batches(batches))
        trim()

    return out


def tidied(f: Callable) -> Callable:
    """The same for a function of a group."""

    def out(group):
        made = f(group)
        trim()
        return made

    return out


def tidied_pair(f: Callable) -> Callable:
    """The same for a function of two groups."""

    def out(left, right):
        made = f(left, right)
        trim()
        return made

    return out


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def ranks(a: np.ndarray) -> np.ndarray:
    """Each number's place among the distinct ones."""
    order = np.argsort(a)
    s = a[order]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1]))) if len(a) else 0
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses modulo 2**64, for ``n`` places."""
    if not _power or len(_power[0]) < n:
        n = max(n, BLOCK + 64)
        both = []
        for base in (_STEP, pow(_STEP, -1, 2**64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > 4 * BLOCK:  # one giant word: not worth keeping
            return both[0], both[1]
        _power[:] = both
    return _power[0], _power[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a longer n-gram from the hash of all but its last word and that word."""
    return mix(left * U(0xD6E8FEB86659FD93) + right)


class Words:
    """Words of consecutive texts: ``hashes``, and ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray, inv: np.ndarray):
        self.hashes, self.first, self.starts, self.ends, self._sums, self._inv = hashes, first, starts, ends, sums, inv

    def prefix(self, n: int) -> np.ndarray:
        """Hash of each word's first ``n`` bytes (the whole word if it is shorter)."""
        e = np.minimum(self.ends, self.starts + n)
        return mix((self._sums[e] - self._sums[self.starts]) * self._inv[self.starts] + U(n))

    def text_of(self) -> np.ndarray:
        """The text's position for each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: list[bytes]) -> Words:
    """Words of all texts (already lower-cased) in one pass; meant for blocks of about BLOCK bytes."""
    flat = b"\n".join(texts)
    a = np.frombuffer(flat, np.uint8)
    power, inv = _powers(len(a) + 1)
    gap = np.ones(len(a) + 2, bool)
    gap[1:-1] = _SPACE[a]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turn[0::2], turn[1::2]
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * power[: len(a)], out=sums[1:])
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(size + 1)))
    return Words(mix((sums[ends] - sums[starts]) * inv[starts]), np.searchsorted(starts, at), starts, ends, sums, inv)


def pieces(text: bytes, most: int = BLOCK) -> list[bytes]:
    """``text`` cut at white space into parts of about ``most`` bytes; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > most:
        ahead = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, offset=at + most)[:BLOCK]])
        if len(ahead):
            cut = at + most + int(ahead[0])
        else:
            far = [p for p in (text.find(bytes([c]), at + most) for c in (0x20, 9, 10, 11, 12, 13)) if p >= 0]
            if not far:
                break
            cut = min(far)
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def lowered(column: pa.Array) -> list[bytes]:
    """A text column as lower-cased bytes; null is empty."""
    return [(b or b"").lower() for b in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs ``(from, to, texts)`` of about ``most`` bytes, so that arrays stay small; a very long text is alone."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j]) + 1
            j += 1
        yield i, j, texts[i:j]
        i = j


def word_runs(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, hashes, first)`` for runs of texts; a very long text is hashed piece by piece."""
    for i, j, part in blocks(texts):
        if j - i == 1 and len(part[0]) > BLOCK:
            h = np.concatenate([words([p]).hashes for p in pieces(part[0])])
            yield i, j, h, np.array([0, len(h)])
        else:
            w = words(part)
            yield i, j, w.hashes, w.first
