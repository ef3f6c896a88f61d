"""Arrays of numbers as compressed bytes: byte planes under zstd, so that high bytes of small numbers cost nothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def gaps(ascending: np.ndarray) -> np.ndarray:
    """First number and differences; the sum from the left undoes it."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def squeeze(*arrays: np.ndarray) -> bytes:
    """The arrays' number, lengths and numbers of planes, then planes up to each array's highest byte that is not zero; :func:`expand` needs their types."""
    own = [np.ascontiguousarray(a).view(f"<u{a.itemsize}") for a in arrays]
    used = [(int(a.max()).bit_length() + 7) // 8 if len(a) else 0 for a in own]
    raw = b"".join(a.view(np.uint8).reshape(-1, a.itemsize)[:, :n].T.tobytes() for a, n in zip(own, used, strict=True))
    return np.array([len(own), *map(len, own)], "<u4").tobytes() + bytes(used) + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def expand(blob: bytes, *types: type) -> list[np.ndarray]:
    """The arrays that :func:`squeeze` got, whose item types are ``types``."""
    n, head = np.frombuffer(blob, "<u4", len(types), 4).tolist(), 4 + 4 * len(types)
    used = blob[head : head + len(types)]
    total = sum(x * y for x, y in zip(n, used, strict=True))
    raw = _CODEC.decompress(blob[head + len(types) :], decompressed_size=total, asbytes=True) if total else b""
    out, at = [], 0
    for t, length, some in zip(types, n, used, strict=True):
        planes = np.zeros((length, np.dtype(t).itemsize), np.uint8)
        planes[:, :some] = np.frombuffer(raw, np.uint8, length * some, at).reshape(some, length).T
        out.append(planes.reshape(-1).view(t))
        at += length * some
    return out
