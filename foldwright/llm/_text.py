"""Vectorised scans over the bytes of whole texts (Arrow in, numpy inside).

Every function works on a *slice*: a run of whole documents whose text bytes
lie one after the other in ``data`` (uint8), document d at
``data[offs[d]:offs[d + 1]]``.  Null texts have length 0.  Slices hold about
SLICE_BYTES, or one document if that alone is longer, so memory is bounded by
the longest document and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~_WS
#: ASCII letters and digits, and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = _inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        out = []
        for base in (_P, _P_INV):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _pow, _inv = out
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (three xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    first: int  # row of the batch
    data: np.ndarray
    offs: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offs) - 1

    def lower(self) -> "Slice":
        return Slice(self.first, LOWER[self.data], self.offs)

    def text(self, d: int) -> bytes:
        return self.data[self.offs[d] : self.offs[d + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may span bytes: give it length 0
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        parts = [data[offs[i] : offs[i + 1]] if valid[i] else data[:0] for i in range(n)]
        offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        data = np.concatenate(parts) if parts else data
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield Slice(a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        a = b


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray  # words of document d: offs[d]:offs[d + 1]


def words(s: Slice, inside: np.ndarray = NOT_SPACE) -> Words:
    """Runs of the bytes flagged in inside (by default those outside \\x20 and
    \\x09-\\x0D), cut at document borders."""
    n = len(s.data)
    w = inside[s.data]
    st, en = w.copy(), w.copy()
    if n:
        st[1:] &= ~w[:-1]
        en[:-1] &= ~w[1:]
        cut = s.offs[(s.offs > 0) & (s.offs < n)]
        st[cut] = w[cut]
        en[cut - 1] = w[cut - 1]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return Words(starts, ends, np.searchsorted(starts, s.offs))


def span_hashes(s: Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal on every machine and run."""
    n = len(s.data)
    p, inv = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[s.data] * p[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def word_shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of one document's word hashes; with fewer
    words the whole sequence as one shingle, without words none."""
    if not len(h):
        return h
    k = min(k, len(h))
    m = len(h) - k + 1
    x = np.full(m, k, np.uint64)
    for j in range(k):
        x = x * np.uint64(0xD1342543DE82EF95) + h[j : j + m]
    return mix(x)


def all_shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """word_shingles over every position of a slice; those that begin within
    k - 1 words of a document's end cross into the next and must be dropped."""
    x = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for j in range(k):
        x = x * np.uint64(0xD1342543DE82EF95) + h[j : j + len(x)]
    return mix(x)


def shingle_lists(w: Words, h: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """The shingle hashes in text order of each document of a slice."""
    every = all_shingles(h, k)
    for d in range(len(w.offs) - 1):
        a, b = w.offs[d], w.offs[d + 1]
        yield every[a : b - k + 1] if b - a >= k else word_shingles(h[a:b], k)


def by_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of flags over data[offs[d]:offs[d + 1]]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
