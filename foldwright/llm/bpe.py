"""Byte-level BPE by monoid tree reduction.

A text is cut into halves down to leaves; neighbours are joined by re-encoding
a window around the border that grows until the tokens outside it provably stay:

* between pattern matches: no match spans a position whose left character is
  not white space and whose right one is, and no look-ahead crosses it either,
  so the encodings on both sides of such a *safe cut* are independent;
* inside one match: a token sequence is the BPE encoding of its bytes exactly
  when every adjacent pair of tokens is the encoding of its own bytes, so the
  join is final once the pairs on both rims of the re-encoded window pass.

The result equals encoding each pattern match on its own.  Decoding
concatenates token bytes up the same tree.

Defined cases: null or empty text has no tokens; equal rows give equal rows;
an empty table gives no rows; very long texts cost n log n, also in one match.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table

LEAF_CHARS = 4096
LEAF_BYTES = 6
CACHE_PIECES = 300_000


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        pattern = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self._find = regex.compile(pattern).findall
        self._cut = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
        self._cut_back = regex.compile(r"(?r)(?<=\P{White_Space})(?=\p{White_Space})")
        self._pieces: dict[str, bytes] = {}
        self._parts: dict[bytes, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    # one match -----------------------------------------------------------
    def merge(self, b: bytes) -> list[int]:
        """Plain BPE: lowest rank first, leftmost among equals, by a heap."""
        ranks, n = self.ranks, len(b)
        if b in ranks:
            return [ranks[b]]
        end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue
            end[i], alive[j], nxt[i] = e, False, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(b[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := ranks.get(b[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[b[i : end[i]]])
            i = nxt[i]
        return out

    def _stable(self, s: int, t: int) -> bool:
        ok = self._pairs.get((s, t))
        if ok is None:
            if len(self._pairs) > 2 * CACHE_PIECES:
                self._pairs.clear()
            ok = self._pairs[s, t] = self.merge(self.bytes_of[s] + self.bytes_of[t]) == [s, t]
        return ok

    def _join(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, ...]:
        if not x or not y or self._stable(x[-1], y[0]):
            return x + y
        i = j = 1
        while True:
            i, j = min(i, len(x)), min(j, len(y))
            mid = self.merge(b"".join(map(self.bytes_of.__getitem__, x[-i:] + y[:j])))
            left = i == len(x) or self._stable(x[-i - 1], mid[0])
            right = j == len(y) or self._stable(mid[-1], y[j])
            if left and right:
                return x[:-i] + tuple(mid) + y[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def piece(self, b: bytes) -> tuple[int, ...]:
        """The encoding of one pattern match: halves, joined up the tree."""
        if (r := self.ranks.get(b)) is not None:
            return (r,)
        if len(b) <= LEAF_BYTES:
            got = self._parts.get(b)
            if got is None:
                if len(self._parts) > CACHE_PIECES:
                    self._parts.clear()
                got = self._parts[b] = tuple(self.merge(b))
            return got
        m = len(b) // 2
        return self._join(self.piece(b[:m]), self.piece(b[m:]))

    # a text --------------------------------------------------------------
    def _leaf(self, text: str) -> bytes:
        found = self._find(text)
        known = self._pieces
        try:
            return b"".join([known[p] for p in found])
        except KeyError:
            pass
        if len(known) > CACHE_PIECES:
            known.clear()
        for p in found:
            if p not in known:
                known[p] = np.array(self.piece(p.encode()), "<u4").tobytes()
        return b"".join([known[p] for p in found])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        n = len(text)
        if n <= LEAF_CHARS:
            return self._leaf(text) if n else b""
        m = n // 2
        x, y = self.encode(text[:m]), self.encode(text[m:])
        w = 64
        while True:  # grow to the nearest safe cuts; a text's ends are safe
            lo, hi = max(0, m - w), min(n, m + w)
            # positions strictly inside each half, judged on that half alone
            a = self._cut_back.search(text, lo, m) if lo else None
            b = self._cut.search(text, m, hi)
            a = a.start() if a and a.start() > lo else (0 if lo == 0 else None)
            b = b.start() if b and m < b.start() < hi else (n if hi == n else None)
            if a is not None and b is not None:
                break
            w *= 2
        mid = text[a:b]
        if len(mid) <= LEAF_CHARS or len(mid) == n:
            whole = self._leaf(mid)
        else:
            whole = self.encode(mid)
        drop_x = len(x) if a == 0 else len(self.encode(text[a:m]))
        drop_y = len(y) if b == n else len(self.encode(text[m:b]))
        return x[: len(x) - drop_x] + whole + y[drop_y:]

    def decode(self, ids: bytes) -> bytes:
        n = len(ids) // 4
        if n <= 4 * LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return self.decode(ids[: n // 2 * 4]) + self.decode(ids[n // 2 * 4 :])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One Codec per Python worker; the vocabulary is read where it is used."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Rows (doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return _texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(df: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Rows (doc_id, decoded) of rows (doc_id, ids)."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            out = [c.decode(i.as_py() or b"") for i in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """encode(), then decode() of its ids, in one pass: rows (doc_id, n_tokens,
    ids_sha256, decoded_sha256), and the ids themselves if asked for."""
    path, pattern = vocabulary or default_vocabulary()
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                ids = [c.encode(t.as_py()) for t in part.column(1)]
                out = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([sha(x) for x in ids], pa.string()),
                    "decoded_sha256": pa.array([sha(c.decode(x)) for x in ids], pa.string()),
                } | ({"ids": pa.array(ids, pa.binary())} if with_ids else {})
                yield pa.record_batch(list(out.values()), list(out))

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return _texts(df, id_col, text_col).mapInArrow(run, kinds)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
