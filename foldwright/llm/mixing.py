"""Language-model scores by online logistic context mixing.

Tokens are the words of the lower-cased text (A-Z only) and one end.  A token is
a path of bits: down a Huffman tree over the HEAD most frequent training tokens,
an escape and the end; an escaped word is spelled, byte by byte and with a
terminator, down a Huffman tree over bytes.  Three bit predictors with hashed
contexts (none, one and two tokens back; in a spelled word SPELLING
bytes back) hold training counts of zeros and ones in tables of 2**TABLE_BITS
slots; a longer context starts from what the shorter one predicts, with the
weight of BACKOFF observations.  Their stretched probabilities are combined by weights that a gate picks
(upper, middle or lower tree, spelling) and that learn online, and an adaptive
probability map, also online, refines the mix.  All bits of a token are mixed.  Weights
and map run through a whole document; they are updated after every BLOCK tokens from
all its bits, which lets numpy advance the documents of a slice together, so scores
don't depend on which other texts share a task.  The score is the log10 probability of
all bits; total bits per byte is -score / log10(2) / bytes.

Training gathers the count of every token (a shuffle with a row per token and
task) and the context tables, of fixed size, summed in two levels with 64-bit counters.

The base score joins the exact counts: those of head tokens from the table that
is sent around (HEAD rows), those of all others by a shuffle join.

Defined cases: null or empty text is one end token; repeated rows each get a row;
a null id counts as the text ``None``; an empty table gives no rows; without
training rows every base score is 0; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._io import materialize, table

HEAD = 1 << 18
TABLE_BITS = 21
BLOCK = 8
DEPTHS = (5, 10)  # of the token tree, where a new gate begins
GATES = len(DEPTHS) + 2
SLICE_BYTES = 512 << 10
CHUNK_TOKENS = 64_000  # worked on at once; a multiple of BLOCK
CHUNK_COST = 100_000  # of tokens and spelled bytes, a third as much each, worked on at once
TRAIN_COST = 25_000  # the same in training, where chunks need not be long
FLUSH_WORDS = 1_000_000
HELD_BITS = 2_000_000  # whose slots a training task holds before it counts them
RANGES = 32
TERMINATOR = 32
SPELLING = (2, 3, 5)  # bytes that the predictors look back in a spelled word
RATE, MAP_RATE, CELLS = 0.02, 0.02, 24
START_WEIGHTS = ((0.6, 0.2, 0.2), (0.7, 0.15, 0.15), (0.8, 0.1, 0.1), (0.2, 0.3, 0.5))  # by gate
BACKOFF = np.float32(0.4)  # observations that a shorter context counts for
HEAD_LEAST = 2  # hapaxes are spelled, so that the escape learns how often new tokens come
_END = np.uint64(0x1D872B41A5E2C39F)
_BEGIN = np.uint64(0x9D39247E33776D41)
_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)
_NODE, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, bits): the path of symbol s is offsets[s]:offsets[s + 1]."""
    n = len(counts)
    heap = [(max(int(c), 1), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, bit = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        bit[j] = 1
        heapq.heappush(heap, (a + b, node))
    root = 2 * n - 2
    depth = np.zeros(2 * n, np.int64)
    for node in range(root - 1, -1, -1):
        depth[node] = depth[parent[node]] + 1
    offs = np.concatenate([[0], np.cumsum(depth[:n])])
    nodes, bits = np.zeros(offs[-1], np.int64), np.zeros(offs[-1], np.int8)
    at, end = np.arange(n), offs[1:].copy()
    while len(at):  # all paths a step up at a time
        live = at != root
        at, end = at[live], end[live] - 1
        nodes[end], bits[end] = parent[at] - n, bit[at]
        at = parent[at]
    return offs, nodes, bits


@dataclass
class Codes:
    """Head tokens (sorted hashes) and the paths of all symbols: head tokens by
    rank of hash, then escape, end and the 256 bytes."""

    head: np.ndarray
    count: np.ndarray  # of head tokens, in training
    offs: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    lookup: np.ndarray

    @property
    def escape(self) -> int:
        return len(self.head)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index among head tokens, or -1."""
        at = self.lookup[h >> np.uint64(64 - 21)].astype(np.int64)
        hard = np.flatnonzero(at == -2)
        if len(hard):
            at[hard] = np.searchsorted(self.head, h[hard])
            at[at == len(self.head)] = -1
        ok = at >= 0
        at[ok & (self.head[np.maximum(at, 0)] != h)] = -1
        return at


def make_codes(head: np.ndarray, count: np.ndarray, other: int, ends: int, bytes_seen: np.ndarray) -> Codes:
    order = np.argsort(head)
    head, count = head[order], count[order]
    c1 = np.concatenate([count, [other, ends]])
    o1, n1, b1 = huffman(c1)
    o2, n2, b2 = huffman(bytes_seen + 1)
    lookup = np.full(1 << 21, -1, np.int32)
    slot = (head >> np.uint64(64 - 21)).astype(np.int64)
    lookup[slot] = np.arange(len(head))
    twice = slot[1:][slot[1:] == slot[:-1]]
    lookup[twice] = -2
    return Codes(head, count, np.concatenate([o1, o1[-1] + o2[1:]]).astype(np.int32), np.concatenate([n1, n2 + (1 << 20)]).astype(np.int32), np.concatenate([b1, b2]), lookup)


@dataclass
class Tokens:
    """The tokens of a slice, ends included."""

    h: np.ndarray
    offs: np.ndarray
    start: np.ndarray  # bytes of a word in the slice; an end has none
    stop: np.ndarray


def tokens_of(s: X.Slice) -> Tokens:
    """s: lower-cased."""
    w = X.words(s)
    n = len(w.starts)
    offs = w.offs + np.arange(s.docs + 1)
    where = np.arange(n) + np.repeat(np.arange(s.docs), np.diff(w.offs))
    h, start, stop = np.full(n + s.docs, _END), np.zeros(n + s.docs, np.int64), np.zeros(n + s.docs, np.int64)
    h[where], start[where], stop[where] = X.span_hashes(s, w.starts, w.ends), w.starts, w.ends
    return Tokens(h, offs, start, stop)


@dataclass
class Bits:
    """Bits in text order: each with its table slots, gate, document and block in it."""

    bit: np.ndarray
    slots: tuple[np.ndarray, np.ndarray, np.ndarray]
    gate: np.ndarray | None = None
    doc: np.ndarray | None = None
    block: np.ndarray | None = None


def bits_of(s: X.Slice, t: Tokens, c: Codes, sym: np.ndarray, a: int, b: int, prev: np.ndarray, prev2: np.ndarray, doc: np.ndarray | None) -> Bits:
    """The bits of tokens a:b with their table slots (without doc, for training, they
    have no blocks)."""
    sym = sym[a:b]
    tail = np.flatnonzero(sym == c.escape)
    n_bytes = (t.stop - t.start)[a:b][tail] + 1
    n_events = np.ones(b - a, np.int64)
    n_events[tail] += n_bytes
    first = np.cumsum(n_events) - n_events
    total = int(n_events.sum())
    code = np.empty(total, np.int64)
    ctx = np.empty((3, total), np.uint64)
    code[first] = sym
    ctx[0][first] = 0
    ctx[1][first] = prev[a:b]
    ctx[2][first] = prev2[a:b]
    who = np.repeat(tail, n_bytes)
    inside = np.arange(len(who)) - np.repeat(np.cumsum(n_bytes) - n_bytes, n_bytes)
    at = first[who] + 1 + inside
    last = inside == np.repeat(n_bytes, n_bytes) - 1
    byte = np.where(last, TERMINATOR, s.data[np.minimum(t.start[a:b][who] + inside, len(s.data) - 1)].astype(np.int64)) if len(who) else np.zeros(0, np.int64)
    code[at] = byte + c.escape + 2
    seen = np.zeros(len(who), np.uint64)
    for k in range(SPELLING[2]):
        src = byte[: max(0, len(byte) - k - 1)].astype(np.uint64) + np.uint64(1)
        seen[k + 1 :] += np.where(inside[k + 1 :] > k, src, np.uint64(0)) * np.uint64(pow(300, k))
        for j in range(3):
            if SPELLING[j] == k + 1:
                ctx[j][at] = seen + np.uint64((j + 1) << 60)
    length = np.diff(c.offs)[code]
    n = int(length.sum())
    event = np.repeat(np.arange(total, dtype=np.int32), length)
    begin = (np.cumsum(length) - length).astype(np.int32)
    depth = np.arange(n, dtype=np.int32) - begin[event]
    path = c.offs[code][event] + depth
    node = c.nodes[path].view(np.uint32) * _NODE
    slots = []
    for k in range(3):
        x = (X.mix(ctx[k]) >> np.uint64(32)).astype(np.uint32)[event]
        x += node
        x *= _SPREAD
        x ^= x >> np.uint32(15)
        x *= _NODE
        x >>= np.uint32(32 - TABLE_BITS)
        slots.append(x.view(np.int32))
    if doc is None:
        return Bits(c.bits[path], tuple(slots))
    gate = np.zeros(n, np.int8)
    for d in DEPTHS:
        gate += depth >= d
    gate[(code > c.escape + 1)[event]] = GATES - 1
    token = np.repeat(np.arange(a, b), n_events)
    block = ((token - t.offs[doc[token]]) // BLOCK).astype(np.int32)
    return Bits(c.bits[path], tuple(slots), gate, doc[token].astype(np.int32)[event], block[event])


def contexts_of(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(one token back, two tokens back), starting afresh in each document."""
    prev, prev2 = np.full(len(t.h), _BEGIN), np.full(len(t.h), _BEGIN)
    prev[1:] = t.h[:-1]
    prev[t.offs[:-1]] = _BEGIN
    prev2[1:] = prev[:-1]
    prev2[t.offs[:-1]] = _BEGIN
    return prev, X.mix(prev * _A + prev2)


def _symbols(t: Tokens, c: Codes) -> np.ndarray:
    sym = c.find(t.h)
    sym[sym < 0] = c.escape
    sym[t.offs[1:] - 1] = c.escape + 1
    return sym


def _training_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[X.Slice]:
    for b in batches:
        keep = pa.array([not held_out(i) for i in b.column(0).to_pylist()], pa.bool_())
        for s in X.slices(b.column(1).filter(keep), SLICE_BYTES):
            yield s.lower()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): kind 0 tokens, kind 1 bytes of words (and
    terminators), added up within the task as far as memory goes."""

    def out(u: np.ndarray, n: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(u), kind, np.int8)), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    keys, ns, size = [], [], 0
    seen = np.zeros(256, np.int64)

    def merged() -> tuple[np.ndarray, np.ndarray]:
        u, inv = np.unique(np.concatenate(keys), return_inverse=True)
        return u, np.bincount(inv, np.concatenate(ns), len(u)).astype(np.int64)

    for s in _training_slices(batches):
        t = tokens_of(s)
        u, n = np.unique(t.h, return_counts=True)
        keys.append(u)
        ns.append(n)
        size += len(u)
        seen += np.bincount(s.data[X.NOT_SPACE[s.data]], minlength=256)
        seen[TERMINATOR] += len(t.h) - s.docs
        if size > FLUSH_WORDS:
            u, n = merged()
            keys, ns, size = [u], [n], len(u)
            if size > FLUSH_WORDS // 2:
                yield out(u, n, 0)
                keys, ns, size = [], [], 0
    if keys:
        yield out(*merged(), 0)
    yield out(np.arange(256, dtype=np.uint64), seen, 1)


def _chunks(t: Tokens, spelled: np.ndarray, limit: int = CHUNK_COST) -> list[tuple[int, int]]:
    """Token ranges of a cost of at most limit (spelled tokens cost a third of their bytes as
    well): whole documents, or parts of one at multiples of BLOCK from its start.  A
    single block may cost more."""
    cost = np.concatenate([[0], np.cumsum(1 + np.where(spelled, (t.stop - t.start + 1) // 3, 0))])
    out, a = [], 0
    for d in range(len(t.offs) - 1):
        lo, hi = int(t.offs[d]), int(t.offs[d + 1])
        if cost[hi] - cost[a] <= limit and hi - a <= CHUNK_TOKENS:
            continue
        if lo > a:
            out.append((a, lo))
        a = lo
        while cost[hi] - cost[a] > limit or hi - a > CHUNK_TOKENS:
            most = min(int(np.searchsorted(cost, cost[a] + limit, "right")) - 1 - a, CHUNK_TOKENS)
            step = min(max(most // BLOCK, 1) * BLOCK, hi - a)
            out.append((a, a + step))
            a += step
            if a == hi:
                break
        if a > lo and a < hi:
            out.append((a, hi))
            a = hi
    if a < len(t.h):
        out.append((a, len(t.h)))
    return out


def _tables(codes):
    """Rows (part, salt, blob): ranges of a task's tables of zeros and ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = _codes(codes.value)
        sums = np.zeros((3, 2 << TABLE_BITS), np.uint32)  # of one task
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def add() -> None:
            for k in range(3):
                if held[k]:
                    sums[k] += np.bincount(np.concatenate(held[k]), minlength=2 << TABLE_BITS).astype(np.uint32)
                held[k].clear()

        for s in _training_slices(batches):
            t = tokens_of(s)
            sym, (prev, prev2) = _symbols(t, c), contexts_of(t)
            for a, b in _chunks(t, sym == c.escape, TRAIN_COST):
                bits = bits_of(s, t, c, sym, a, b, prev, prev2, None)
                for k in range(3):
                    held[k].append(2 * bits.slots[k] + bits.bit)
                size += len(bits.bit)
                if size > HELD_BITS:
                    add()
                    size = 0
        add()
        yield _blobs(sums.reshape(3 * RANGES, -1), np.arange(3 * RANGES), TaskContext.get().partitionId() % 64)

    return run


def _pack(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs (which come first), byte planes
    apart, compressed."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(counts.max(initial=0)) < 1 << 8 * w)
    planes = np.ascontiguousarray(counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{blob[0]}").ravel().astype(np.uint64)


def _blobs(rows: np.ndarray, parts: np.ndarray, salt: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array(parts, pa.int32()), pa.array(np.full(len(parts), salt, np.int32)), pa.array([_pack(r) for r in rows], pa.binary())], ["part", "salt", "blob"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part: the sum of each part's blobs, one held at a time."""
    part, total = None, None
    for b in batches:
        for p, z in zip(b.column(0).to_pylist(), b.column(1)):
            row = _unpack(z.as_py())
            if p != part:
                if part is not None:
                    yield _blobs(total[None], np.array([part]), 0)
                part, total = p, row
            else:
                total += row
    if part is not None:
        yield _blobs(total[None], np.array([part]), 0)


def _codes(packed: bytes) -> Codes:
    return pickle.loads(zlib.decompress(packed))


_model: dict[str, tuple] = {}  # the last model that this process unpacked


def _unpacked(model: tuple[str, bytes, list[bytes], int]) -> tuple[Codes, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Codes, tables and logs of counts from (name, packed codes, packed parts, ends): it
    travels and lies on disk packed, a process unpacks it once."""
    name, packed, parts, ends = model
    if name not in _model:
        _model.clear()
        c = _codes(packed)
        pairs = np.empty((len(parts), (2 << TABLE_BITS) // RANGES), np.float32)
        for i, z in enumerate(parts):
            pairs[i] = _unpack(z)
        known = np.concatenate([c.count, [0, ends], np.zeros(256)])
        head_log = np.log10(known + 0.1), (known > 0).astype(np.float64)
        head_log[0][c.escape] = 0
        _model[name] = c, pairs.reshape(3, -1, 2), head_log
    return _model[name]


def predict(bits: Bits, pairs: np.ndarray) -> list[np.ndarray]:
    """The three predictors' stretched probabilities of a one, bit by bit."""
    p, out = np.float32(0.5), []
    for k in range(3):
        zero_one = pairs[k].take(bits.slots[k], 0)
        n1 = zero_one[:, 1]
        p = (n1 + (BACKOFF if k else np.float32(0.4)) * p) / (zero_one[:, 0] + n1 + (BACKOFF if k else np.float32(0.4)))
        p = np.clip(p, np.float32(1e-5), np.float32(1 - 1e-5))
        out.append(np.log(p / (1 - p)))
    return out


class Mixer:
    """The weights and maps of the documents of a slice."""

    def __init__(self, lengths: np.ndarray) -> None:
        docs = len(lengths)
        self.rank = np.empty(docs, np.int32)  # long documents first, so that a late block needs the front only
        self.rank[np.argsort(-lengths, kind="stable")] = np.arange(docs, dtype=np.int32)
        self.w = [np.tile(np.array([g[k] for g in START_WEIGHTS], np.float32), docs) for k in range(3)]
        self.map = np.tile((1 / (1 + np.exp(-(np.arange(CELLS + 1) - CELLS / 2) / 2))).astype(np.float32), docs * GATES)

    def score(self, bits: Bits, stretched: list[np.ndarray], logp: np.ndarray) -> None:
        """Adds each document's natural log probability of its bits to logp."""
        order = np.argsort(bits.block, kind="stable")
        at = self.rank[bits.doc[order]] * np.int32(GATES) + bits.gate[order]
        y, s = bits.bit[order].astype(np.float32), [x[order] for x in stretched]
        blocks = bits.block[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
        got = np.empty(len(y), np.float32)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if i < j:
                got[i:j] = self._block(at[i:j], y[i:j], [x[i:j] for x in s])
        np.maximum(got, np.float32(1e-6), out=got)
        logp += np.bincount(bits.doc[order], np.log(got), len(logp))

    def _block(self, at: np.ndarray, y: np.ndarray, s: list[np.ndarray]) -> np.ndarray:
        """The probability of each bit that came; then learns from them."""
        one = np.float32(1)
        x = self.w[0][at] * s[0]
        x += self.w[1][at] * s[1]
        x += self.w[2][at] * s[2]
        p = one / (one + np.exp(-x))
        x *= np.float32(2)
        x += np.float32(CELLS / 2)
        np.clip(x, np.float32(0), np.float32(CELLS - 0.001), out=x)
        cell = x.astype(np.int32)
        x -= cell
        cell += at * np.int32(CELLS + 1)
        low, high = self.map[cell], self.map[cell + 1]
        mixed = (p + low + x * (high - low)) * np.float32(0.5)
        # of sums over a block, one bit's part shrinks with their number
        n = np.bincount(at)
        err = (y - p) * np.float32(RATE)
        share = 16 / np.maximum(n, 16)
        for k in range(3):
            self.w[k][: len(n)] += np.bincount(at, err * s[k]) * share
        for c, now, part in ((cell, low, one - x), (cell + np.int32(1), high, x)):
            change = np.bincount(c, (y - now) * part)
            change *= MAP_RATE
            change /= 1 + MAP_RATE * np.bincount(c, part)
            self.map[: len(change)] += change
        return np.abs(one - y - mixed)


def _scores(shared):
    """Rows kind 0: (uid, doc_id, n_tokens, n_known, base, score) with the head
    tokens' part of base; kind 1: (uid, token, times) of the other tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, pairs, head_log = _unpacked(shared.value)
        uid = TaskContext.get().partitionId() << 33
        names = ["kind", "uid", "doc_id", "n_tokens", "n_known", "base", "score", "token"]
        for b in batches:
            for s in X.slices(b.column(1), SLICE_BYTES):
                ids = b.column(0).slice(s.first, s.docs)
                s = s.lower()
                t = tokens_of(s)
                sym, (prev, prev2) = _symbols(t, c), contexts_of(t)
                doc = np.repeat(np.arange(s.docs), np.diff(t.offs))
                logp, mixer = np.zeros(s.docs), Mixer(np.diff(t.offs))
                for a, e in _chunks(t, sym == c.escape):
                    bits = bits_of(s, t, c, sym, a, e, prev, prev2, doc)
                    mixer.score(bits, predict(bits, pairs), logp)
                base = np.bincount(doc, head_log[0][sym], s.docs)
                known = np.bincount(doc, head_log[1][sym], s.docs)
                uids = uid + np.arange(s.docs)
                uid += s.docs
                none = pa.nulls(s.docs, pa.int64())
                yield pa.record_batch([pa.array(np.zeros(s.docs, np.int8)), pa.array(uids), ids, pa.array(np.diff(t.offs)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(logp / np.log(10)), none], names)
                tail = np.flatnonzero(sym == c.escape)
                if len(tail):
                    h, d = t.h[tail], doc[tail]
                    order = np.lexsort((h, d))
                    h, d = h[order], d[order]
                    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
                    times = np.diff(np.concatenate([new, [len(h)]]))
                    none, nf = pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.float64())
                    yield pa.record_batch([pa.array(np.ones(len(new), np.int8)), pa.array(uids[d[new]]), none, pa.array(times), none, nf, nf, pa.array(h[new].view(np.int64))], names)

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score) of every document."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = docs.mapInArrow(_counts, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0")
    counted, _ = materialize(counted, "tokens")
    vocabulary = counted.where("kind = 0").select("key", "n")
    n_train, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    end_key = int(_END.view(np.int64))
    ends = (vocabulary.where(F.col("key") == end_key).head() or (0, 0))[1]
    top = vocabulary.where((F.col("key") != end_key) & (F.col("n") >= HEAD_LEAST)).orderBy(F.desc("n"), "key").limit(HEAD).toPandas()  # at most HEAD rows
    seen = np.zeros(256, np.int64)
    for r in counted.where("kind = 1").collect():  # at most 256 rows
        seen[r["key"]] = r["n"]
    head, count = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    codes = make_codes(head, count, n_train - ends - int(count.sum()), ends, seen)
    packed = zlib.compress(pickle.dumps(codes), 1)
    sent = spark.sparkContext.broadcast(packed)
    # 3 * RANGES blobs of 2 << TABLE_BITS counts in all, whatever the input
    parts = docs.mapInArrow(_tables(sent), "part int, salt int, blob binary")
    parts = parts.repartition("part", "salt").sortWithinPartitions("part").select("part", "blob").mapInArrow(_add_up, "part int, salt int, blob binary")
    parts = parts.repartition(3 * RANGES, "part").sortWithinPartitions("part").select("part", "blob").mapInArrow(_add_up, "part int, salt int, blob binary")
    blobs = [_pack(np.zeros((2 << TABLE_BITS) // RANGES, np.uint64))] * (3 * RANGES)
    for r in parts.select("part", "blob").collect():  # a row per part
        blobs[r["part"]] = bytes(r["blob"])
    sent.destroy()
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, packed, blobs, ends))
    rows, _ = materialize(docs.mapInArrow(_scores(shared), "kind byte, uid long, doc_id long, n_tokens long, n_known long, base double, score double, token long"), "scores")
    other = rows.where("kind = 1").select("uid", F.col("token").alias("key"), F.col("n_tokens").alias("times"))
    other = other.join(vocabulary, "key", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    per_token = float(np.log10(n_train + 0.1 * (distinct + 1)))
    out = rows.where("kind = 0").join(other, "uid", "left")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")) % 10 == 0
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
