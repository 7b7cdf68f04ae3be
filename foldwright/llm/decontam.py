"""Benchmark decontamination: BM25 index of test items, block-max WAND.

Every window of WINDOW words (stride half of it) of every document is a query
against an inverted index of the test items.  An impact is a term's BM25 weight
in an item divided by the item's score against itself, so one threshold TAU
serves all items.  Bounds are applied in WAND's order, vectorised over all
windows of a slice: (1) the sum of the best impacts of a window's terms; (2) the
sum of their best impacts in each block of BLOCK items; (3) the exact score, only
in blocks that pass.  A window and item above TAU are then verified: of the
item's 5-word shingles at least OVERLAP, and of the words of its question and
of its answer (last sentence, or last quarter) at least PART_OVERLAP each, must
be in the window.

Words are runs of ASCII letters and digits and of all other non-ASCII bytes,
A-Z lower-cased, so decoration beside a word doesn't hide it.

Where WAND moves cursors to a pivot, all windows of a slice are bounded at once by
the same sums; a posting is read only if its window and block passed.

Items are indexed by length, so that half a window is never shorter than the longest
item of its index.  Word frequencies and the mean length are those of all items.  The
indexes of at most SHARD_ITEMS items or so are sent to the executors at once; more
items are queried in several passes, with the same scores.

Defined cases: null or empty texts match nothing, nor do items without words;
items with fewer than 5 words count as one shingle; repeated items and rows
give repeated results; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._io import table

K1, B = 1.2, 0.75
TAU = 0.6
OVERLAP, PART_OVERLAP = 0.8, 0.8
HALF_WINDOW = 64
BLOCK = 16
SHARD_ITEMS = 20_000
SCHEMA = "doc_id long, item_id long, first_word long, bm25 double, overlap double, question_overlap double, answer_overlap double"


def _hashes(text: bytes) -> np.ndarray:
    s = X.Slice(0, X.LOWER[np.frombuffer(text, np.uint8)], np.array([0, len(text)]))
    w = X.words(s, X.ALNUM)
    return X.span_hashes(s, w.starts, w.ends)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence, or of a lone one the last quarter."""
    parts = [m for m in re.split(r"(?<=[.!?])\s+", text.strip()) if m]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    k = max(1, len(words) // 4)
    return " ".join(words[:-k]), " ".join(words[-k:])


@dataclass
class Index:
    ids: list
    terms: np.ndarray  # sorted word hashes
    best: np.ndarray  # best impact of a term
    block_offs: np.ndarray  # blocks of term t: block_offs[t]:block_offs[t + 1]
    blocks: np.ndarray
    block_best: np.ndarray
    post_offs: np.ndarray  # postings of term t
    items: np.ndarray
    impact: np.ndarray
    shingles: list[np.ndarray]
    question: list[np.ndarray]
    answer: list[np.ndarray]
    half: int


class Stats:
    """What BM25 takes from all items: their number and words, and how many have each
    word (one number for each distinct word of the benchmark)."""

    def __init__(self) -> None:
        self.n, self.words = 0, 0
        self.terms, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, items: list[tuple]) -> "Stats":
        held = [np.unique(h) for _, t in items if len(h := _hashes((t or "").encode()))]
        self.n += len(held)
        self.words += sum(len(_hashes((t or "").encode())) for _, t in items)
        if held:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            terms, at = np.unique(np.concatenate([self.terms, u]), return_inverse=True)
            self.terms, self.df = terms, np.bincount(at, np.concatenate([self.df, c])).astype(np.int64)
        return self


def build(items: list[tuple], stats: Stats | None = None) -> list[Index]:
    """Of (item_id, text): an index of those of up to HALF_WINDOW words, one of those of
    up to twice as many, and so on, so that a long item widens no other's window; those
    without words are left out."""
    stats = stats or Stats().add(items)
    rows = [(i, h, t) for i, t in items if len(h := _hashes((t or "").encode()))]
    level = [max(0, (len(h) - 1) // HALF_WINDOW).bit_length() for _, h, _ in rows]
    return [_index([r for r, v in zip(rows, level) if v == k], stats, HALF_WINDOW << k) for k in sorted(set(level))]


def _index(rows: list[tuple], stats: Stats, half: int) -> Index:
    n = len(rows)
    size = np.array([len(h) for _, h, _ in rows])
    terms = np.unique(np.concatenate([h for _, h, _ in rows]))
    term, item, tf = [], [], []
    for k, (_, h, _) in enumerate(rows):
        u, c = np.unique(h, return_counts=True)
        term.append(np.searchsorted(terms, u))
        item.append(np.full(len(u), k))
        tf.append(c)
    term, item, tf = np.concatenate(term), np.concatenate(item), np.concatenate(tf)
    df = stats.df[np.searchsorted(stats.terms, terms)]
    weight = np.log1p((stats.n - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / (stats.words / stats.n)))
    impact = weight / np.bincount(item, weight, n)[item]
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    best = np.zeros(len(terms))
    np.maximum.at(best, term, impact)
    key, at = np.unique(term * (n // BLOCK + 1) + item // BLOCK, return_inverse=True)
    block_best = np.zeros(len(key))
    np.maximum.at(block_best, at, impact)
    parts = [split_item(t) for _, _, t in rows]
    return Index(
        [r[0] for r in rows], terms, best,
        np.searchsorted(key // (n // BLOCK + 1), np.arange(len(terms) + 1)), key % (n // BLOCK + 1), block_best,
        np.searchsorted(term, np.arange(len(terms) + 1)), item, impact,
        [np.unique(X.word_shingles(h)) for _, h, _ in rows],
        [np.unique(_hashes(q.encode())) for q, _ in parts], [np.unique(_hashes(a.encode())) for _, a in parts],
        half,
    )


def _expand(offs: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entry of t, position) for all of offs[t]:offs[t + 1]."""
    n = offs[t + 1] - offs[t]
    who = np.repeat(np.arange(len(t)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offs[t], n)


def search(x: Index, term: np.ndarray, half: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, score) above TAU.  term: of each indexed word; half: the
    half window that it is in; window w is the half windows w and w + 1, where
    last[w] tells that w is the last half of its document."""
    T = max(1, len(x.terms))
    own = np.unique(half * T + term)
    w = own // T
    before = own[(w > 0) & ~last[np.maximum(w - 1, 0)]] - T
    key = np.unique(np.concatenate([own, before]))
    win, term = key // T, key % T
    n = len(last)
    ok = (np.bincount(win, x.best[term], n) >= TAU)[win]  # 1: WAND's bound
    win, term = win[ok], term[ok]
    nb = len(x.ids) // BLOCK + 1
    who, at = _expand(x.block_offs, term)  # 2: bounds by block
    wb, inv = np.unique(win[who] * nb + x.blocks[at], return_inverse=True)
    live = wb[np.bincount(inv, x.block_best[at], len(wb)) >= TAU]
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ok = np.isin(win, live // nb)
    win, term = win[ok], term[ok]
    who, at = _expand(x.post_offs, term)  # 3: exact scores
    ok = np.isin(win[who] * nb + x.items[at] // BLOCK, live)
    who, at = who[ok], at[ok]
    m = len(x.ids)
    wi, inv = np.unique(win[who] * m + x.items[at], return_inverse=True)
    score = np.bincount(inv, x.impact[at], len(wi))
    ok = score >= TAU
    return wi[ok] // m, wi[ok] % m, score[ok]


def _share(part: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(part, there).mean()) if len(part) else 1.0


@dataclass
class Read:
    """The words of a slice's documents."""

    h: np.ndarray
    offs: np.ndarray
    doc_of: np.ndarray

    @staticmethod
    def of(s: X.Slice) -> "Read":
        s = s.lower()
        w = X.words(s, X.ALNUM)
        return Read(X.span_hashes(s, w.starts, w.ends), w.offs, np.repeat(np.arange(s.docs), np.diff(w.offs)))


def _query(r: Read, x: Index) -> Iterator[tuple]:
    """(document, item, first word, score, overlaps) verified in a slice."""
    h, offs = r.h, r.offs
    halves = np.maximum(1, -(-np.diff(offs) // x.half))
    first = np.concatenate([[0], np.cumsum(halves)])
    at = np.searchsorted(x.terms, h)
    at[at == len(x.terms)] = 0
    hit = np.flatnonzero(x.terms[at] == h)
    doc = r.doc_of[hit]
    half = first[doc] + (hit - offs[doc]) // x.half
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    found: dict[tuple[int, int], tuple] = {}
    for win, item, score in zip(*search(x, at[hit], half, last)):
        d = int(np.searchsorted(first, win, "right")) - 1
        a = offs[d] + (win - first[d]) * x.half
        seen = h[a : min(a + 2 * x.half, offs[d + 1])]
        overlap = _share(x.shingles[item], X.word_shingles(seen))
        if overlap >= OVERLAP and min(q := _share(x.question[item], seen), k := _share(x.answer[item], seen)) >= PART_OVERLAP:
            new = (d, int(item), int(a - offs[d]), float(score), overlap, q, k)
            if (d, item) not in found or new[3] > found[d, item][3]:
                found[d, item] = new
    yield from found.values()


def _shards(items: DataFrame, item_col: str, text_col: str) -> list[Broadcast]:
    """Indexes of about SHARD_ITEMS items each, sent to the executors."""
    spark = items.sparkSession
    bench = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    n = max(1, -(-bench.count() // SHARD_ITEMS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    rows = lambda k: [tuple(r) for r in bench.where(part == k).orderBy("item_id", "text").collect()]  # noqa: E731  about SHARD_ITEMS
    stats = Stats()
    for k in range(n):
        stats.add(rows(k))
    return [spark.sparkContext.broadcast(build(rows(k), stats)) for k in range(n)]


def match(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA: the best window of every verified (document, item)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def one(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                for s in X.slices(b.column(1)):
                    r = Read.of(s)
                    rows = [(ids[s.first + d], x.ids[i], *rest) for x in shared.value for d, i, *rest in _query(r, x)]
                    if rows:
                        kinds = [pa.int64()] * 3 + [pa.float64()] * 4
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

        return docs.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, map(one, _shards(items, item_col, item_text_col)))


def keep_clean(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, in which no item is found.  Each row is
    judged by its own text, so ids may be null or repeated; nothing is joined."""
    at = df.columns.index(text_col)

    def without(rest: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in X.slices(b.column(at)):
                    clean, r = np.ones(s.docs, bool), Read.of(s)
                    for x in shared.value:
                        for d, *_ in _query(r, x):
                            clean[d] = False
                    yield b.slice(s.first, s.docs).filter(pa.array(clean))

        return rest.mapInArrow(run, df.schema)

    return reduce(without, _shards(items, item_col, item_text_col), df)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
