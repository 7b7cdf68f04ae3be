"""Line dedup by pairwise alignment.

Documents that share a line, or a run of short lines, of MIN_WORDS words are aligned
with patience diff, and aligned common blocks of MIN_WORDS words or more are deleted
from the later document (the larger doc_id).

Partners.  A *seed* is a shortest run of consecutive lines with MIN_WORDS words, from
each line on and up to each line (mostly one line alone).  Its *owner* is the smallest
doc_id that has it.  A later document is aligned with the owner of each of its seeds,
rare or not: a seed in m documents makes m - 1 pairs and not m * (m - 1) / 2, and
none is too frequent.  That loses no block: every line of a block that some earlier
document has lies in a seed inside the block, and the seed's owner, earlier still, has
that seed as well.  Seeds with more than one in FREQUENT_SEEDS of all shared ones meet
their owners by broadcast (there are fewer than FREQUENT_SEEDS of them), so none fills
a task.

Alignment.  Patience diff anchors lines that are unique in both documents and works
between the anchors.  Then what it can't place, since it was moved against the order,
is repeated, or has no line that is unique in both, is aligned block by block: from the
first place in the earlier document of a seed, as far as the two run on alike.  So the
lines deleted are those in a run of lines, of MIN_WORDS words or more, that stands in
an earlier document, at any place.

Defined cases: null text stays null and has no lines; null ids have no
partners; rows of equal doc_id are no partners of each other, and a deletion
applies to a row only if the line at that place is the aligned one; lines without
a word are never deleted; an empty table gives no rows; of other columns, those
named in keep pass through, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._io import materialize, table

MIN_WORDS = 5
FREQUENT_SEEDS = 10_000


def line_spans(s: X.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, lines' offsets by document) of the \\n-split lines."""
    nl = np.flatnonzero(s.data == 10)
    full = np.flatnonzero(np.diff(s.offs) > 0)
    starts = np.sort(np.concatenate([s.offs[full], nl + 1]))
    ends = np.sort(np.concatenate([s.offs[full + 1], nl]))
    # lines of a document: its newlines and one more (none for an empty text)
    n = np.zeros(s.docs, np.int64)
    n[full] = np.searchsorted(nl, s.offs[full + 1]) - np.searchsorted(nl, s.offs[full]) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(n)])


def seed_runs(h: np.ndarray, words: np.ndarray, offs: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first line, last line) of the shortest runs of min_words words from
    each line with a word on, and up to each, within h[offs[d]:offs[d + 1]]."""
    n = len(h)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.flatnonzero(words > 0)
    end = np.searchsorted(total, total[at] + min_words) - 1  # last line of the run from at on
    ok = end < offs[doc[at] + 1] if n else np.zeros(0, bool)
    a, b = at[ok], end[ok]
    start = np.searchsorted(total, total[at + 1] - min_words, "right") - 1  # first line of the run up to at
    ok = (total[at + 1] >= min_words) & (start >= offs[doc[at]]) if n else ok
    a, b = np.concatenate([a, start[ok]]), np.concatenate([b, at[ok]])
    key = np.unique(a * np.int64(n + 1) + b)
    a, b = key // (n + 1), key % (n + 1)
    return doc[a], a, b


def run_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the line sequences h[a:b + 1]."""
    p, inv = X._powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(h) * p[: len(h)])])
    return X.mix((total[b + 1] - total[a]) * inv[a] + (b - a + 1).astype(np.uint64))


def _sequences(min_words: int):
    """Rows (doc_id, lines, n_words, seeds): the lines' hashes and words, and the distinct
    seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(1)):
                starts, ends, offs = line_spans(s)
                w = X.words(s)
                n_words = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
                h = X.span_hashes(s, starts, ends)
                doc, first, last = seed_runs(h, n_words, offs, min_words)
                seeds = run_hashes(h, first, last)
                order = np.lexsort((seeds, doc))
                doc, seeds = doc[order], seeds[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (seeds[1:] != seeds[:-1])]) if len(doc) else np.zeros(0, bool)
                doc, seeds = doc[new], seeds[new]
                at = np.searchsorted(doc, np.arange(s.docs + 1))
                columns = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, t)) for o, v, t in ((offs, h.view(np.int64), pa.int64()), (offs, n_words, pa.int32()), (at, seeds.view(np.int64), pa.int64()))]
                yield pa.record_batch([b.column(0).slice(s.first, s.docs), *columns], ["doc_id", "lines", "n_words", "seeds"])

    return run


def patience(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Index pairs of the lines that patience diff aligns, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        seen: dict[int, list[int]] = {}
        for i in range(a, b):
            seen.setdefault(x[i], [0, 0, 0, 0])[0] += 1
            seen[x[i]][1] = i
        for j in range(c, d):
            if x_at := seen.get(y[j]):
                x_at[2] += 1
                x_at[3] = j
        once = sorted((v[1], v[3]) for v in seen.values() if v[0] == 1 and v[2] == 1)
        if not once:
            continue
        tops: list[int] = []  # longest run rising in y, by patience piles
        top_at: list[int] = []
        back = [-1] * len(once)
        for k, (_, j) in enumerate(once):
            p = bisect_left(tops, j)
            back[k] = top_at[p - 1] if p else -1
            if p == len(tops):
                tops.append(j)
                top_at.append(k)
            else:
                tops[p], top_at[p] = j, k
        k = top_at[-1]
        e, f = b, d
        while k >= 0:
            i, j = once[k]
            out.append((i, j))
            todo.append((i + 1, e, j + 1, f))
            e, f = i, j
            k = back[k]
        todo.append((a, e, c, f))
    return sorted(out)


def common_blocks(x: list[int], words: list[int], y: list[int], min_words: int) -> list[int]:
    """Lines of x (with a word) in blocks of min_words words or more that are
    consecutive in both: the aligned ones, then those that were moved or repeated."""
    gone = [False] * len(x)
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(x, y), (-9, -9)]:
        if (i - 1, j - 1) != last:
            if sum(words[k] for k in run) >= min_words:
                for k in run:
                    gone[k] = True
            run = []
        run.append(i)
        last = (i, j)
    if not all(g or not w for g, w in zip(gone, words)):
        _moved(x, words, y, min_words, gone)
    return [k for k, g in enumerate(gone) if g and words[k]]


def _moved(x: list[int], words: list[int], y: list[int], min_words: int, gone: list[bool]) -> None:
    """Marks blocks of x that y has at any place, from the first place of a seed on."""
    known = dict(zip(x, words))
    other = [known.get(v, 0) for v in y]  # lines that x lacks part the runs of y
    absent = np.array([v not in known for v in y])

    def seeds(lines: list[int], n: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n = np.array(lines, np.int64).view(np.uint64), np.array(n, np.int64)
        _, a, b = seed_runs(h, n, np.array([0, len(h)]), min_words)
        return run_hashes(h, a, b), a, b

    hy, ay, by = seeds(y, other)
    missing = np.concatenate([[0], np.cumsum(absent)])
    ok = missing[by + 1] == missing[ay] if len(ay) else np.zeros(0, bool)
    hy, ay = hy[ok], ay[ok]
    order = np.argsort(hy, kind="stable")
    hy, ay = hy[order], ay[order]
    hx, ax, bx = seeds(x, words)
    at = np.searchsorted(hy, hx)
    for k in np.flatnonzero(at < len(hy)).tolist():
        if hy[at[k]] != hx[k]:
            continue
        a, b, c = int(ax[k]), int(bx[k]), int(ay[at[k]])
        if all(gone[i] or not words[i] for i in range(a, b + 1)):
            continue
        d = c + b - a
        while a and c and x[a - 1] == y[c - 1] and not gone[a - 1]:
            a, c = a - 1, c - 1
        while b + 1 < len(x) and d + 1 < len(y) and x[b + 1] == y[d + 1] and not gone[b + 1]:
            b, d = b + 1, d + 1
        gone[a : b + 1] = [True] * (b + 1 - a)


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, what = [], [], []
            for a in range(0, len(b), 256):
                part = b.slice(a, 256)
                for doc, x, n, y in zip(*(c.to_pylist() for c in part.columns)):
                    got = common_blocks(x, n, y, min_words)
                    ids += [doc] * len(got)
                    at += got
                    what += [x[k] for k in got]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(what, pa.int64())], ["doc_id", "at", "line"])

    return run


def deletions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, gone: array of (at, line)) of the lines to delete."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    seqs, _ = materialize(texts.mapInArrow(_sequences(min_words), "doc_id long, lines array<long>, n_words array<int>, seeds array<long>"), "lines")
    lines = seqs.select("doc_id", F.explode("seeds").alias("seed"))
    owners = lines.groupBy("seed").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("last > owner")
    owners, _ = materialize(owners.select("seed", "owner", "n"), "owners")
    total = owners.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    often = F.col("n") * FREQUENT_SEEDS > total
    frequent = F.broadcast(owners.where(often).select("seed", "owner"))  # fewer than FREQUENT_SEEDS rows
    rest = lines.join(frequent.select("seed"), "seed", "left_anti").join(owners.where(~often).select("seed", "owner"), "seed")
    pairs = lines.join(frequent, "seed").select("doc_id", "owner").unionByName(rest.select("doc_id", "owner")).where("doc_id > owner").distinct()
    x = seqs.select("doc_id", "lines", "n_words")
    y = seqs.select(F.col("doc_id").alias("owner"), F.col("lines").alias("before"))
    both = pairs.join(x, "doc_id").join(y, "owner").select("doc_id", "lines", "n_words", "before")
    gone = both.mapInArrow(_align(min_words), "doc_id long, at int, line long")
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("at", "line"))).alias("gone"))


_ID, _TEXT, _GONE, _LINES, _DELETED = (f"__fw_{c}" for c in ("id", "text", "gone", "lines", "deleted"))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (any columns, _TEXT, _GONE): with the rest of the text in _TEXT."""
    for b in batches:
        texts, n, k = [], [], []
        names = b.schema.names
        text_at, gone_at = names.index(_TEXT), names.index(_GONE)
        touched = b.column(gone_at).is_valid().to_pylist()
        for i, text in enumerate(b.column(text_at)):
            t = text.as_py()
            n.append(t.count("\n") + 1 if t else 0)
            gone: set[int] = set()
            if touched[i] and t:
                raw = t.encode()
                s = X.Slice(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                starts, ends, _ = line_spans(s)
                h = X.span_hashes(s, starts, ends).view(np.int64)
                gone = {g["at"] for g in b.column(gone_at)[i].as_py() if g["at"] < len(h) and h[g["at"]] == g["line"]}
            k.append(len(gone))
            texts.append("\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone) if gone else t)
        keep = [i for i in range(len(names)) if i not in (text_at, gone_at)]
        yield pa.record_batch([*[b.column(i) for i in keep], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], [*[names[i] for i in keep], _TEXT, _LINES, _DELETED])


def _rewritten(df: DataFrame, id_col: str, text_col: str, min_words: int, keep: list[str]) -> DataFrame:
    """The columns in keep (as __fw_0, __fw_1 ...), _ID, _TEXT, _LINES, _DELETED."""
    own = [F.col(c).alias(f"__fw_{i}") for i, c in enumerate(keep)]
    docs = df.select(*own, F.col(id_col).cast("long").alias(_ID), F.col(text_col).cast("string").alias(_TEXT))
    gone = deletions(df, id_col, text_col, min_words).select(F.col("doc_id").alias(_ID), F.col("gone").alias(_GONE))
    kinds = [f"__fw_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    joined = docs.join(gone, _ID, "left").select(*[f"__fw_{i}" for i in range(len(keep))], _ID, _TEXT, _GONE)
    return joined.mapInArrow(_rewrite, ", ".join([*kinds, f"{_ID} long, {_TEXT} string, {_LINES} long, {_DELETED} long"]))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every document with its remaining text: rows (doc_id, text, n_lines, n_deleted)."""
    out = _rewritten(df, id_col, text_col, min_words, [])
    return out.select(F.col(_ID).alias("doc_id"), F.col(_TEXT).alias("text"), F.col(_LINES).alias("n_lines"), F.col(_DELETED).alias("n_deleted"))


def keep_rest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, length_col: str | None = None) -> DataFrame:
    """The rows of df with all their columns and the remaining text (and its length in
    length_col); those of which only white space is left go."""
    keep = [c for c in df.columns if c != text_col]
    out = _rewritten(df, id_col, text_col, min_words, keep)
    out = out.where((F.col(_DELETED) == 0) | F.col(_TEXT).rlike(r"[^\x20\x09-\x0D]"))
    columns = []
    for c in df.columns:
        new = F.col(_TEXT) if c == text_col else F.col(f"__fw_{keep.index(c)}")
        if c == length_col:
            new = F.when(F.col(_DELETED) > 0, F.length(_TEXT)).otherwise(new)
        columns.append(new.cast(df.schema[c].dataType).alias(c))
    return out.select(*columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
