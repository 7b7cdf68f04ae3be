"""Quality rules: fixed text rules, then a hashed word and character n-gram
logistic regression trained on labelled rows, calibrated, against fixed
probability thresholds.

Two models are trained (low quality, toxic) on at most TRAIN_ROWS labelled
documents, the ones of smallest hash, as far as TRAIN_BYTES reach; a quarter of
them calibrates (Platt).  Features are present or absent in a document: words,
pairs of words and character 3- and 5-grams of the lower-cased text, hashed to DIM;
all of them enter, scaled by the POWER of what the z value by which their document
frequencies in the two classes differ has above CHANCE, so that the many chance
differences (scale 0) don't drown a few real ones; their number has no cap.  The weights are learnt online (EPOCHS passes over the sample in one
order, averaged), the classes balanced.  Texts equal in all features count once.  Scoring covers every document in Arrow batches.

Defined cases: null or empty text has no words and fails the base rules; labels
without a document or with null values are ignored; repeated rows stay
repeated; of labels for one document that contradict each other the worst counts;
texts over LONGEST_TRAINED bytes are scored but not trained on; without labelled rows of both classes a model rejects nothing; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as X
from ._io import table

TRAIN_ROWS = 4000
DIM = 1 << 20
TRAIN_BYTES, LONGEST_TRAINED = 64 << 20, 1 << 20
EPOCHS, RATE = 12, 2.0
CHANCE, POWER = 3.5, 0.25
TRAIN_SLICE = 128 << 10
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
THRESHOLD = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHAR_IN_WORD = X.NOT_SPACE & ((np.arange(256) & 0xC0) != 0x80)
_GRAMS = (3, 5)


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of that many words found twice or more."""
    if len(h) <= window:
        return 0
    x = X.word_shingles(h, window)
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(x), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def features(s: X.Slice, w: X.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed feature) of every occurrence in a lower-cased slice."""
    doc_of_word = np.repeat(np.arange(s.docs), np.diff(w.offs))
    docs, idx = [doc_of_word], [h]
    if len(h) > 1:
        inner = doc_of_word[1:] == doc_of_word[:-1]
        docs.append(doc_of_word[1:][inner])
        idx.append(X.mix(h[:-1] * np.uint64(31) + h[1:])[inner])
    doc_of_byte = np.repeat(np.arange(s.docs, dtype=np.int32), np.diff(s.offs))
    for k in _GRAMS:
        m = len(s.data) - k + 1
        if m <= 0:
            continue
        x = np.full(m, k, np.uint64)
        for j in range(k):
            x *= np.uint64(0xD1342543DE82EF95)
            x += s.data[j : j + m]
        inner = doc_of_byte[:m] == doc_of_byte[k - 1 :]
        docs.append(doc_of_byte[:m][inner])
        idx.append((x ^ (x >> np.uint64(29)))[inner] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20))
    return np.concatenate(docs), (np.concatenate(idx) % np.uint64(DIM)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray | None  # of the DIM hashed features; None rejects nothing
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def logit(self, total: np.ndarray) -> np.ndarray:
        """From the sums of the weights of present features."""
        return total + self.bias

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * logit + self.b, -40, 40)))


def _featurised(texts: list[bytes | None]) -> list[np.ndarray]:
    """The distinct hashed features of each text."""
    out: list[np.ndarray] = []
    mark = np.zeros(DIM, bool)
    for s in X.slices(pa.array(texts, pa.large_binary()), TRAIN_SLICE):
        s = s.lower()
        w = X.words(s)
        d, i = features(s, w, X.span_hashes(s, w.starts, w.ends))
        order = np.argsort(d, kind="stable")
        for own in np.split(i[order], np.searchsorted(d[order], np.arange(1, s.docs))):
            mark[own] = True
            f = np.flatnonzero(mark)
            mark[f] = False
            out.append(f.astype(np.int32))
    return out


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) by Newton's method on Platt's smoothed targets."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, v = np.stack([s, np.ones_like(s)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        g = x.T @ (p - t) + 1e-3 * (v - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), g)
        v = v - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """rows: the features of each text; y: 1 for the class to reject.  Every fourth
    row of a class calibrates."""
    first: dict[bytes, int] = {}
    fresh = np.array([first.setdefault(r.tobytes() + bytes([c]), k) == k and len(r) > 0 for k, (r, c) in enumerate(zip(rows, y.tolist()))], bool)
    rank = np.zeros(len(y), np.int64)
    for c in (0, 1):
        rank[fresh & (y == c)] = np.arange((fresh & (y == c)).sum())
    held = fresh & (rank % 4 == 3)
    tr = np.flatnonzero(fresh & ~held)
    n = np.bincount(y[tr], minlength=2)
    if not n.all():
        return Model(None)
    df = np.zeros((2, DIM), np.float32)
    for k in tr:
        df[y[k], rows[k]] += 1
    pooled = df.sum(0) / np.float32(n.sum())
    z2 = (df[1] / np.float32(n[1]) - df[0] / np.float32(n[0])) ** 2 / (np.maximum(pooled * (1 - pooled), np.float32(1e-9)) * np.float32((1 / n).sum()))
    scale = np.maximum(np.sqrt(z2) - np.float32(CHANCE), 0) ** np.float32(POWER)
    used = {int(k): rows[k][scale[rows[k]] > 0] for k in tr}
    xs = {k: scale[f] for k, f in used.items()}
    size = np.float32(np.sqrt(np.mean([float(x @ x) for x in xs.values()])) + 1e-9)
    for x in xs.values():
        x /= size
    cost = n.sum() / (2 * n)
    w, total, bias, total_bias, t = np.zeros(DIM, np.float32), np.zeros(DIM, np.float32), 0.0, 0.0, 0
    order = np.random.Generator(np.random.PCG64(7)).permutation(tr).tolist()
    for e in range(EPOCHS):
        for k in order:
            f, x = used[k], xs[k]
            own = w[f]
            z = float(own @ x) + bias
            g = cost[y[k]] * (1 / (1 + np.exp(-min(max(z, -40.0), 40.0))) - y[k])
            rate = RATE / (1 + t / len(order)) / (1 + float(x @ x))
            w[f] = own - np.float32(rate * g) * x
            bias -= rate * g
            t += 1
        if 2 * e >= EPOCHS:
            total += w
            total_bias += bias
    w = total * scale / size / np.float32(EPOCHS // 2)
    bias = total_bias / (EPOCHS // 2)
    model = Model(w, float(bias))
    if len(np.unique(y[held])) == 2:
        at = np.flatnonzero(held)
        s = model.logit(np.array([w[rows[k]].sum(dtype=np.float64) for k in at]))
        mean = max(1e-6, float(np.abs(s).mean()))
        a, b = _platt(s / mean, y[held])
        if a > 0:
            model.a, model.b = a / mean, b
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, Model]:
    """(low quality, toxic) from at most TRAIN_ROWS labelled documents."""
    sample = labels.select(F.col("doc_id").alias("l_id"), "quality", "toxic").where("l_id is not null and quality is not null and toxic is not null")
    sample = sample.groupBy("l_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(TRAIN_ROWS)
    texts = docs.select(F.col(id_col).alias("l_id"), F.col(text_col).cast("string").cast("binary").alias("t")).where(F.octet_length("t") <= LONGEST_TRAINED)
    rows = texts.join(F.broadcast(sample), "l_id").orderBy(F.xxhash64("l_id"), "l_id", F.xxhash64("t")).limit(TRAIN_ROWS)
    so_far = Window.orderBy(F.xxhash64("l_id"), "l_id", F.xxhash64("t")).rowsBetween(Window.unboundedPreceding, 0)  # of at most TRAIN_ROWS rows
    rows = rows.withColumn("bytes", F.sum(F.octet_length("t")).over(so_far)).where(F.col("bytes") <= TRAIN_BYTES)
    models = {r["kind"]: r for r in rows.select("t", "quality", "toxic").mapInArrow(_learn, _FITTED).collect()}  # two rows
    return _model(models.get(0)), _model(models.get(1))


_FITTED = "kind int, feature array<int>, weight array<float>, bias double, a double, b double"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _FITTED: what the sample (one partition: TRAIN_ROWS, TRAIN_BYTES) tells of
    low quality (0) and toxic (1)."""
    texts, marks = [], ([], [])
    for b in batches:
        texts += _featurised(b.column(0).to_pylist())
        marks[0].extend(1 - int(q) for q in b.column(1).to_pylist())
        marks[1].extend(int(t) for t in b.column(2).to_pylist())
    for kind, y in enumerate(marks):
        m = fit(texts, np.array(y, np.int64))
        if m.weights is not None:
            f = np.flatnonzero(m.weights).astype(np.int32)
            columns = [[kind], [f], [m.weights[f]], [m.bias], [m.a], [m.b]]
            kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()), *[pa.float64()] * 3]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in _FITTED.split(", ")])


def _model(row: Row | None) -> Model:
    if row is None:
        return Model(None)
    w = np.zeros(DIM, np.float32)
    w[np.array(row["feature"], np.int64)] = row["weight"]
    return Model(w, row["bias"], row["a"], row["b"])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_low double, p_toxic double"


def _judge(raw: X.Slice, models: tuple[Model, Model]) -> dict[str, np.ndarray]:
    """The columns of SCHEMA after doc_id for the documents of a slice."""
    n = raw.docs
    w = X.words(raw)
    n_words = np.diff(w.offs)
    s = raw.lower()
    exact = X.span_hashes(raw, w.starts, w.ends)
    repeat = np.array([repeated_words(exact[w.offs[d] : w.offs[d + 1]]) for d in range(n)], np.int64)
    d, i = features(s, w, X.span_hashes(s, w.starts, w.ends))
    hit = np.zeros(DIM, bool)
    for m in models:
        if m.weights is not None:
            hit |= m.weights != 0
    at = np.flatnonzero(hit[i])
    d = d[at].astype(np.int64)
    d *= DIM
    d += i[at]
    del i, at
    d.sort()
    d = d[np.concatenate([[True], d[1:] != d[:-1]])] if len(d) else d
    offs = np.searchsorted(d, np.arange(n + 1) * DIM)
    d &= DIM - 1
    p = []
    for m in models:
        if m.weights is None:
            p.append(np.zeros(n))
            continue
        total = np.concatenate([[0.0], np.cumsum(m.weights[d], dtype=np.float64)])
        p.append(m.probability(m.logit(total[offs[1:]] - total[offs[:-1]])))
    del d
    failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": X.by_doc(_CHAR_IN_WORD[raw.data], raw.offs),
        "n_symbols": X.by_doc(_SYMBOL[raw.data], raw.offs),
        "n_dup_lines": np.array([repeated_lines(raw.text(d)) for d in range(n)], np.int64),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": ~failed & (p[0] < THRESHOLD) & (p[1] < THRESHOLD),
        "p_low": p[0],
        "p_toxic": p[1],
    }


def score(df: DataFrame, models: tuple[Model, Model], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA for every document."""
    shared = df.sparkSession.sparkContext.broadcast(models)  # two tables of DIM weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in X.slices(b.column(1)):
                out = _judge(raw, shared.value)
                yield pa.record_batch([b.column(0).slice(raw.first, raw.docs), *map(pa.array, out.values())], ["doc_id", *out])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(df: DataFrame, models: tuple[Model, Model], text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose verdict is kept."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in X.slices(b.column(at)):
                yield b.slice(raw.first, raw.docs).filter(pa.array(_judge(raw, shared.value)["kept"]))

    return df.mapInArrow(run, df.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
