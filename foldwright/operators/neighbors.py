"""Nearest neighbours, kernel densities and empirical-Bayes means over a small
reference table."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.semantics import clip

#: Rows of a reference table that may travel to every executor.
REFERENCE_ROWS = 1_000_000
CHUNK_CELLS = 4_000_000


def knn_mean(ref: DataFrame, query: DataFrame, cols: Sequence[str], scale: DataFrame, label: str, k: int, id_col: str = "id") -> DataFrame:
    """Rows (id, nn<k>): mean label of the k nearest reference rows by the distance
    over the columns that both have; NULL for rows with none.  Ties by id.

    Rows of one point are equally far from any other, so of each reference point only the k
    smallest ids can be among the nearest, and each query point is looked up once.  What
    is left of the reference is counted; only up to REFERENCE_ROWS does it travel."""
    s = scale.head()
    first = Window.partitionBy(*cols).orderBy(id_col)
    near = ref.select(id_col, label, *cols).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n").persist()
    try:
        n = near.count()
        if n > REFERENCE_ROWS:
            raise ValueError(f"{n} reference rows; split the reference or index it")
        rows = near.orderBy(id_col).toPandas()
    finally:
        near.unpersist()
    pts = rows[list(cols)].to_numpy(float) / np.array([s[c] for c in cols])
    shared = query.sparkSession.sparkContext.broadcast((pts, rows[label].to_numpy(float)))
    widths = [float(s[c]) for c in cols]

    def run(batches):
        p, y = shared.value
        ok = ~np.isnan(p)
        p0 = np.where(ok, p, 0)
        for b in batches:
            q = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols]) / np.array(widths)
            out = np.full(len(q), np.nan)
            step = max(1, CHUNK_CELLS // max(1, len(p)))
            for a in range(0, len(q) if len(p) else 0, step):
                x = q[a : a + step]
                there = ~np.isnan(x)
                x0 = np.where(there, x, 0)
                d = np.zeros((len(x), len(p)))
                for j in range(len(cols)):
                    d += np.where(there[:, j, None] & ok[None, :, j], (x0[:, j, None] - p0[None, :, j]) ** 2, 0)
                out[a : a + step] = np.where(there.any(1), y[_smallest(np.rint(d * 1e9), k)].mean(1), np.nan)
            yield pa.record_batch([*[b.column(c) for c in cols], pa.array(out, from_pandas=True)], [*cols, f"nn{k}"])

    points = query.select(*[F.col(c).cast("double") for c in cols]).distinct()
    found = points.mapInArrow(run, ", ".join(f"`{c}` double" for c in cols) + f", nn{k} double").select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(cols)], f"nn{k}")
    same = [F.col(c).cast("double").eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(cols)]
    return query.select(id_col, *cols).join(found, same).select(id_col, f"nn{k}")


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest of each row, the first of equal ones; d is changed."""
    if k > 16 or not np.isfinite(d).all():
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    out, at = [], np.arange(len(d))
    for _ in range(min(k, d.shape[1])):
        out.append(d.argmin(1))
        d[at, out[-1]] = np.inf
    return np.column_stack(out)


def bandwidths(ref: DataFrame, x: str, y: str) -> DataFrame:
    """Silverman's rule per class, in [0.1, 1]; 0.3 for constant or lone values."""
    g = ref.where(F.col(x).isNotNull()).groupBy(y).agg(F.stddev_samp(x).alias("sd"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    spread = F.least("sd", (F.col("q")[1] - F.col("q")[0]) / 1.34)
    return g.select(y, F.when((F.col("n") > 1) & (spread > 0), clip(0.9 * spread * F.pow("n", F.lit(-0.2)), 0.1, 1.0)).otherwise(0.3).alias("h"), "n")


def kde_log_ratio(ref: DataFrame, query: DataFrame, x: str, y: str) -> DataFrame:
    """Per distinct value: log density of class 1 over class 0, within 20.  Reference
    rows are aggregated to (value, class, count) and meet only distinct values."""
    b = bandwidths(ref, x, y)
    r = ref.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_r"), y).agg(F.count("*").alias("_c")).join(F.broadcast(b), y)
    q = query.where(F.col(x).isNotNull()).select(x).distinct()
    z = (F.col(x) - F.col("_r")) / F.col("h")
    d = q.crossJoin(F.broadcast(r)).groupBy(x, y).agg((F.sum(F.col("_c") * F.exp(-0.5 * z * z) / (F.col("h") * math.sqrt(2 * math.pi))) / F.first("n")).alias("p"))
    side = lambda k: F.log(F.greatest(F.max(F.when(F.col(y) == k, F.col("p"))), F.lit(1e-300)))
    return d.groupBy(x).agg(clip(side(1) - side(0), -20.0, 20.0).alias("log_ratio"))


def auto_smoothed(df: DataFrame, key: str, y: str) -> DataFrame:
    """Empirical-Bayes target mean: each key's mean shrunk by the ratio of its
    variance to the overall variance."""
    g = df.agg(F.avg(y).alias("gm"), F.var_pop(y).alias("gv"))
    k = df.groupBy(key).agg(F.avg(y).alias("m"), F.var_pop(y).alias("v"), F.count("*").alias("n")).crossJoin(F.broadcast(g))
    lam = F.col("n") * F.col("gv")
    return k.select(key, F.when(F.col("gv") > 0, (lam * F.col("m") + F.col("v") * F.col("gm")) / (lam + F.col("v"))).otherwise(F.col("m")).alias("te"))
