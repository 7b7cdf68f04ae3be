"""Imputation fitted on training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.semantics import skipna_sum, uniform


def median_fill(fit: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    m = fit.agg(*[F.percentile(c, F.lit(0.5)).alias(f"_{c}") for c in cols])
    return df.crossJoin(F.broadcast(m)).select(*df.columns, *[F.coalesce(c, f"_{c}").alias(f"{c}_fill") for c in cols])


def constrained_clip(df: DataFrame, estimate: dict[str, Column], total: str, parts: Sequence[str]) -> DataFrame:
    """Estimates put where values are missing, clipped to what is possible: the
    total at least its observed parts, a part between 0 and what the total leaves
    (width of that interval only where a part was reconstructed)."""
    obs = skipna_sum(*parts)
    room = F.greatest(F.col(total) - obs, F.lit(0.0))
    fills = [F.coalesce(F.col(total), F.greatest(estimate[total], obs)).alias(f"{total}_fill")]
    for p in parts:
        est = F.greatest(estimate[p], F.lit(0.0))
        fills.append(F.coalesce(F.col(p), F.when(F.col(total).isNotNull(), F.least(est, room)).otherwise(est)).alias(f"{p}_fill"))
        fills.append(F.when(F.col(p).isNull() & F.col(total).isNotNull(), room).alias(f"{p}_width"))
    return df.select("*", *fills)


def chained_fill(fit: DataFrame, df: DataFrame, cols: Sequence[str], rounds: int = 3, ridge: float = 1e-3) -> DataFrame:
    """Iterative imputation: each column regressed on the others from sums over the
    fit rows, starting from medians; only missing cells change."""
    import numpy as np

    names = list(cols)
    med = fit.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in names]).head()
    value = {c: F.coalesce(F.col(c), F.lit(med[c])) for c in names}
    for _ in range(rounds):
        for c in names:
            others = [n for n in names if n != c]
            x = [F.lit(1.0), *[value[n] for n in others]]
            seen = fit.where(F.col(c).isNotNull())
            k = len(x)
            r = seen.agg(*[F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)], *[F.sum(x[i] * F.col(c)) for i in range(k)]).head()
            a = np.zeros((k, k))
            a[np.triu_indices(k)] = r[: k * (k + 1) // 2]
            a = a + np.triu(a, 1).T + ridge * np.eye(k)
            w = np.linalg.solve(a, np.array(r[k * (k + 1) // 2 :], float))
            est = sum((v * float(wi) for v, wi in zip([value[n] for n in others], w[1:])), F.lit(float(w[0])))
            df, fit = (d.withColumn(f"_i_{c}", F.coalesce(F.col(c), est)) for d in (df, fit))
            value[c] = F.col(f"_i_{c}")
    return df.select(*[c for c in df.columns if not c.startswith("_i_")], *[F.col(f"_i_{c}").alias(f"{c}_fill") for c in names])


def sample_fill(df: DataFrame, c: str, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Missing cells get the observed value at a hashed place of its distribution."""
    from pyspark.sql import Window

    pool = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    pool = pool.select("_v", (upto - F.col("_c")).alias("_lo"), upto.alias("_hi"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    n = pool.agg(F.max("_n").alias("_n"))
    want = df.where(F.col(c).isNull()).crossJoin(F.broadcast(n)).withColumn("_at", F.floor(uniform(id_col, seed) * F.col("_n")))
    got = want.drop("_n").join(F.broadcast(pool.drop("_n")), (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))).select(*df.columns, F.col("_v").alias(f"{c}_fill"))
    return df.where(F.col(c).isNotNull()).withColumn(f"{c}_fill", F.col(c)).unionByName(got)
