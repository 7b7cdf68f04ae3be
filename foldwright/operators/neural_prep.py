"""Preprocessing that tabular networks ask for, fitted from aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from foldwright.functions.semantics import normal_quantile


def knots(df: DataFrame, c: str, n: int) -> DataFrame:
    """Unique quantile knots as one array."""
    return df.agg(F.array_distinct(F.percentile(c, F.array(*[F.lit(i / (n - 1)) for i in range(n)]))).alias("knots"))


def quantile_bins(fit: DataFrame, df: DataFrame, c: str, n: int) -> DataFrame:
    """Index of the quantile bin (edges go to the upper bin)."""
    e = fit.agg(F.array_distinct(F.percentile(c, F.array(*[F.lit(i / n) for i in range(1, n)]))).alias("_e"))
    return df.crossJoin(F.broadcast(e)).withColumn(f"{c}_bin", F.when(F.col(c).isNotNull(), F.size(F.filter("_e", lambda x: x <= F.col(c))))).drop("_e")


def _placed(df: DataFrame, c: str, q: Sequence[float]) -> DataFrame:
    """df with _below and _upto: how many of the sorted q are less than c, and at most c."""
    edges = np.array(q, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("_x").to_numpy(zero_copy_only=False).astype(float)
            sides = [pa.array(np.searchsorted(edges, x, side).astype(np.int32)) for side in ("left", "right")]
            yield pa.record_batch([*b.columns[:-1], *sides], [*b.schema.names[:-1], "_below", "_upto"])

    schema = StructType([*df.schema.fields, StructField("_below", IntegerType()), StructField("_upto", IntegerType())])
    return df.withColumn("_x", F.col(c).cast("double")).mapInArrow(run, schema)


def rank_gauss(fit: DataFrame, df: DataFrame, c: str, n: int = 100) -> DataFrame:
    """Quantile transform to a normal: linear between n quantiles of the fit rows; NULL
    without fit rows.  Places among the quantiles are searched for in Arrow batches."""
    q = fit.agg(F.percentile(c, F.array(*[F.lit(i / (n - 1)) for i in range(n)])).alias("q")).head()["q"]
    if q is None:
        return df.withColumn(f"{c}_gauss", F.lit(None).cast("double"))
    d, edges = _placed(df, c, q), F.lit(q)
    x, below, upto = F.col(c), F.col("_below"), F.col("_upto")
    i = F.greatest(F.least(upto, F.lit(n - 1)), F.lit(1))
    d = d.withColumns({"_lo": F.get(edges, i - 1), "_hi": F.get(edges, i), "_i": i})
    lo, hi, i = F.col("_lo"), F.col("_hi"), F.col("_i")
    inner = (i - 1 + F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)) / (n - 1)
    tied = (below + upto - 1) / 2.0 / (n - 1)
    p = F.when(upto > below, tied).when(below == 0, 0.0).when(below == n, 1.0).otherwise(inner)
    d = d.withColumn("_p", F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7)))
    return d.withColumn(f"{c}_gauss", F.when(x.isNotNull(), normal_quantile("_p"))).select(*df.columns, f"{c}_gauss")


def robust_scale(fit: DataFrame, df: DataFrame, c: str) -> DataFrame:
    """Median, interquartile range (half range if that is 0), smooth clip."""
    s = fit.agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    iqr = F.col("_q")[2] - F.col("_q")[0]
    z = (F.col(c) - F.col("_q")[1]) / F.when(iqr > 0, iqr).when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / 2).otherwise(1.0)
    return df.crossJoin(F.broadcast(s)).withColumn(f"{c}_scaled", z / F.sqrt(1 + (z / 3) * (z / 3))).drop("_q", "_lo", "_hi")


def min_max(fit: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unclipped, 0 where missing, with a flag of being observed."""
    s = fit.agg(*[f(c).alias(f"_{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.coalesce(F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c) * 0), F.lit(0.0))

    d = df.crossJoin(F.broadcast(s))
    return d.select(*df.columns, *[scaled(c).alias(f"{c}_mm") for c in cols], *[F.col(c).isNotNull().cast("int").alias(f"{c}_observed") for c in cols])


def one_hot(df: DataFrame, c: str, values: Sequence[str]) -> list[Column]:
    """Unseen values are the zero vector."""
    return [F.coalesce(F.col(c) == v, F.lit(False)).cast("int").alias(f"{c}={v}") for v in values]


def first_seen_codes(df: DataFrame, c: str, order: str) -> DataFrame:
    """Rows (value, code) in order of first occurrence; code 0 is left for unknown."""
    g = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.min(order).alias("at"))
    return g.select("value", F.row_number().over(Window.orderBy("at", "value")).alias("code"))
