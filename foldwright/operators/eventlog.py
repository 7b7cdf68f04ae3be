"""Interval queries over execution event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, start: str, end: str, by: Sequence[str]) -> DataFrame:
    """Merged intervals (touching ones too): rows (by..., start, end)."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def covered(df: DataFrame, start: str, end: str, by: Sequence[str]) -> DataFrame:
    return islands(df, start, end, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def unclassified(parents: DataFrame, children: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parent time that no contained child covers: parents and children have columns
    by, start, end; parents an id."""
    p = parents.select(*by, "id", F.col("start").alias("ps"), F.col("end").alias("pe"))
    inside = p.join(children, list(by)).where((F.col("start") >= F.col("ps")) & (F.col("end") <= F.col("pe")))
    c = covered(inside, "start", "end", ["id"])
    return p.join(c, "id", "left").select("id", (F.col("pe") - F.col("ps") - F.coalesce("covered", F.lit(0))).alias("unclassified"))


def weighted_percentile(df: DataFrame, value: str, weight: str, q: float, by: Sequence[str]) -> DataFrame:
    """First value at which the cumulated weight reaches q of the total."""
    v = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by)
    cum = F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return v.withColumn("_c", cum).withColumn("_t", F.sum("_w").over(w)).where(F.col("_c") >= q * F.col("_t")).groupBy(*by).agg(F.min(value).alias("percentile"))


def nearest_rank(df: DataFrame, value: str, q: float, by: Sequence[str]) -> DataFrame:
    """The ceil(q n)-th smallest value."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_k", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return d.where(F.col("_k") == F.greatest(F.ceil(F.lit(q) * F.col("_n")), F.lit(1))).select(*by, F.col(value).alias("percentile"))


def running_best(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], gain: float = 1e-12) -> DataFrame:
    """Rows that strictly improve on all before them."""
    before = F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_b", before).where(F.col("_b").isNull() | (F.col(value) > F.col("_b") + gain)).drop("_b")


def step_metrics(df: DataFrame, kinds: Sequence[str], kind: str, value: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(F.when(F.col(kind) == k, F.col(value)).otherwise(0)).alias(f"{k}_total") for k in kinds])


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
