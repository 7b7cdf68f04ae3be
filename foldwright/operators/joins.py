"""Joins with their cardinality checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Left join in which a key of the right side may occur once only."""
    if check:
        n = right.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
        if n:
            raise ValueError(f"{key} is not unique on the right side")
    return left.join(right, key, "left")


def alignment(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """One row: how many wanted keys are missing, extra, duplicate."""
    g = given.groupBy(key).agg(F.count("*").alias("c"))
    j = wanted.select(key, F.lit(1).alias("w")).join(g, key, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return j.agg(n(F.col("c").isNull()).alias("missing"), n(F.col("w").isNull()).alias("extra"), n(F.coalesce(F.col("c") > 1, F.lit(False))).alias("duplicates"))


def align_or_fail(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    bad = alignment(wanted, given, key).head()
    if any(bad):
        raise ValueError(f"tables do not align on {key}: {bad.asDict()}")
    return wanted.join(given, key)


def labels_for(ids: DataFrame, source: DataFrame, key: str, label: str) -> DataFrame:
    """Labels of the ids; an id without one is an error."""
    out = ids.join(source.select(key, label), key, "left")
    if out.where(F.col(label).isNull()).limit(1).count():
        raise ValueError("an id has no label")
    return out
