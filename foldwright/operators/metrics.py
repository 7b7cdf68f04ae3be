"""Tie-aware ranking metrics, computed on distinct values per scope: rows are
aggregated to (scope, value) before any window, so a window never sees raw rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(value: str) -> Column:
    """A number that never falls as the value rises, with some 64 steps for each factor e
    of a value, and of its distance from 1 where it lies between 1/2 and 1.  Windows over a
    bucket and then over the buckets (a bounded number) stand for one over all values."""
    v = F.col(value).cast("double")
    steps = lambda x: F.floor(F.log(F.least(F.greatest(x, F.lit(1e-320)), F.lit(1e308))) * 64)
    # logarithms of doubles lie within 750, so zones are 100,000 apart
    zone = (
        F.when(v.isNull(), F.lit(-400_000))
        .when(F.isnan(v), F.lit(400_000))
        .when(v < 0, -200_000 - steps(-v))
        .when(v == 0, F.lit(-100_000))
        .when(v < 0.5, steps(v))
        .when(v < 1, 100_000 - steps(1 - v))
        .otherwise(200_000 + steps(v))
    )
    return zone.cast("int")


def running(counts: DataFrame, by: Sequence[str], value: str, sums: dict[str, str], whole: dict[str, str] | None = None) -> DataFrame:
    """counts (distinct values per by) with, for each column of sums, its sum over the
    smaller values of the group under the given name, and for those of whole (which sums
    has as well) its sum over the group."""
    key = [*by, "_bucket"]
    v = counts.withColumn("_bucket", bucket(value))
    inside = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = v.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums])
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_s{i}") for i, c in enumerate(sums)], *[F.sum(c).over(Window.partitionBy(*by)).alias(n) for c, n in (whole or {}).items()])
    j = v.join(totals, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    return j.select(*counts.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_s{i}")).alias(n) for i, (c, n) in enumerate(sums.items())], *(whole or {}).values())


def auc(df: DataFrame, pred: str, y: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Rows (by..., n, auc): weighted Mann-Whitney with ties as halves; NULL where
    one class is empty."""
    w = weight if weight is not None else F.lit(1.0)
    vals = df.groupBy(*by, F.col(pred).alias("_v")).agg(F.sum(w * F.col(y)).alias("_p"), F.sum(w * (1 - F.col(y))).alias("_n"), F.count("*").alias("_c"))
    none = F.lit(0.0)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    vals = vals.withColumn("_bucket", bucket("_v")).withColumn("_b", F.coalesce(F.sum("_n").over(inside), none))
    sums = [F.sum(c).alias(c) for c in ("_c", "_p", "_n")]
    part = vals.groupBy(*by, "_bucket").agg(*sums, F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2)).alias("_u"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_u", F.col("_u") + F.col("_p") * F.coalesce(F.sum("_n").over(before), none))
    t = part.groupBy(*by).agg(*sums, F.sum("_u").alias("_u"))
    return t.select(*by, F.col("_c").alias("n"), F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))


def auc_per_fold_and_overall(df: DataFrame, pred: str, y: str, fold: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """One pass: every row counts in its fold and in scope 'all'."""
    scoped = df.withColumn("scope", F.explode(F.array(F.col(fold).cast("string"), F.lit("all"))))
    return auc(scoped, pred, y, [*by, "scope"])


def average_rank(value: str, by: Sequence[str], name: str = "rank") -> "_Ranked":
    return _Ranked(value, list(by), name)


class _Ranked:
    def __init__(self, value: str, by: list[str], name: str):
        self.value, self.by, self.name = value, by, name

    def over(self, df: DataFrame) -> DataFrame:
        """df with the average rank of value within by, and the group's size, from
        the table of distinct values."""
        v = df.groupBy(*self.by, self.value).agg(F.count("*").alias("_c"))
        v = running(v, self.by, self.value, {"_c": "_less"}, {"_c": "_size"})
        v = v.withColumn(self.name, F.col("_less") + (F.col("_c") + 1) / 2).drop("_c", "_less")
        return df.join(v, [*self.by, self.value])


def rank_pct(df: DataFrame, value: str, by: Sequence[str], name: str = "pct") -> DataFrame:
    """Average-tie rank divided by the group's size; the group is the population."""
    return average_rank(value, by, "_r").over(df).withColumn(name, F.col("_r") / F.col("_size")).drop("_r", "_size")


def half_step_rank(df: DataFrame, value: str, by: Sequence[str], name: str = "half") -> DataFrame:
    return average_rank(value, by, "_r").over(df).withColumn(name, (F.col("_r") - 0.5) / F.col("_size")).drop("_r", "_size")


def deterministic_rank(df: DataFrame, value: str, tie: str, by: Sequence[str], name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn(name, (F.row_number().over(w.orderBy(value, tie)) - 0.5) / F.count("*").over(w))


def kish(w: str) -> Column:
    return F.sum(w) * F.sum(w) / F.sum(F.col(w) * F.col(w))


def spearman_pairs(long: DataFrame, id_col: str, member: str, value: str) -> DataFrame:
    """Rows (a, b, rho) of all pairs of members: Pearson of average ranks."""
    r = average_rank(value, [member], "_r").over(long).select(id_col, member, "_r")
    l, s = r.select(id_col, F.col(member).alias("a"), F.col("_r").alias("x")), r.select(id_col, F.col(member).alias("b"), F.col("_r").alias("y"))
    return l.join(s, id_col).where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("rho"))


def kendall(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-a and inversions of a small table, by a theta self-join."""
    l, r = df.select(F.col(key).alias("k1"), F.col(x).alias("x1"), F.col(y).alias("y1")), df.select(F.col(key).alias("k2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    s = F.signum((F.col("x1") - F.col("x2")) * (F.col("y1") - F.col("y2")))
    return l.join(r, F.col("k1") < F.col("k2")).agg(F.sum((s < 0).cast("long")).alias("inversions"), (F.sum(s) / F.count("*")).alias("tau"))


def theil_sen(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Median of the slopes of all pairs."""
    l, r = df.select(*by, F.col(x).alias("x1"), F.col(y).alias("y1")), df.select(*by, F.col(x).alias("x2"), F.col(y).alias("y2"))
    both = l.join(r, list(by)) if by else l.join(r, F.col("x1") < F.col("x2"))
    slopes = both.where("x1 < x2").select(*by, ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("s"))
    return slopes.groupBy(*by).agg(F.percentile("s", F.lit(0.5)).alias("slope"), F.count("*").alias("pairs"))


def ecdf(ref: DataFrame, query: DataFrame, x: str, keep: Sequence[str]) -> DataFrame:
    """(left + right) / 2n of query values in the reference distribution, clipped to
    half a step: a union and running sums over distinct values, no range join."""
    v = ref.where(F.col(x).isNotNull()).select(F.col(x).alias("_v"), F.lit(1).alias("_r")).unionByName(query.select(F.col(x).alias("_v"), F.lit(0).alias("_r")))
    d = v.where(F.col("_v").isNotNull()).groupBy("_v").agg(F.sum("_r").alias("_r"))
    d = running(d, [], "_v", {"_r": "_left"}).crossJoin(F.broadcast(d.agg(F.sum("_r").alias("_n"))))  # one row
    p = (2 * F.col("_left") + F.col("_r")) / (2 * F.col("_n"))
    d = d.select(F.col("_v").alias(x), F.greatest(F.least(p, 1 - 0.5 / F.col("_n")), 0.5 / F.col("_n")).alias("ecdf"))
    return query.join(d, x, "left").select(*keep, "ecdf")


def class_ecdf_difference(ref: DataFrame, query: DataFrame, x: str, y: str, keep: Sequence[str]) -> DataFrame:
    """F0(x) - F1(x), right-inclusive; missing stays missing."""
    r = ref.where(F.col(x).isNotNull()).select(F.col(x).alias("_v"), (1 - F.col(y)).alias("_0"), F.col(y).alias("_1"))
    v = r.unionByName(query.where(F.col(x).isNotNull()).select(F.col(x).alias("_v"), F.lit(0).alias("_0"), F.lit(0).alias("_1")))
    d = v.groupBy("_v").agg(F.sum("_0").alias("_0"), F.sum("_1").alias("_1"))
    total = d.agg(F.sum("_0").alias("_t0"), F.sum("_1").alias("_t1"))
    d = running(d, [], "_v", {"_0": "_b0", "_1": "_b1"}).crossJoin(F.broadcast(total))  # one row
    d = d.select(F.col("_v").alias(x), ((F.col("_b0") + F.col("_0")) / F.col("_t0") - (F.col("_b1") + F.col("_1")) / F.col("_t1")).alias("cdf_diff"))
    return query.join(d, x, "left").select(*keep, "cdf_diff")


def rank_burden(df: DataFrame, pred: str, y: str, keep: Sequence[str]) -> DataFrame:
    """Share of the opposite class that a row is ordered wrongly against (ties
    half); its mean within a class is 1 - AUC."""
    v = df.groupBy(F.col(pred).alias("_v")).agg(F.sum(y).alias("_p"), F.sum(1 - F.col(y)).alias("_n"))
    total = v.agg(F.sum("_p").alias("_pt"), F.sum("_n").alias("_nt"))
    v = running(v, [], "_v", {"_p": "_pb", "_n": "_nb"}).crossJoin(F.broadcast(total)).withColumnRenamed("_v", pred)  # one row
    pos = (F.col("_nt") - F.col("_nb") - F.col("_n") / 2) / F.col("_nt")
    neg = (F.col("_pb") + F.col("_p") / 2) / F.col("_pt")
    return df.join(v, pred).select(*keep, F.when(F.col(y) == 1, pos).otherwise(neg).alias("burden"))
