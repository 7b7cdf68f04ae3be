"""Folds, replicas, masks and bootstraps by hash: the draws depend on row and seed
only, not on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.semantics import uniform
from foldwright.operators.metrics import auc, running


def stratified_folds(df: DataFrame, y: str, k: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    order = F.pmod((F.col(id_col) + seed) * 2654435761, F.lit(1000003))
    return df.withColumn("cv", ((F.row_number().over(Window.partitionBy(y).orderBy(order, id_col)) - 1) % k).cast("int"))


def replicate_and_mask(df: DataFrame, cols: Sequence[str], replicas: int, p: float, id_col: str = "id", seed: int = 0) -> DataFrame:
    """The original rows, then replicas in which each observed cell is missing with
    probability p; parent_id says of which row."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(replicas)))
    out = df.withColumn("replica", rep)
    key = F.col(id_col) * (replicas + 1) + F.col("replica")
    masked = [F.when((F.col("replica") > 0) & (uniform(key, seed + 31 * i) < p), F.lit(None)).otherwise(F.col(c)).alias(c) for i, c in enumerate(cols)]
    name = F.when(F.col("replica") == 0, F.concat(F.lit("original:"), F.col(id_col))).otherwise(F.concat(F.lit("replica-"), F.col("replica"), F.lit(":"), F.col(id_col)))
    return out.select(name.alias("row_id"), F.col(id_col).alias("parent_id"), "replica", *masked)


def donor_masks(df: DataFrame, cols: Sequence[str], accept: float, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Each row borrows the missing mask of the row before it in a hashed order, and
    a donor's missing column is taken over with probability accept."""
    order = F.pmod((F.col(id_col) + seed) * 2654435761, F.lit(1000003))
    bucket = F.pmod(F.col(id_col), F.lit(64))  # donors within a bucket: no single-partition window
    w = Window.partitionBy("_b").orderBy(order, id_col)
    flags = [F.lag(F.col(c).isNull().cast("int")).over(w).alias(f"_d_{c}") for c in cols]
    d = df.withColumn("_b", bucket).select("*", *flags)
    masked = [F.when((F.col(f"_d_{c}") == 1) & (uniform(id_col, seed + 7 * i) < accept), F.lit(None)).otherwise(F.col(c)).alias(c) for i, c in enumerate(cols)]
    return d.select(*[c for c in df.columns if c not in cols], *masked)


def poisson_one(u: Column, most: int = 6) -> Column:
    """Poisson(1) by inverse distribution (an approximation of multinomial draws)."""
    p, cdf, out = 0.36787944117144233, 0.0, F.lit(most)
    steps = []
    for k in range(most):
        cdf += p
        steps.append((cdf, k))
        p /= k + 1
    for cdf, k in reversed(steps):
        out = F.when(u < cdf, k).otherwise(out)
    return out


def bootstrap_weights(df: DataFrame, replicates: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Rows times replicates with weight w; the same rows weigh the same in every
    arm.  Replicate 0 has all weights 1."""
    b = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    u = uniform(F.pmod(id_col, F.lit(2147483648)) * 7919 + F.col("replicate") * 104729, seed)  # as uniform reduces it
    return b.withColumn("w", F.when(F.col("replicate") == 0, 1).otherwise(poisson_one(u)))


def paired_bootstrap(a: DataFrame, replicates: int, arms: Sequence[str], y: str = "y", seed: int = 0) -> DataFrame:
    """Rows (replicate, delta) of the weighted AUCs of two prediction columns."""
    b = bootstrap_weights(a, replicates, seed=seed).unpivot(["id", y, "replicate", "w"], list(arms), "arm", "pred")
    s = auc(b, "pred", y, ["replicate", "arm"], F.col("w").cast("double"))
    p = s.groupBy("replicate").pivot("arm", list(arms)).agg(F.first("auc"))
    return p.select("replicate", (F.col(arms[1]) - F.col(arms[0])).alias("delta"))


def summary(deltas: DataFrame) -> DataFrame:
    d = deltas.where("replicate > 0")
    return d.agg(*[F.percentile("delta", F.lit(q)).alias(n) for n, q in (("lo95", 0.025), ("median", 0.5), ("hi95", 0.975))], F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), F.avg((F.col("delta") <= 0).cast("double")).alias("share_le_0"))


def null_band(df: DataFrame, columns: int, y: str = "y", id_col: str = "id") -> DataFrame:
    """Smallest and largest AUC of random columns."""
    r = df.withColumn("null_id", F.explode(F.sequence(F.lit(1), F.lit(columns))))
    r = r.withColumn("pred", F.pmod((F.col(id_col) + F.col("null_id") * 101) * 2654435761, F.lit(1000003)) / 1000003.0)
    return auc(r, "pred", y, ["null_id"]).agg(F.min("auc").alias("lo"), F.max("auc").alias("hi"))


def split_trials(long: DataFrame, trials: int, weights: Sequence[float], y: str = "y") -> DataFrame:
    """Per trial: the blend weight that is best on one hashed half, and its AUC on
    the other.  long has columns id, y, a, b."""
    t = long.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("w", F.explode(F.array(*[F.lit(w) for w in weights])))
    t = t.withColumn("part", (uniform(F.col("id") * 31 + F.col("trial") * 7907, 5) < 0.5).cast("int")).withColumn("pred", F.rint(((1 - F.col("w")) * F.col("a") + F.col("w") * F.col("b")) * 1e9) / 1e9)
    s = auc(t, "pred", y, ["trial", "w", "part"])
    p = s.groupBy("trial", "w").pivot("part", [0, 1]).agg(F.first("auc"))
    k = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("0"), "w"))
    return p.withColumn("k", k).where("k = 1").select("trial", "w", F.col("1").alias("held_auc"))


def permute(df: DataFrame, c: str, shift: int, id_col: str = "id") -> DataFrame:
    """Column c moved by shift rows in the order of ids, for permutation importance."""
    n = running(df.select(id_col, F.col(c).alias("_v"), F.lit(1).alias("_one")), [], id_col, {"_one": "_less"}, {"_one": "_n"})
    n = n.withColumn("_k", F.col("_less") + 1)
    src = n.select(((F.col("_k") + shift - 1) % F.col("_n") + 1).alias("_k"), F.col("_v").alias("_p"))
    return df.join(n.select(id_col, "_k").join(src, "_k").select(id_col, F.col("_p")), id_col).withColumn(c, F.col("_p")).drop("_p")
