"""Reports over runs, seeds, folds and configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.operators.metrics import running


def importance_readout(imp: DataFrame, feature: str, placebo: str) -> DataFrame:
    """Per (seed, fold) the feature's gain: competition rank, percentile of the
    others below it, ratio to the placebo."""
    w = Window.partitionBy("seed", "fold")
    d = imp.select("seed", "fold", "feature", "gain", F.rank().over(w.orderBy(F.desc("gain"))).alias("rank"), (100 * F.percent_rank().over(w.orderBy("gain"))).alias("percentile"), F.max(F.when(F.col("feature") == placebo, F.col("gain"))).over(w).alias("p"))
    d = d.where(F.col("feature") == feature)
    return d.select("seed", "fold", "gain", "rank", "percentile", F.when(F.col("p") > 0, F.col("gain") / F.col("p")).alias("ratio"), (F.col("gain") > F.col("p")).alias("above"))


def spread(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Smallest, median and largest value of each column."""
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("median", lambda c: F.percentile(c, F.lit(0.5))), ("max", F.max))]
    return df.groupBy(*by).agg(*aggs)


def pair_report(new: DataFrame, old: DataFrame, folds: int) -> DataFrame:
    """Per seed: mean delta of the folds and a string of their signs."""
    d = new.join(old.withColumnRenamed("auc", "old"), ["seed", "fold"]).withColumn("d", F.col("auc") - F.col("old"))
    sign = F.when(F.col("d") > 0, "+").when(F.col("d") < 0, "-").otherwise("0")
    g = d.withColumn("s", sign).groupBy("seed").agg(F.avg("d").alias("delta"), F.sort_array(F.collect_list(F.struct("fold", "s"))).alias("x"))
    return g.where(F.size("x") == folds).select("seed", "delta", F.array_join(F.transform("x", lambda v: v["s"]), "").alias("signs"))


def mask_rates(df: DataFrame, cols: Sequence[str], dropout: float) -> DataFrame:
    """Missing rate per column and the acceptance that makes a borrowed mask drop
    cells at the wanted rate."""
    u = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).unpivot([], list(cols), "col", "rate")
    return u.select("col", "rate", F.when(F.col("rate") > 0, F.least(F.lit(1.0), dropout / F.col("rate"))).otherwise(1.0).alias("alpha"))


def leaf_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of configs as (config, leaf, value) rows, all leaves that differ."""
    j = a.select("leaf", F.col("value").alias("old")).join(b.select("leaf", F.col("value").alias("new")), "leaf", "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return j.select("leaf", "old", "new", kind.alias("kind")).where("kind is not null")


def flatten(config: object, prefix: str = "") -> dict[str, str]:
    """Dotted leaves of a nested configuration."""
    if isinstance(config, dict):
        return {k: v for key, x in config.items() for k, v in flatten(x, f"{prefix}{key}.").items()}
    if isinstance(config, list):
        return {k: v for i, x in enumerate(config) for k, v in flatten(x, f"{prefix}{i}.").items()}
    return {prefix.rstrip("."): str(config)}


def proper_subsets(sets: DataFrame, owner: str, item: str) -> DataFrame:
    """Pairs (small, large) of owners whose items are properly contained: relational
    division by counting shared items."""
    n = sets.groupBy(owner).agg(F.count("*").alias("n"))
    l, r = sets.select(F.col(owner).alias("small"), item), sets.select(F.col(owner).alias("large"), item)
    c = l.join(r, item).where("small <> large").groupBy("small", "large").agg(F.count("*").alias("c"))
    c = c.join(F.broadcast(n.withColumnRenamed(owner, "small").withColumnRenamed("n", "ns")), "small").join(F.broadcast(n.withColumnRenamed(owner, "large").withColumnRenamed("n", "nl")), "large")  # a row per owner
    return c.where("c = ns and ns < nl").select("small", "large")


def selection_stability(chosen: DataFrame, full: DataFrame) -> DataFrame:
    """How many folds chose a candidate, and whether the full selection did."""
    c = chosen.groupBy("candidate").agg(F.count_distinct("fold").alias("folds"))
    j = c.join(full.select("candidate", F.lit(True).alias("in_full")), "candidate", "full")
    return j.select("candidate", F.coalesce("folds", F.lit(0)).cast("long").alias("folds"), F.coalesce("in_full", F.lit(False)).alias("in_full"))


def ablation_contrast(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per member: change of weight between two arms, largest first by rank."""
    j = a.select("member", F.col("weight").alias("w0")).join(b.select("member", F.col("weight").alias("w1")), "member", "full").na.fill(0.0, ["w0", "w1"])
    d = j.withColumn("change", F.col("w1") - F.col("w0"))
    return d.select("member", "change", F.row_number().over(Window.orderBy(F.abs("change").desc(), "member")).cast("long").alias("rank"))


def cut_band(df: DataFrame, score: str, key: str, percents: Sequence[float]) -> DataFrame:
    """Per cut of the best percent (five rows at least): size and spread."""
    n = df.agg(F.count("*").alias("n"))
    v = running(df.groupBy(score).agg(F.count("*").alias("_c")), [], score, {"_c": "_less"})
    r = df.join(v, score).crossJoin(F.broadcast(n))  # one row
    r = r.withColumn("k", F.col("n") - F.col("_less") - F.col("_c") + F.row_number().over(Window.partitionBy(score).orderBy(key)))
    cuts = F.explode(F.array(*[F.lit(float(p)) for p in percents]))
    r = r.withColumn("pct", cuts).where(F.col("k") <= F.greatest(F.rint(F.col("n") * F.col("pct")), F.lit(5)))
    return r.groupBy("pct").agg(F.count("*").alias("k"), F.stddev_samp(score).alias("sd"), F.min(score).alias("lowest"))


def within_fold_ranks(df: DataFrame, strategies: DataFrame) -> DataFrame:
    """Ranks within folds where a fold's strategy differs from another's, else the
    values as they are."""
    from foldwright.operators.metrics import rank_pct

    mixed = strategies.agg((F.count_distinct("strategy") > 1).alias("mixed"))
    return rank_pct(df, "pred", ["fold"]).crossJoin(F.broadcast(mixed)).withColumn("pred", F.when(F.col("mixed"), F.col("pct")).otherwise(F.col("pred")))
