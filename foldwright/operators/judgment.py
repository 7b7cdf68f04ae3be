"""Threshold rules over scored runs and checks of prediction frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_DELTA = 2e-5
BOUNDARY = (2e-5, 2e-4)
POOL_FLOOR = 0.01
DUPLICATE_RHO = 0.998
SEED_WINS = 2
BOUNDARY_FOLD_WINS = 3
STACK_FOLDS = 5


def screening(cand: DataFrame, base: DataFrame, canary_ok: str = "canary_ok") -> DataFrame:
    """Rows (run, seed, auc, canary_ok) against (seed, auc): pass if the delta on the
    same seed is not negative and the canaries held."""
    j = cand.join(base.withColumnRenamed("auc", "base_auc"), "seed", "left")
    d = F.col("auc") - F.col("base_auc")
    return j.select("run", "seed", d.alias("delta"), F.coalesce((d >= 0) & F.col(canary_ok), F.lit(False)).alias("passed"))


def confirmation(oof: DataFrame, seeds: DataFrame, folds: DataFrame) -> DataFrame:
    """oof (run, auc, base), seeds (run, seed, auc, base), folds (run, fold, auc,
    base): delta >= MIN_DELTA, SEED_WINS seeds won, and near the boundary
    BOUNDARY_FOLD_WINS folds won."""
    s = seeds.groupBy("run").agg(F.sum((F.col("auc") > F.col("base")).cast("long")).alias("seed_wins"))
    f = folds.groupBy("run").agg(F.sum((F.col("auc") > F.col("base")).cast("long")).alias("fold_wins"))
    d = oof.select("run", F.rint((F.col("auc") - F.col("base")) * 1e12).alias("d12")).withColumn("delta", F.col("d12") / 1e12)
    j = d.join(s, "run", "left").join(f, "run", "left")
    near = (F.col("delta") >= BOUNDARY[0]) & (F.col("delta") < BOUNDARY[1])
    ok = (F.col("delta") >= MIN_DELTA) & (F.col("seed_wins") >= SEED_WINS) & (~near | (F.col("fold_wins") >= BOUNDARY_FOLD_WINS))
    return j.select("run", "delta", "seed_wins", "fold_wins", near.alias("boundary"), F.coalesce(ok, F.lit(False)).alias("passed"))


def mean_gain(importance: DataFrame) -> DataFrame:
    """Mean and spread of gain per feature, its share, and rank (ties by name)."""
    g = importance.groupBy("feature").agg(F.avg("gain").alias("mean_gain"), F.stddev_samp("gain").alias("sd_gain"))
    total = F.sum("mean_gain").over(Window.partitionBy())
    return g.select("feature", "mean_gain", "sd_gain", (100 * F.col("mean_gain") / total).alias("share"), F.row_number().over(Window.orderBy(F.desc("mean_gain"), "feature")).alias("rank"))


def placebo_gate(gains: DataFrame, canaries: DataFrame, features: DataFrame, placebo: str = "placebo") -> DataFrame:
    """Canaries must not gain more than max(placebo, 0), new features must gain more
    than the placebo; without a placebo all fail; an unrecorded canary has gain 0."""
    p = gains.where(F.col("feature") == placebo).agg(F.max("mean_gain").alias("p"))
    w = canaries.select("feature", F.lit("canary").alias("kind")).unionByName(features.select("feature", F.lit("new").alias("kind")))
    j = w.join(gains.select("feature", "mean_gain"), "feature", "left").crossJoin(F.broadcast(p))
    ok = F.when(F.col("kind") == "canary", F.coalesce("mean_gain", F.lit(0.0)) <= F.greatest("p", F.lit(0.0)) + F.when(F.col("p").isNull(), F.lit(None)).otherwise(0)).otherwise(F.col("mean_gain") > F.col("p"))
    return j.select("feature", "kind", F.coalesce(ok, F.lit(False)).alias("passed"))


def pool_entry(cands: DataFrame, rho: DataFrame, pool: DataFrame, champion: float) -> DataFrame:
    """cands (member, auc), rho (a, b, rho), pool (member, auc): refuse below the
    floor; a duplicate of its nearest member replaces it if stronger."""
    sym = rho.select(F.col("a").alias("member"), F.col("b").alias("nearest"), "rho").unionByName(rho.select(F.col("b").alias("member"), F.col("a").alias("nearest"), "rho"))
    near = sym.join(pool.select(F.col("member").alias("nearest"), F.col("auc").alias("nearest_auc")), "nearest")
    near = near.withColumn("_k", F.row_number().over(Window.partitionBy("member").orderBy(F.desc("rho"), "nearest"))).where("_k = 1")
    j = cands.join(near, "member", "left")
    verdict = (
        F.when(F.col("auc") < champion - POOL_FLOOR, "refuse")
        .when(F.coalesce(F.col("rho") >= DUPLICATE_RHO, F.lit(False)), F.when(F.col("auc") > F.col("nearest_auc"), "replace").otherwise("refuse"))
        .otherwise("admit")
    )
    return j.select("member", "nearest", "rho", verdict.alias("verdict"))


def fold_wins(scores: DataFrame) -> DataFrame:
    """Rows (strategy, fold, auc): folds in which a strategy alone is the best."""
    w = Window.partitionBy("fold")
    best = scores.withColumn("_m", F.max("auc").over(w)).withColumn("_c", F.sum((F.col("auc") == F.col("_m")).cast("int")).over(w))
    return best.groupBy("strategy").agg(F.sum(((F.col("auc") == F.col("_m")) & (F.col("_c") == 1)).cast("long")).alias("wins"))


def ensemble_choice(scores: DataFrame, champion: float) -> DataFrame:
    """Rows (strategy, auc): eligible at champion + MIN_DELTA, the best of them
    recommended (ties by name)."""
    e = scores.withColumn("eligible", F.rint((F.col("auc") - champion) * 1e9) >= MIN_DELTA * 1e9)
    k = F.row_number().over(Window.partitionBy("eligible").orderBy(F.desc("auc"), "strategy"))
    return e.select("strategy", "auc", "eligible", (F.col("eligible") & (k == 1)).alias("recommended"))


def stack_replacement(new: DataFrame, old: DataFrame, gate: float = 0.0) -> DataFrame:
    """Per run, folds (run, fold, auc) against (fold, auc): undecidable if a fold is
    missing on either side or a value is; pass if the mean delta reaches the gate
    and STACK_FOLDS folds are better."""
    runs = new.select("run").distinct().crossJoin(F.broadcast(old.select("fold", F.col("auc").alias("old"))))
    j = runs.join(new.withColumnRenamed("auc", "new"), ["run", "fold"], "full")
    d = F.col("new") - F.col("old")
    g = j.groupBy("run").agg(F.avg(d).alias("delta"), F.sum((d > 0).cast("int")).alias("positive"), F.bool_or(d.isNull() | F.isnan(d)).alias("bad"), F.count("*").alias("n"))
    v = F.when(F.col("bad") | (F.col("n") == 0), "undecidable").when((F.col("delta") >= gate) & (F.col("positive") >= STACK_FOLDS), "pass").otherwise("fail")
    return g.select("run", F.when(~F.col("bad"), F.col("delta")).alias("delta"), "positive", v.alias("verdict"))


def adoption(runs: DataFrame, folds_hash: str) -> DataFrame:
    ok = (F.col("n_seeds") == 3) & F.col("clean") & (F.col("folds_hash") == folds_hash)
    return runs.select("run", F.coalesce(ok, F.lit(False)).alias("eligible"))


def refit_budget(lengths: DataFrame, multiplier: float) -> DataFrame:
    """Per seed: median observed length times multiplier, rounded half up."""
    return lengths.groupBy("seed").agg(F.floor(F.percentile("length", F.lit(0.5)) * multiplier + 0.5).cast("long").alias("budget"))


def prediction_checks(pred: DataFrame, expected: DataFrame, id_col: str = "id", value: str = "pred") -> DataFrame:
    """One row of violation counts: missing, extra, duplicate ids, not finite."""
    p = pred.groupBy(id_col).agg(F.count("*").alias("c"), F.sum((F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).cast("long")).alias("bad"))
    j = expected.select(id_col, F.lit(1).alias("e")).join(p, id_col, "full")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return j.agg(z(F.col("c").isNull().cast("long")).alias("missing"), z(F.col("e").isNull().cast("long")).alias("extra"), z((F.col("c") > 1).cast("long")).alias("duplicates"), z("bad").alias("not_finite"))


def ledger_status(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """The first rule (reason, SQL condition for failing) that a row breaks."""
    reason = F.coalesce(*[F.when(F.expr(cond), F.lit(name)) for name, cond in rules], F.lit("ok"))
    return rows.select("*", reason.alias("reason"), F.when(reason == "ok", "accepted").otherwise("rejected").alias("status"))


def coordinate_gaps(observed: DataFrame, seeds: int, folds: int) -> DataFrame:
    """The expected seed x fold grid against the observed: missing, extra,
    duplicate coordinates."""
    spark = observed.sparkSession
    grid = spark.range(seeds).select(F.col("id").cast("int").alias("seed")).crossJoin(spark.range(folds).select(F.col("id").cast("int").alias("fold")))
    o = observed.groupBy("seed", "fold").agg(F.count("*").alias("c"))
    j = grid.withColumn("e", F.lit(1)).join(o, ["seed", "fold"], "full")
    issue = F.when(F.col("c").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("c") > 1, "duplicate")
    return j.select("seed", "fold", issue.alias("issue")).where("issue is not null")


def stale_runs(runs: DataFrame, now, idle_seconds: int = 600) -> DataFrame:
    idle = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_seen")
    return runs.where((F.col("status") == "RUNNING") & (idle > idle_seconds))
