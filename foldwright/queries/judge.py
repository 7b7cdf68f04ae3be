"""Judgment rules over small frames of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions.semantics import stable
from foldwright.operators import judgment as J
from foldwright.operators import metrics as M
from foldwright.sources.tables import F0_SQL, MEMBERS_SQL, base_frame, members, table

from . import query
from .metric import R, auc_sql

_FOLD = f"fs AS (SELECT member AS strategy, fold, auc FROM {auc_sql('mm', 'member, fold')})"


def _fold_scores(spark, sf_dir):
    return M.auc(members(base_frame(spark, sf_dir)), "pred", "y", ["member", "fold"]).select(F.col("member").alias("strategy"), "fold", "auc")


@query("judge_screening", f"WITH {F0_SQL}, {MEMBERS_SQL}, {_FOLD}, b AS (SELECT fold, auc AS base FROM fs WHERE strategy='m3') SELECT strategy AS run, fold AS seed, {R('auc-base')} AS delta, coalesce(auc-base>=0 AND fold<>2, false) AS passed FROM fs JOIN b USING (fold) WHERE strategy<>'m3'")
def judge_screening(spark, sf_dir):
    s = _fold_scores(spark, sf_dir)
    cand = s.where("strategy <> 'm3'").select(F.col("strategy").alias("run"), F.col("fold").alias("seed"), "auc", (F.col("fold") != 2).alias("canary_ok"))
    out = J.screening(cand, s.where("strategy = 'm3'").select(F.col("fold").alias("seed"), "auc"))
    return out.select("run", "seed", stable("delta").alias("delta"), "passed")


@query("judge_confirmation", f"WITH {F0_SQL}, {MEMBERS_SQL}, {_FOLD}, b AS (SELECT fold, auc AS base FROM fs WHERE strategy='m3'), o AS (SELECT strategy, avg(auc)-avg(base) AS d, sum((auc>base)::INTEGER) FILTER (fold<3) sw, sum((auc>base)::INTEGER) fw FROM fs JOIN b USING (fold) WHERE strategy<>'m3' GROUP BY 1) SELECT strategy AS run, {R('d')} AS delta, CAST(sw AS BIGINT) AS seed_wins, CAST(fw AS BIGINT) AS fold_wins, d>=2e-5 AND d<2e-4 AS boundary, d>=2e-5 AND sw>=2 AND (NOT (d>=2e-5 AND d<2e-4) OR fw>=3) AS passed FROM o")
def judge_confirmation(spark, sf_dir):
    s = _fold_scores(spark, sf_dir)
    j = s.where("strategy <> 'm3'").withColumnRenamed("strategy", "run").join(s.where("strategy = 'm3'").select("fold", F.col("auc").alias("base")), "fold")
    oof = j.groupBy("run").agg(F.avg("auc").alias("auc"), F.avg("base").alias("base"))
    out = J.confirmation(oof, j.where("fold < 3").withColumnRenamed("fold", "seed"), j)
    return out.select("run", stable("delta").alias("delta"), "seed_wins", "fold_wins", "boundary", "passed")


_GAIN = "g AS (SELECT event_type AS feature, user_id%3 AS seed, sum(round_even(value,0)) AS gain FROM events GROUP BY 1,2)"


def _gains(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature"), F.pmod("user_id", F.lit(3)).alias("seed")).agg(F.sum(F.rint("value")).alias("gain"))


@query("judge_mean_gain_table", f"WITH {_GAIN}, m AS (SELECT feature, avg(gain) a, stddev_samp(gain) s FROM g GROUP BY 1) SELECT feature, {R('a')} AS mean_gain, {R('s')} AS sd_gain, {R('100*a/sum(a) OVER ()')} AS share, CAST(row_number() OVER (ORDER BY a DESC, feature) AS INTEGER) AS rank FROM m")
def judge_mean_gain_table(spark, sf_dir):
    g = J.mean_gain(_gains(spark, sf_dir))
    return g.select("feature", *[stable(c).alias(c) for c in ("mean_gain", "sd_gain", "share")], "rank")


@query("judge_placebo_gate", f"WITH {_GAIN}, m AS (SELECT feature, avg(gain) a FROM g GROUP BY 1), p AS (SELECT max(a) p FROM m WHERE feature='click') SELECT feature, 'canary' AS kind, a<=greatest(p,0) AS passed FROM m, p WHERE feature<'login' UNION ALL SELECT feature, 'new', a>p FROM m, p WHERE feature>='login'")
def judge_placebo_gate(spark, sf_dir):
    g = J.mean_gain(_gains(spark, sf_dir))
    return J.placebo_gate(g, g.where("feature < 'login'").select("feature"), g.where("feature >= 'login'").select("feature"), "click")


@query("judge_fold_wins", f"WITH {F0_SQL}, {MEMBERS_SQL}, {_FOLD}, b AS (SELECT *, max(auc) OVER (PARTITION BY fold) m FROM fs), c AS (SELECT *, sum((auc=m)::INTEGER) OVER (PARTITION BY fold) k FROM b) SELECT strategy, CAST(sum((auc=m AND k=1)::INTEGER) AS BIGINT) AS wins FROM c GROUP BY 1")
def judge_fold_wins(spark, sf_dir):
    return J.fold_wins(_fold_scores(spark, sf_dir))


@query("judge_ensemble_choice", f"WITH {F0_SQL}, {MEMBERS_SQL}, a AS (SELECT member AS strategy, auc FROM {auc_sql('mm', 'member')}), e AS (SELECT strategy, auc, round_even((auc-0.5)*1e9,0)>=2e-5*1e9 AS eligible FROM a) SELECT strategy, {R('auc')} AS auc, eligible, eligible AND row_number() OVER (PARTITION BY eligible ORDER BY auc DESC, strategy)=1 AS recommended FROM e")
def judge_ensemble_choice(spark, sf_dir):
    a = M.auc(members(base_frame(spark, sf_dir)), "pred", "y", ["member"]).select(F.col("member").alias("strategy"), "auc")
    return J.ensemble_choice(a, 0.5).withColumn("auc", stable("auc"))


@query("judge_stack_replacement", f"WITH {F0_SQL}, {MEMBERS_SQL}, {_FOLD}, b AS (SELECT fold, auc AS old FROM fs WHERE strategy='m3'), j AS (SELECT strategy, fs.auc-old AS d FROM fs JOIN b USING (fold) WHERE strategy IN ('m1','m2','m4') AND NOT (strategy='m4' AND fold=1)), k AS (SELECT strategy, avg(d) d, sum((d>0)::INTEGER) p, count(*) n FROM j GROUP BY 1) SELECT strategy AS run, CASE WHEN n=5 THEN {R('d')} END AS delta, CAST(p AS BIGINT) AS positive, CASE WHEN n<5 THEN 'undecidable' WHEN d>=0 AND p>=5 THEN 'pass' ELSE 'fail' END AS verdict FROM k")
def judge_stack_replacement(spark, sf_dir):
    s = _fold_scores(spark, sf_dir).withColumnRenamed("strategy", "run")
    new = s.where("run in ('m1','m2','m4') and not (run = 'm4' and fold = 1)")
    return J.stack_replacement(new, s.where("run = 'm3'").select("fold", "auc")).withColumn("delta", stable("delta"))


@query("judge_pool_entry")
def judge_pool_entry(spark, sf_dir):
    m = members(base_frame(spark, sf_dir))
    a = M.auc(m, "pred", "y", ["member"]).select("member", "auc")
    rho = M.spearman_pairs(m, "id", "member", "pred")
    return J.pool_entry(a, rho, a, 0.6).select("member", "nearest", stable("rho").alias("rho"), "verdict")


@query("judge_refit_budget", "SELECT CAST(user_id%3 AS BIGINT) AS seed, CAST(floor(quantile_cont(CAST(value AS DOUBLE),0.5)*1.25+0.5) AS BIGINT) AS budget FROM events GROUP BY 1")
def judge_refit_budget(spark, sf_dir):
    return J.refit_budget(table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(3)).alias("seed"), F.col("value").alias("length")), 1.25)


@query("judge_prediction_checks", f"WITH {F0_SQL} SELECT CAST((SELECT count(*) FROM f0 WHERE id%11=0) AS BIGINT) AS missing, 0::BIGINT AS extra, CAST((SELECT count(*) FROM f0 WHERE id%11<>0 AND id%13=0) AS BIGINT) AS duplicates, CAST((SELECT count(*)+sum((id%13=0)::INTEGER) FROM f0 WHERE id%11<>0 AND social IS NULL) AS BIGINT) AS not_finite")
def judge_prediction_checks(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    p = f.where("id % 11 <> 0").select("id", F.col("social").alias("pred"))
    return J.prediction_checks(p.unionByName(p.where("id % 13 = 0")), f.select("id"))


_RULES = [("negative", "c_acctbal < 0"), ("segment", "c_mktsegment = 'BUILDING'"), ("nation", "c_nationkey > 20")]


@query("judge_ledger_status", "SELECT c_custkey, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _RULES) + " ELSE 'ok' END AS reason, CASE WHEN " + " OR ".join(f"({c})" for _, c in _RULES) + " THEN 'rejected' ELSE 'accepted' END AS status FROM customer")
def judge_ledger_status(spark, sf_dir):
    return J.ledger_status(table(spark, sf_dir, "customer"), _RULES).select("c_custkey", "reason", "status")


@query("judge_coordinate_gaps", "WITH o AS (SELECT CAST(event_id%4 AS INTEGER) AS seed, CAST(user_id%7 AS INTEGER) AS fold, count(*) c FROM events WHERE event_id%97=0 OR user_id%7=6 GROUP BY 1,2), g AS (SELECT s::INTEGER AS seed, f::INTEGER AS fold, 1 AS e FROM (SELECT unnest(range(0,3)) s), (SELECT unnest(range(0,7)) f)), j AS (SELECT coalesce(g.seed,o.seed) AS seed, coalesce(g.fold,o.fold) AS fold, CASE WHEN c IS NULL THEN 'missing' WHEN e IS NULL THEN 'extra' WHEN c>1 THEN 'duplicate' END AS issue FROM g FULL JOIN o ON g.seed=o.seed AND g.fold=o.fold) SELECT * FROM j WHERE issue IS NOT NULL")
def judge_coordinate_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 97 = 0 or user_id % 7 = 6")
    return J.coordinate_gaps(e.select(F.pmod("event_id", F.lit(4)).cast("int").alias("seed"), F.pmod("user_id", F.lit(7)).cast("int").alias("fold")), 3, 7)


@query("judge_adoption", "SELECT c_custkey AS run, coalesce(c_nationkey%4=3 AND c_acctbal>0 AND c_mktsegment='MACHINERY', false) AS eligible FROM customer")
def judge_adoption(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), F.pmod("c_nationkey", F.lit(4)).alias("n_seeds"), (F.col("c_acctbal") > 0).alias("clean"), F.col("c_mktsegment").alias("folds_hash"))
    return J.adoption(c, "MACHINERY")


@query("judge_stale_runs", "SELECT event_id FROM events WHERE event_type='click' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 600 SECOND")
def judge_stale_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "RUNNING").otherwise("DONE").alias("status"), F.col("ts").cast("timestamp").alias("last_seen"))
    return J.stale_runs(e, "2024-01-15 00:00:00").select("event_id")
