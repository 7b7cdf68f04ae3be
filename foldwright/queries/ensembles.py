"""Combiners and their nested out-of-fold scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions.semantics import logit, stable
from foldwright.operators import ensemble as E
from foldwright.operators import metrics as M
from foldwright.operators.search import SubsetScores, bagged_greedy, subset_search
from foldwright.sources.tables import F0_SQL, MEMBERS_SQL, base_frame, members

from . import query
from .metric import R, auc_sql, rank_sql

NAMES = ["m1", "m2", "m3", "m4", "m5"]


@query("comb_rank_mean", f"WITH {F0_SQL}, {MEMBERS_SQL} SELECT id, {R('avg(r/sz)')} AS pred FROM {rank_sql('mm', 'fold, member')} GROUP BY 1")
def comb_rank_mean(spark, sf_dir):
    return E.rank_mean(members(base_frame(spark, sf_dir))).select("id", stable("pred").alias("pred"))


_W = f"""o AS (SELECT k AS "outer", mm.* FROM mm, (SELECT unnest([0,1,2,3,4])::INTEGER AS k) WHERE fold<>k), a AS (SELECT "outer", member, greatest(coalesce(auc,0.5)-0.5,0) g FROM {auc_sql('o', '"outer", member')}),
 w AS (SELECT "outer", member, CASE WHEN sum(g) OVER p>0 THEN g/sum(g) OVER p ELSE 1.0/count(*) OVER p END AS weight FROM a WINDOW p AS (PARTITION BY "outer"))"""


@query("comb_performance_weights", f'WITH {F0_SQL}, {MEMBERS_SQL}, {_W} SELECT "outer", member, {R("weight")} AS weight FROM w')
def comb_performance_weights(spark, sf_dir):
    return E.performance_weights(members(base_frame(spark, sf_dir)), 5).select("outer", "member", stable("weight").alias("weight"))


@query("comb_weighted_rank_mean_nested_auc", f"""WITH {F0_SQL}, {MEMBERS_SQL}, {_W}, k AS {rank_sql('mm', 'fold, member')}, s AS (SELECT id, fold, any_value(y) y, round_even(sum(r/sz*weight)*1e9,0)/1e9 AS pred FROM k JOIN w ON w."outer"=k.fold AND w.member=k.member GROUP BY 1,2) SELECT fold, {R('auc')} AS auc FROM {auc_sql('s', 'fold')}""")
def comb_weighted_rank_mean_nested_auc(spark, sf_dir):
    m = members(base_frame(spark, sf_dir))
    p = E.weighted_rank_mean(m, E.performance_weights(m, 5)).withColumn("pred", stable("pred", 9))
    return M.auc(p, "pred", "y", ["fold"]).select("fold", stable("auc").alias("auc"))


@query("comb_selection_stats", f"WITH {F0_SQL}, {MEMBERS_SQL}, {_W} SELECT member, CAST(sum((weight<>0)::INTEGER) AS BIGINT) AS n_folds, {R('avg(weight)')} AS mean_weight FROM w GROUP BY 1")
def comb_selection_stats(spark, sf_dir):
    return E.selection_stats(E.performance_weights(members(base_frame(spark, sf_dir)), 5)).select("member", "n_folds", stable("mean_weight").alias("mean_weight"))


@query("comb_greedy_rank_mean")
def comb_greedy_rank_mean(spark, sf_dir):
    m = members(base_frame(spark, sf_dir))
    got = E.greedy_select(m, NAMES)
    return E.rank_mean(m.where(F.col("member").isin(got))).select("id", stable("pred").alias("pred"), F.lit(",".join(got)).alias("members"))


@query("comb_bagged_greedy")
def comb_bagged_greedy(spark, sf_dir):
    w = bagged_greedy(members(base_frame(spark, sf_dir)), NAMES)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in w.items()], "member string, weight double")


_P = [f"p{i}" for i in range(1, 6)]
_SUBSETS = f"""k AS {rank_sql('mm', 'member')}, p AS (SELECT id, any_value(y) AS y, {', '.join(f"max(r/sz) FILTER (member='{n}') AS {c}" for n, c in zip(NAMES, _P))} FROM k GROUP BY 1), s AS (SELECT mask, y, round_even(({'+'.join(f"(CASE WHEN mask & {1 << i} > 0 THEN {c} ELSE 0 END)" for i, c in enumerate(_P))})/bit_count(mask)*1e9,0) AS pred FROM p, (SELECT unnest(range(1,32))::INTEGER AS mask)), a AS (SELECT mask, auc FROM {auc_sql('s', 'mask')})"""


@query("comb_subset_search", f"WITH {F0_SQL}, {MEMBERS_SQL}, {_SUBSETS}, n AS (SELECT mask, auc, bit_count(mask) AS size, concat_ws(',', {', '.join(f"CASE WHEN mask & {1 << i} > 0 THEN '{n}' END" for i, n in enumerate(NAMES))}) AS names FROM a) SELECT names AS members, {R('auc')} AS auc FROM n ORDER BY n.auc DESC, size, names LIMIT 1")
def comb_subset_search(spark, sf_dir):
    s = SubsetScores(members(base_frame(spark, sf_dir)), NAMES)
    try:
        got = subset_search(s, NAMES)
        return spark.createDataFrame([(",".join(got), round(s([got])[0], 6))], "members string, auc double")
    finally:
        s.close()


def _linear(spark, sf_dir, solve):
    """Sums by fold in one pass; what is left without a fold fits its model, and one more
    pass scores all folds."""
    m = members(base_frame(spark, sf_dir))
    sums = {r["fold"]: r.asDict() for r in E.moments(m, NAMES, by=["fold"]).collect()}  # a row per fold
    pairs = [k for k in next(iter(sums.values())) if ":" in k] if sums else []
    fits = {k: solve({p: sum(s[p] for j, s in sums.items() if j != k) for p in pairs}) for k in sums}
    return E.linear_scores_by_fold(m, fits).select("id", stable("pred").alias("pred"))


@query("comb_ridge_logit_nested")
def comb_ridge_logit_nested(spark, sf_dir):
    return _linear(spark, sf_dir, lambda row: E.ridge(row, NAMES, 1.0))


@query("comb_nnls_logit_nested")
def comb_nnls_logit_nested(spark, sf_dir):
    return _linear(spark, sf_dir, lambda row: (0.0, E.nnls(row, NAMES)))


_LG = {m: f"ln(least(greatest({m},1e-6),1-1e-6)/(1-least(greatest({m},1e-6),1-1e-6)))" for m in NAMES}


@query("comb_normal_equations", f"WITH {F0_SQL}, {MEMBERS_SQL} " + " UNION ALL ".join(f"SELECT '{a}:{b}' AS pair, round_even(sum(({_LG[a]})*({_LG[b]}))*1e4,0)/1e4 AS s FROM mw" for i, a in enumerate(NAMES) for b in NAMES[i:]))
def comb_normal_equations(spark, sf_dir):
    row = E.moments(members(base_frame(spark, sf_dir)), NAMES)
    pairs = [f"{a}:{b}" for i, a in enumerate(NAMES) for b in NAMES[i:]]
    return row.select(F.lit(1).alias("one"), *pairs).unpivot(["one"], pairs, "pair", "s").select("pair", stable("s", 4).alias("s"))


@query("comb_logit_logistic_nested")
def comb_logit_logistic_nested(spark, sf_dir):
    out = E.nested(members(base_frame(spark, sf_dir)), 5, lambda t: E.logistic(t, NAMES))
    return M.auc_per_fold_and_overall(out.withColumn("pred", stable("pred")), "pred", "y").select("scope", stable("auc", 4).alias("auc"))


@query("comb_three_mode_blend", f"WITH {F0_SQL}, {MEMBERS_SQL}, k AS {rank_sql('mm', 'member')}, p AS (SELECT id, max(pred) FILTER (member='m1') a, max(pred) FILTER (member='m2') b, max((r-0.5)/sz) FILTER (member='m1') ra, max((r-0.5)/sz) FILTER (member='m2') rb FROM k GROUP BY 1) SELECT id, {R('0.7*a+0.3*b')} AS raw, {R('0.7*ln(least(greatest(a,1e-6),1-1e-6)/(1-least(greatest(a,1e-6),1-1e-6)))+0.3*ln(least(greatest(b,1e-6),1-1e-6)/(1-least(greatest(b,1e-6),1-1e-6)))')} AS logit, {R('0.7*ra+0.3*rb')} AS half FROM p")
def comb_three_mode_blend(spark, sf_dir):
    h = M.half_step_rank(members(base_frame(spark, sf_dir)).where("member in ('m1','m2')"), "pred", ["member"])
    w = h.groupBy("id").pivot("member", ["m1", "m2"]).agg(F.first("pred").alias("p"), F.first("half").alias("h"))
    mix = lambda a, b: stable(0.7 * a + 0.3 * b)
    return w.select("id", mix(F.col("m1_p"), F.col("m2_p")).alias("raw"), mix(logit("m1_p"), logit("m2_p")).alias("logit"), mix(F.col("m1_h"), F.col("m2_h")).alias("half"))


@query("comb_seed_mean_rescored", f"WITH {F0_SQL}, {MEMBERS_SQL}, s AS (SELECT id, any_value(y) y, round_even(avg(pred)*1e9,0)/1e9 AS pred FROM mm WHERE member IN ('m1','m2','m4') GROUP BY 1) SELECT {R('auc')} AS auc FROM {auc_sql('s')}")
def comb_seed_mean_rescored(spark, sf_dir):
    s = members(base_frame(spark, sf_dir)).where("member in ('m1','m2','m4')").groupBy("id", "y").agg(stable(F.avg("pred"), 9).alias("pred"))
    return M.auc(s, "pred", "y").select(stable("auc").alias("auc"))


@query("comb_cv_full_blend", f"WITH {F0_SQL}, {MEMBERS_SQL} SELECT id, {R('(5*m1+1*m2)/6')} AS pred FROM mw")
def comb_cv_full_blend(spark, sf_dir):
    w = members(base_frame(spark, sf_dir)).groupBy("id").pivot("member", ["m1", "m2"]).agg(F.first("pred"))
    return w.select("id", stable((5 * F.col("m1") + F.col("m2")) / 6).alias("pred"))


@query("comb_strategy_wide_sink", f"WITH {F0_SQL}, {MEMBERS_SQL} SELECT id, m1, m2, m3, m4, m5 FROM mw")
def comb_strategy_wide_sink(spark, sf_dir):
    return members(base_frame(spark, sf_dir)).groupBy("id").pivot("member", NAMES).agg(F.first("pred"))
