"""Folds, replicas, bootstraps, null bands; preprocessing for networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions.semantics import stable
from foldwright.operators import neural_prep as N
from foldwright.operators import resampling as P
from foldwright.sources.tables import F0_SQL, MEMBERS_SQL, base_frame, members

from . import query
from .metric import R, auc_sql

_U = lambda key, salt: f"((({key})*1103515245+{salt}*12345)%2147483648)/2147483648.0::DOUBLE"


@query("cv_stratified_folds", f"WITH {F0_SQL} SELECT id, CAST((row_number() OVER (PARTITION BY y ORDER BY (id*2654435761)%1000003, id)-1)%5 AS INTEGER) AS cv FROM f0")
def cv_stratified_folds(spark, sf_dir):
    return P.stratified_folds(base_frame(spark, sf_dir), "y", 5).select("id", "cv")


_M = lambda c, i: f"CASE WHEN replica>0 AND {_U('id*3+replica', 31 * i)}<0.3 THEN NULL ELSE {c} END AS {c}"


@query("aug_replicas_masked", f"WITH {F0_SQL} SELECT CASE WHEN replica=0 THEN 'original:'||id ELSE 'replica-'||replica||':'||id END AS row_id, id AS parent_id, replica, {_M('daily', 0)}, {_M('social', 1)} FROM f0, (SELECT unnest([0,1,2])::INTEGER AS replica)")
def aug_replicas_masked(spark, sf_dir):
    return P.replicate_and_mask(base_frame(spark, sf_dir), ["daily", "social"], 2, 0.3)


@query("aug_donor_masks", f"WITH {F0_SQL}, d AS (SELECT id, daily, social, lag((daily IS NULL)::INTEGER) OVER w dd, lag((social IS NULL)::INTEGER) OVER w ds FROM f0 WINDOW w AS (PARTITION BY id%64 ORDER BY (id*2654435761)%1000003, id)) SELECT id, CASE WHEN dd=1 AND {_U('id', 0)}<0.5 THEN NULL ELSE daily END AS daily, CASE WHEN ds=1 AND {_U('id', 7)}<0.5 THEN NULL ELSE social END AS social FROM d")
def aug_donor_masks(spark, sf_dir):
    return P.donor_masks(base_frame(spark, sf_dir).select("id", "daily", "social"), ["daily", "social"], 0.5)


_POIS = "CASE WHEN u<0.36787944117144233 THEN 0 WHEN u<0.7357588823428847 THEN 1 WHEN u<0.9196986029286058 THEN 2 WHEN u<0.9810118431238462 THEN 3 WHEN u<0.9963401531726563 THEN 4 WHEN u<0.9994058151824183 THEN 5 ELSE 6 END"
_BOOT = f"""b AS (SELECT id, y, m1, m2, replicate, CASE WHEN replicate=0 THEN 1 ELSE {_POIS} END AS w FROM (SELECT *, {_U('id*7919+replicate*104729', 0)} AS u FROM mw, (SELECT unnest(range(0,9))::INTEGER AS replicate))),
 u AS (SELECT replicate, 'm1' AS arm, m1 AS pred, y, w FROM b UNION ALL SELECT replicate, 'm2', m2, y, w FROM b), s AS {auc_sql('u', 'replicate, arm', 'w')}"""


@query("boot_paired_deltas", f"WITH {F0_SQL}, {MEMBERS_SQL}, {_BOOT} SELECT replicate, {R(chr(109) + 'ax(auc) FILTER (arm=' + chr(39) + 'm2' + chr(39) + ')-max(auc) FILTER (arm=' + chr(39) + 'm1' + chr(39) + ')')} AS delta FROM s GROUP BY 1")
def boot_paired_deltas(spark, sf_dir):
    w = members(base_frame(spark, sf_dir)).groupBy("id", "y").pivot("member", ["m1", "m2"]).agg(F.first("pred"))
    return P.paired_bootstrap(w, 8, ["m1", "m2"]).select("replicate", stable("delta").alias("delta"))


@query("boot_summary_interval")
def boot_summary_interval(spark, sf_dir):
    w = members(base_frame(spark, sf_dir)).groupBy("id", "y").pivot("member", ["m1", "m2"]).agg(F.first("pred"))
    s = P.summary(P.paired_bootstrap(w, 24, ["m1", "m2"]))
    return s.select(*[stable(c, 5).alias(c) for c in s.columns])


@query("null_column_band", f"WITH {F0_SQL}, r AS (SELECT k AS null_id, y, ((id+k*101)*2654435761)%1000003/1000003.0::DOUBLE AS pred FROM f0, (SELECT unnest(range(1,9)) AS k)) SELECT {R('min(auc)')} AS lo, {R('max(auc)')} AS hi FROM {auc_sql('r', 'null_id')}")
def null_column_band(spark, sf_dir):
    b = P.null_band(base_frame(spark, sf_dir), 8)
    return b.select(stable("lo").alias("lo"), stable("hi").alias("hi"))


@query("split_control_trials")
def split_control_trials(spark, sf_dir):
    w = members(base_frame(spark, sf_dir)).groupBy("id", "y").pivot("member", ["m1", "m2"]).agg(F.first("pred")).withColumnsRenamed({"m1": "a", "m2": "b"})
    return P.split_trials(w, 4, [0.0, 0.25, 0.5, 0.75]).select("trial", "w", stable("held_auc", 5).alias("held_auc"))


@query("impute_distribution_sample")
def impute_distribution_sample(spark, sf_dir):
    from foldwright.operators.impute import sample_fill

    return sample_fill(base_frame(spark, sf_dir).select("id", "social"), "social").select("id", "social_fill")


@query("permutation_shift", f"WITH {F0_SQL}, k AS (SELECT id, age, row_number() OVER (ORDER BY id) k, count(*) OVER () n FROM f0), s AS (SELECT (k+3-1)%n+1 AS k, age AS p FROM k) SELECT id, p AS age FROM k JOIN s USING (k)")
def permutation_shift(spark, sf_dir):
    return P.permute(base_frame(spark, sf_dir).select("id", "age"), "age", 3)


@query("prep_quantile_bins", f"WITH {F0_SQL}, e AS (SELECT list_distinct([" + ", ".join(f"quantile_cont(weekend,{i / 10})" for i in range(1, 10)) + "]) AS e FROM f0 WHERE fold<>0) SELECT id, CASE WHEN weekend IS NOT NULL THEN CAST(len(list_filter(e, lambda x: x<=weekend)) AS INTEGER) END AS bin FROM f0, e")
def prep_quantile_bins(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    return N.quantile_bins(f.where("fold <> 0"), f, "weekend", 10).select("id", F.col("weekend_bin").alias("bin"))


@query("prep_robust_smooth_clip", f"WITH {F0_SQL}, s AS (SELECT quantile_cont(daily,.25) a, quantile_cont(daily,.5) m, quantile_cont(daily,.75) b, min(daily) lo, max(daily) hi FROM f0 WHERE fold<>0), z AS (SELECT id, (daily-m)/CASE WHEN b-a>0 THEN b-a WHEN hi>lo THEN (hi-lo)/2 ELSE 1.0 END AS z FROM f0, s) SELECT id, {R('z/sqrt(1+(z/3)*(z/3))')} AS scaled FROM z")
def prep_robust_smooth_clip(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    return N.robust_scale(f.where("fold <> 0"), f, "daily").select("id", stable("daily_scaled").alias("scaled"))


@query("prep_min_max_observed", f"WITH {F0_SQL}, s AS (SELECT min(daily) lo, max(daily) hi FROM f0 WHERE fold<>0) SELECT id, {R('coalesce((daily-lo)/(hi-lo),0)')} AS daily_mm, (daily IS NOT NULL)::INTEGER AS daily_observed, coalesce(stress='Low',false)::INTEGER AS low FROM f0, s")
def prep_min_max_observed(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    d = N.min_max(f.where("fold <> 0"), f, ["daily"])
    return d.select("id", stable("daily_mm").alias("daily_mm"), "daily_observed", N.one_hot(d, "stress", ["Low"])[0].alias("low"))


@query("prep_rank_gauss")
def prep_rank_gauss(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    return N.rank_gauss(f.where("fold <> 0"), f, "price").select("id", stable("price_gauss", 4).alias("gauss"))


@query("prep_spline_knots", f"WITH {F0_SQL}, k AS (SELECT list_sort(list_distinct([" + ", ".join(f"quantile_cont(age,{i / 8})" for i in range(9)) + "])) AS k FROM f0) SELECT unnest(k) AS knot FROM k")
def prep_spline_knots(spark, sf_dir):
    return N.knots(base_frame(spark, sf_dir), "age", 9).select(F.explode("knots").alias("knot"))


@query("prep_first_seen_codes", f"WITH {F0_SQL} SELECT value, CAST(row_number() OVER (ORDER BY first_id, value) AS INTEGER) AS code FROM (SELECT age AS value, min(id) AS first_id FROM f0 GROUP BY 1)")
def prep_first_seen_codes(spark, sf_dir):
    return N.first_seen_codes(base_frame(spark, sf_dir), "age", "id")
