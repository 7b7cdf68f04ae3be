"""Reports over runs, seeds, folds and configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions.semantics import normal_quantile, stable, two_proportion_z
from foldwright.operators import ensemble as E
from foldwright.operators import metrics as M
from foldwright.operators import missingness as MI
from foldwright.operators import reports as P
from foldwright.sources.tables import F0_SQL, MEMBERS_SQL, base_frame, members, table

from . import query
from .ensembles import _W, NAMES
from .metric import _BUCKET, _NM, COLS, R, auc_sql, rank_sql

_IMP = "imp AS (SELECT CAST(user_id%3 AS BIGINT) AS seed, CAST(user_id%5 AS BIGINT) AS fold, event_type AS feature, sum(round_even(value,0)) AS gain FROM events GROUP BY 1,2,3)"


def _importance(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.pmod("user_id", F.lit(3)).alias("seed"), F.pmod("user_id", F.lit(5)).alias("fold"), F.col("event_type").alias("feature")).agg(F.sum(F.rint("value")).alias("gain"))


_READ = f"r AS (SELECT seed, fold, feature, gain, rank() OVER (PARTITION BY seed,fold ORDER BY gain DESC) AS rank, 100*percent_rank() OVER (PARTITION BY seed,fold ORDER BY gain) AS percentile, max(gain) FILTER (feature='view') OVER (PARTITION BY seed,fold) AS p FROM imp)"


@query("report_importance_readout", f"WITH {_IMP}, {_READ} SELECT seed, fold, gain, CAST(rank AS INTEGER) AS rank, {R('percentile')} AS percentile, {R('CASE WHEN p>0 THEN gain/p END')} AS ratio, gain>p AS above FROM r WHERE feature='click'")
def report_importance_readout(spark, sf_dir):
    r = P.importance_readout(_importance(spark, sf_dir), "click", "view")
    return r.select("seed", "fold", "gain", "rank", stable("percentile").alias("percentile"), stable("ratio").alias("ratio"), "above")


@query("report_readout_spread", f"WITH {_IMP} SELECT feature, min(gain) AS gain_min, quantile_cont(gain,0.5) AS gain_median, max(gain) AS gain_max FROM imp GROUP BY 1")
def report_readout_spread(spark, sf_dir):
    return P.spread(_importance(spark, sf_dir), ["gain"], ["feature"])


_MF = f"fs AS (SELECT member, fold, auc FROM {auc_sql('mm', 'member, fold')})"


@query("report_pair_signs", f"WITH {F0_SQL}, {MEMBERS_SQL}, {_MF}, d AS (SELECT a.member, a.fold, a.auc-b.auc AS d FROM fs a JOIN fs b ON a.fold=b.fold AND b.member='m3' WHERE a.member<>'m3') SELECT member AS seed, {R('avg(d)')} AS delta, string_agg(CASE WHEN d>0 THEN '+' WHEN d<0 THEN '-' ELSE '0' END, '' ORDER BY fold) AS signs FROM d GROUP BY 1")
def report_pair_signs(spark, sf_dir):
    s = M.auc(members(base_frame(spark, sf_dir)), "pred", "y", ["member", "fold"]).withColumnRenamed("member", "seed").select("seed", "fold", "auc")
    old = s.where("seed = 'm3'").select("fold", "auc").crossJoin(s.where("seed <> 'm3'").select("seed").distinct())
    return P.pair_report(s.where("seed <> 'm3'"), old, 5).withColumn("delta", stable("delta"))


@query("report_mask_rates", f"WITH {F0_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS col, {R(f'avg(({c} IS NULL)::INTEGER)')} AS rate, {R(f'CASE WHEN avg(({c} IS NULL)::INTEGER)>0 THEN least(1.0,0.05/avg(({c} IS NULL)::INTEGER)) ELSE 1.0 END')} AS alpha FROM f0" for c in COLS))
def report_mask_rates(spark, sf_dir):
    return P.mask_rates(base_frame(spark, sf_dir), COLS, 0.05).select("col", stable("rate").alias("rate"), stable("alpha").alias("alpha"))


@query("report_config_leaf_difference", "WITH a AS (SELECT p_brand AS leaf, min(p_size) AS v FROM part WHERE p_partkey%2=0 GROUP BY 1 HAVING min(p_size)<40), b AS (SELECT p_brand AS leaf, min(p_size) AS v FROM part WHERE p_partkey%3=0 GROUP BY 1 HAVING max(p_size)>10), j AS (SELECT leaf, CAST(a.v AS VARCHAR) AS old, CAST(b.v AS VARCHAR) AS new FROM a FULL JOIN b USING (leaf)) SELECT leaf, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM j WHERE old IS DISTINCT FROM new")
def report_config_leaf_difference(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    g = lambda d: d.groupBy(F.col("p_brand").alias("leaf")).agg(F.min("p_size").alias("v"), F.max("p_size").alias("hi"))
    a, b = g(p.where("p_partkey % 2 = 0")).where("v < 40"), g(p.where("p_partkey % 3 = 0")).where("hi > 10")
    return P.leaf_difference(*[d.select("leaf", F.col("v").cast("string").alias("value")) for d in (a, b)])


@query("report_proper_subsets", "WITH s AS (SELECT DISTINCT s_nationkey AS o, CAST(s_suppkey%3 AS BIGINT) AS i FROM supplier), n AS (SELECT o, count(*) n FROM s GROUP BY 1), c AS (SELECT a.o AS small, b.o AS large, count(*) c FROM s a JOIN s b ON a.i=b.i AND a.o<>b.o GROUP BY 1,2) SELECT small, large FROM c JOIN n x ON x.o=small JOIN n y ON y.o=large WHERE c=x.n AND x.n<y.n")
def report_proper_subsets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("o"), F.pmod("s_suppkey", F.lit(3)).alias("i")).distinct()
    return P.proper_subsets(s, "o", "i")


@query("report_selection_stability", f'WITH {F0_SQL}, {MEMBERS_SQL}, {_W}, c AS (SELECT member AS candidate, count(DISTINCT "outer") f FROM w WHERE weight>=0.2 GROUP BY 1), u AS (SELECT member AS candidate, true AS chosen FROM {auc_sql("mm", "member")} WHERE auc>0.55) SELECT candidate, coalesce(f,0) AS folds, coalesce(chosen,false) AS in_full FROM c FULL JOIN u USING (candidate)')
def report_selection_stability(spark, sf_dir):
    m = members(base_frame(spark, sf_dir))
    chosen = E.performance_weights(m, 5).where("weight >= 0.2").select(F.col("member").alias("candidate"), F.col("outer").alias("fold"))
    full = M.auc(m, "pred", "y", ["member"]).where("auc > 0.55").select(F.col("member").alias("candidate"))
    return P.selection_stability(chosen, full)


@query("report_ablation_contrast", f'WITH {F0_SQL}, {MEMBERS_SQL}, {_W}, j AS (SELECT a.member, {R("b.weight-a.weight")} AS change FROM w a JOIN w b ON a.member=b.member AND a."outer"=0 AND b."outer"=1) SELECT member, change, row_number() OVER (ORDER BY abs(change) DESC, member) AS rank FROM j')
def report_ablation_contrast(spark, sf_dir):
    w = E.performance_weights(members(base_frame(spark, sf_dir)), 5).withColumn("weight", F.col("weight"))
    out = P.ablation_contrast(w.where("outer = 0"), w.where("outer = 1"))
    return out.select("member", stable("change").alias("change"), "rank")


@query("report_cut_band", f"WITH {F0_SQL}, k AS (SELECT price, row_number() OVER (ORDER BY price DESC, id) k, count(*) OVER () n FROM f0), c AS (SELECT p.pct, price FROM k, (SELECT unnest([0.01,0.05,0.2])::DOUBLE AS pct) p WHERE k<=greatest(round_even(n*p.pct,0),5)) SELECT pct, count(*) AS k, {R('stddev_samp(price)')} AS sd, min(price) AS lowest FROM c GROUP BY 1")
def report_cut_band(spark, sf_dir):
    return P.cut_band(base_frame(spark, sf_dir), "price", "id", [0.01, 0.05, 0.2]).withColumn("sd", stable("sd"))


@query("report_within_fold_ranks", f"WITH {F0_SQL}, {MEMBERS_SQL}, m AS (SELECT * FROM mm WHERE member='m1') SELECT id, {R('r/sz')} AS pred FROM {rank_sql('m', 'fold')}")
def report_within_fold_ranks(spark, sf_dir):
    m = members(base_frame(spark, sf_dir)).where("member = 'm1'")
    s = m.select("fold", F.when(F.col("fold") < 2, "a").otherwise("b").alias("strategy")).distinct()
    return P.within_fold_ranks(m, s).select("id", stable("pred").alias("pred"))


@query("report_multi_arm_buckets", f"WITH {F0_SQL}, {MEMBERS_SQL}, s AS (SELECT member, pred, mm.y, {_BUCKET} AS bucket FROM mm JOIN (SELECT id, {_NM} AS m FROM f0) USING (id)), a AS (SELECT member, bucket, auc, n FROM {auc_sql('s', 'member, bucket')}) SELECT bucket, CAST(max(n) AS BIGINT) AS n, {R('max(auc) FILTER (member=$$m2$$)-max(auc) FILTER (member=$$m1$$)')} AS d21, {R('max(auc) FILTER (member=$$m4$$)-max(auc) FILTER (member=$$m1$$)')} AS d41 FROM a GROUP BY 1")
def report_multi_arm_buckets(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    s = members(f).join(f.select("id", MI.bucket(COLS).alias("bucket")), "id")
    p = M.auc(s, "pred", "y", ["member", "bucket"]).groupBy("bucket").pivot("member", ["m1", "m2", "m4"]).agg(F.first("auc").alias("a"), F.first("n").alias("n"))
    return p.select("bucket", F.col("m1_n").alias("n"), stable(F.col("m2_a") - F.col("m1_a")).alias("d21"), stable(F.col("m4_a") - F.col("m1_a")).alias("d41"))


@query("report_submission_scale", f"WITH {F0_SQL}, {MEMBERS_SQL} SELECT member, count(*) AS n, min(pred) AS lo, max(pred) AS hi, count(DISTINCT pred) AS distinct_values, bool_and(pred BETWEEN 0 AND 1) AS in_unit FROM mm GROUP BY 1")
def report_submission_scale(spark, sf_dir):
    m = members(base_frame(spark, sf_dir))
    return m.groupBy("member").agg(F.count("*").alias("n"), F.min("pred").alias("lo"), F.max("pred").alias("hi"), F.count_distinct("pred").alias("distinct_values"), F.bool_and(F.col("pred").between(0, 1)).alias("in_unit"))


@query("report_duplicate_conflicts_per_fold", f"WITH {F0_SQL}, {MEMBERS_SQL}, k AS {rank_sql('mm', 'fold, member')}, c AS (SELECT l.fold, l.member AS a, q.member AS b, corr(l.r,q.r) AS rho FROM k l JOIN k q ON l.id=q.id AND l.member<q.member GROUP BY 1,2,3) SELECT fold, CAST(sum((abs({R('rho')})>=0.3)::INTEGER) AS BIGINT) AS conflicts, count(*) AS pairs FROM c GROUP BY 1")
def report_duplicate_conflicts_per_fold(spark, sf_dir):
    r = M.average_rank("pred", ["fold", "member"], "_r").over(members(base_frame(spark, sf_dir)))
    l, s = r.select("id", "fold", F.col("member").alias("a"), F.col("_r").alias("x")), r.select("id", F.col("member").alias("b"), F.col("_r").alias("z"))
    c = l.join(s, "id").where("a < b").groupBy("fold", "a", "b").agg(F.corr("x", "z").alias("rho"))
    return c.groupBy("fold").agg(F.sum((F.abs(stable("rho")) >= 0.3).cast("long")).alias("conflicts"), F.count("*").alias("pairs"))


@query("report_two_proportion_z", f"WITH {F0_SQL}, c AS (SELECT sum(y) FILTER (gender='x')::DOUBLE k1, count(*) FILTER (gender='x') n1, sum(y) FILTER (gender='z')::DOUBLE k2, count(*) FILTER (gender='z') n2 FROM f0) SELECT {R('(k1/n1-k2/n2)/sqrt(((k1+k2)/(n1+n2))*(1-(k1+k2)/(n1+n2))*(1.0::DOUBLE/n1+1.0::DOUBLE/n2))')} AS z FROM c")
def report_two_proportion_z(spark, sf_dir):
    x, f = F.col("gender") == "x", base_frame(spark, sf_dir)
    c = f.agg(F.sum(F.when(x, F.col("y"))).cast("double").alias("k1"), F.sum(x.cast("long")).alias("n1"), F.sum(F.when(~x, F.col("y"))).cast("double").alias("k2"), F.sum((~x).cast("long")).alias("n2"))
    return c.select(stable(two_proportion_z(*[F.col(k) for k in ("k1", "n1", "k2", "n2")])).alias("z"))


@query("report_teacher_student_contrast", f"WITH {F0_SQL}, {MEMBERS_SQL}, k AS {rank_sql('mm', 'fold, member')}, p AS (SELECT id, max(r/sz) FILTER (member='m1')-max(r/sz) FILTER (member='m4') AS c FROM k GROUP BY 1), s AS (SELECT stddev_pop(c) s FROM p) SELECT id, {R('sign(c/s)*(c/s)*(c/s)')} AS residual FROM p, s")
def report_teacher_student_contrast(spark, sf_dir):
    from foldwright.functions.semantics import signed_square

    r = M.rank_pct(members(base_frame(spark, sf_dir)), "pred", ["fold", "member"]).groupBy("id").pivot("member", ["m1", "m4"]).agg(F.first("pct")).select("id", (F.col("m1") - F.col("m4")).alias("c"))
    sd = r.agg(F.stddev_pop("c").alias("s"))
    return r.crossJoin(F.broadcast(sd)).select("id", stable(signed_square(F.col("c") / F.col("s"))).alias("residual"))
