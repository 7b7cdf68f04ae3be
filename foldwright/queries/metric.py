"""Ranking metrics, rank scales, correlations, reweighting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwright.functions import semantics as S
from foldwright.operators import metrics as M
from foldwright.operators import missingness as MI
from foldwright.sources.tables import F0_SQL, MEMBERS_SQL, base_frame, members, table

from . import query

R = lambda x: f"round_even(({x})*1e6,0)/1e6"
COLS = ["daily", "social", "gaming", "work"]


def auc_sql(rows: str, by: str = "", w: str = "1.0") -> str:
    """rows: relation with pred, y and the by columns."""
    p = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT {p}sum(c) AS n, CASE WHEN sum(p)>0 AND sum(nn)>0 THEN sum(p*(b+nn/2))/(sum(p)*sum(nn)) END AS auc FROM
    (SELECT *, coalesce(sum(nn) OVER ({part}ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM
    (SELECT {p}pred, sum({w}*y)::DOUBLE AS p, sum({w}*(1-y))::DOUBLE AS nn, count(*) AS c FROM {rows} GROUP BY {p}pred)) {'GROUP BY ' + by if by else ''})"""


def rank_sql(rows: str, by: str) -> str:
    """rows with average rank r and size sz of pred within by."""
    return f"(SELECT *, rank() OVER (PARTITION BY {by} ORDER BY pred) + (count(*) OVER (PARTITION BY {by}, pred)-1)/2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {by}) AS sz FROM {rows})"


@query("auc_members", f"WITH {F0_SQL}, {MEMBERS_SQL} SELECT member, CAST(n AS BIGINT) AS n, {R('auc')} AS auc FROM {auc_sql('mm', 'member')}")
def auc_members(spark, sf_dir):
    return M.auc(members(base_frame(spark, sf_dir)), "pred", "y", ["member"]).select("member", "n", S.stable("auc").alias("auc"))


@query("auc_per_fold_and_overall", f"WITH {F0_SQL}, {MEMBERS_SQL}, s AS (SELECT member, CAST(fold AS VARCHAR) AS scope, pred, y FROM mm UNION ALL SELECT member, 'all', pred, y FROM mm) SELECT member, scope, {R('auc')} AS auc FROM {auc_sql('s', 'member, scope')}")
def auc_per_fold_and_overall(spark, sf_dir):
    return M.auc_per_fold_and_overall(members(base_frame(spark, sf_dir)), "pred", "y", by=["member"]).select("member", "scope", S.stable("auc").alias("auc"))


@query("auc_weighted", f"WITH {F0_SQL}, {MEMBERS_SQL} SELECT member, {R('auc')} AS auc FROM {auc_sql('mm', 'member', '(1+id%3)')}")
def auc_weighted(spark, sf_dir):
    return M.auc(members(base_frame(spark, sf_dir)), "pred", "y", ["member"], 1.0 + F.pmod("id", F.lit(3))).select("member", S.stable("auc").alias("auc"))


_BUCKET = "CASE WHEN m=0 THEN '0' WHEN m<=2 THEN '1-2' WHEN m<=5 THEN '3-5' ELSE '6+' END"
_NM = "(daily IS NULL)::INTEGER+(social IS NULL)::INTEGER+(gaming IS NULL)::INTEGER+(work IS NULL)::INTEGER"


@query("auc_segmented_by_missing", f"WITH {F0_SQL}, {MEMBERS_SQL}, s AS (SELECT member, pred, mm.y, {_BUCKET} AS bucket FROM mm JOIN (SELECT id, {_NM} AS m FROM f0) USING (id)) SELECT member, bucket, CAST(n AS BIGINT) AS n, {R('auc')} AS auc FROM {auc_sql('s', 'member, bucket')}")
def auc_segmented_by_missing(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    s = members(f).join(f.select("id", MI.bucket(COLS).alias("bucket")), "id")
    return M.auc(s, "pred", "y", ["member", "bucket"]).select("member", "bucket", "n", S.stable("auc").alias("auc"))


@query("rank_pct_in_block", f"WITH {F0_SQL}, {MEMBERS_SQL} SELECT id, member, {R('r/sz')} AS pct FROM {rank_sql('mm', 'fold, member')}")
def rank_pct_in_block(spark, sf_dir):
    return M.rank_pct(members(base_frame(spark, sf_dir)), "pred", ["fold", "member"]).select("id", "member", S.stable("pct").alias("pct"))


@query("rank_half_step", f"WITH {F0_SQL}, {MEMBERS_SQL} SELECT id, member, {R('(r-0.5)/sz')} AS half FROM {rank_sql('mm', 'member')}")
def rank_half_step(spark, sf_dir):
    return M.half_step_rank(members(base_frame(spark, sf_dir)), "pred", ["member"]).select("id", "member", S.stable("half").alias("half"))


@query("rank_deterministic_tiebreak", f"WITH {F0_SQL} SELECT id, {R('(row_number() OVER (PARTITION BY fold ORDER BY age, id)-0.5)/count(*) OVER (PARTITION BY fold)')} AS rank FROM f0")
def rank_deterministic_tiebreak(spark, sf_dir):
    return M.deterministic_rank(base_frame(spark, sf_dir), "age", "id", ["fold"]).select("id", S.stable("rank").alias("rank"))


@query("spearman_all_pairs", f"WITH {F0_SQL}, {MEMBERS_SQL}, k AS {rank_sql('mm', 'member')} SELECT l.member AS a, q.member AS b, {R('corr(l.r,q.r)')} AS rho FROM k l JOIN k q ON l.id=q.id AND l.member<q.member GROUP BY 1,2")
def spearman_all_pairs(spark, sf_dir):
    return M.spearman_pairs(members(base_frame(spark, sf_dir)), "id", "member", "pred").select("a", "b", S.stable("rho").alias("rho"))


@query("nearest_member_argmax", f"WITH {F0_SQL}, {MEMBERS_SQL}, k AS {rank_sql('mm', 'member')}, c AS (SELECT l.member AS a, q.member AS b, {R('corr(l.r,q.r)')} AS rho FROM k l JOIN k q ON l.id=q.id AND l.member<>q.member GROUP BY 1,2) SELECT a, b, rho FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rho DESC, b) n FROM c) WHERE n=1")
def nearest_member_argmax(spark, sf_dir):
    p = M.spearman_pairs(members(base_frame(spark, sf_dir)), "id", "member", "pred").select("a", "b", S.stable("rho").alias("rho"))
    sym = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    return sym.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("rho"), "b"))).where("n = 1").drop("n")


@query("pearson_residual", f"WITH {F0_SQL}, {MEMBERS_SQL} SELECT {R('corr(m1-y,m2-y)')} AS r12, {R('corr(m1-y,m3-y)')} AS r13 FROM mw")
def pearson_residual(spark, sf_dir):
    w = members(base_frame(spark, sf_dir)).groupBy("id", "y").pivot("member", ["m1", "m2", "m3"]).agg(F.first("pred"))
    c = lambda k: F.corr(F.col("m1") - F.col("y"), F.col(k) - F.col("y"))
    return w.agg(S.stable(c("m2")).alias("r12"), S.stable(c("m3")).alias("r13"))


_NATIONS = "n AS (SELECT c_nationkey AS k, sum(round_even(c_acctbal,0)) AS x, count(*)::DOUBLE AS y FROM customer GROUP BY 1)"


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(F.rint("c_acctbal")).alias("x"), F.count("*").cast("double").alias("y"))


@query("kendall_tau_inversions", f"WITH {_NATIONS} SELECT CAST(sum((sign((a.x-b.x)*(a.y-b.y))<0)::INTEGER) AS BIGINT) AS inversions, {R('sum(sign((a.x-b.x)*(a.y-b.y)))/count(*)')} AS tau FROM n a JOIN n b ON a.k<b.k")
def kendall_tau_inversions(spark, sf_dir):
    return M.kendall(_nations(spark, sf_dir), "k", "x", "y").select("inversions", S.stable("tau").alias("tau"))


@query("theil_sen_slope", f"WITH {_NATIONS} SELECT {R('quantile_cont((b.y-a.y)/(b.x-a.x),0.5)*1e4')} AS slope, count(*) AS pairs FROM n a JOIN n b ON a.x<b.x")
def theil_sen_slope(spark, sf_dir):
    return M.theil_sen(_nations(spark, sf_dir), "x", "y").select(S.stable(F.col("slope") * 1e4).alias("slope"), "pairs")


@query("ecdf_fit_transform", f"WITH {F0_SQL}, r AS (SELECT weekend AS v FROM f0 WHERE fold<>0 AND weekend IS NOT NULL), n AS (SELECT count(*) n FROM r), q AS (SELECT DISTINCT weekend AS v FROM f0 WHERE fold=0 AND weekend IS NOT NULL), e AS (SELECT q.v, (count(*) FILTER (r.v<q.v)+count(*) FILTER (r.v<=q.v))/(2.0::DOUBLE*any_value(n)) AS p, any_value(n) AS n FROM q, r, n GROUP BY 1) SELECT id, {R('greatest(least(p,1-0.5/n),0.5/n)')} AS ecdf FROM f0 LEFT JOIN e ON weekend=v WHERE fold=0")
def ecdf_fit_transform(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    return M.ecdf(f.where("fold <> 0"), f.where("fold = 0"), "weekend", ["id"]).select("id", S.stable("ecdf").alias("ecdf"))


@query("rank_burden", f"WITH {F0_SQL}, {MEMBERS_SQL}, t AS (SELECT m1 AS pred, y, sum(y) OVER () tp, sum(1-y) OVER () tn, id FROM mw), v AS (SELECT pred, sum(y) p, sum(1-y) n FROM t GROUP BY 1), b AS (SELECT pred, p, n, coalesce(sum(p) OVER w,0) pb, coalesce(sum(n) OVER w,0) nb FROM v WINDOW w AS (ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT id, {R('CASE WHEN y=1 THEN (tn-nb-n/2)/tn ELSE (pb+p/2)/tp END')} AS burden FROM t JOIN b USING (pred)")
def rank_burden(spark, sf_dir):
    m = members(base_frame(spark, sf_dir)).where("member = 'm1'")
    return M.rank_burden(m, "pred", "y", ["id"]).select("id", S.stable("burden").alias("burden"))


@query("top_share_flags", f"WITH {F0_SQL}, k AS (SELECT id, y, price, row_number() OVER (PARTITION BY y ORDER BY price DESC, id) n, CAST(ceil(0.05*count(*) OVER (PARTITION BY y)) AS BIGINT) m FROM f0), t AS (SELECT y, price AS thr FROM k WHERE n=m) SELECT id, price>=thr AS flag FROM f0 JOIN t USING (y)")
def top_share_flags(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    w = Window.partitionBy("y")
    k = f.select("y", "price", F.row_number().over(w.orderBy(F.desc("price"), "id")).alias("n"), F.ceil(0.05 * F.count("*").over(w)).alias("m"))
    t = k.where("n = m").select("y", F.col("price").alias("thr"))
    return f.join(F.broadcast(t), "y").select("id", (F.col("price") >= F.col("thr")).alias("flag"))  # a row per class


@query("row_quantiles_across_members", f"WITH {F0_SQL}, {MEMBERS_SQL}, k AS {rank_sql('mm', 'member')} SELECT id, {R('quantile_cont(r/sz,0.75)-quantile_cont(r/sz,0.25)')} AS iqr FROM k GROUP BY 1")
def row_quantiles_across_members(spark, sf_dir):
    r = M.rank_pct(members(base_frame(spark, sf_dir)), "pred", ["member"])
    q = F.percentile("pct", F.array(F.lit(0.25), F.lit(0.75)))
    return r.groupBy("id").agg(q.alias("q")).select("id", S.stable(F.col("q")[1] - F.col("q")[0]).alias("iqr"))


@query("disagreement_views", f"WITH {F0_SQL}, {MEMBERS_SQL}, k AS {rank_sql('mm', 'member')}, d AS (SELECT id, max(r/sz) FILTER (member='m1')-max(r/sz) FILTER (member='m2') AS d FROM k GROUP BY 1) SELECT id, {R('d')} AS diff, abs(d)>=0.1 AS large, CAST(sign({R('d')}) AS INTEGER) AS side FROM d")
def disagreement_views(spark, sf_dir):
    r = M.rank_pct(members(base_frame(spark, sf_dir)), "pred", ["member"]).groupBy("id").pivot("member", ["m1", "m2"]).agg(F.first("pct"))
    d = F.col("m1") - F.col("m2")
    return r.select("id", S.stable(d).alias("diff"), (F.abs(d) >= 0.1).alias("large"), F.signum(S.stable(d)).cast("int").alias("side"))


_PAT = "CAST((daily IS NULL)::INTEGER + 2*(social IS NULL)::INTEGER + 4*(gaming IS NULL)::INTEGER + 8*(work IS NULL)::INTEGER AS BIGINT)"


@query("missingness_reweighting", f"WITH {F0_SQL}, a AS (SELECT {_PAT} AS pattern, count(*) t FROM f0 WHERE fold<>0 GROUP BY 1), b AS (SELECT {_PAT} AS pattern, count(*) e FROM f0 WHERE fold=0 GROUP BY 1), n AS (SELECT (SELECT sum(t) FROM a) nt, (SELECT sum(e) FROM b) ne) SELECT pattern, coalesce(t,0) AS train_rows, coalesce(e,0) AS test_rows, {R('coalesce(t,0)/nt')} AS train_share, {R('coalesce(e,0)/ne')} AS test_share, {R('CASE WHEN t>0 THEN (coalesce(e,0)/ne)/(t/nt) END')} AS weight FROM a FULL JOIN b USING (pattern), n")
def missingness_reweighting(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    p = MI.pattern_weights(f.where("fold <> 0"), f.where("fold = 0"), COLS)
    return p.select("pattern", "train_rows", "test_rows", *[S.stable(c).alias(c) for c in ("train_share", "test_share", "weight")])


@query("kish_effective_sample", f"WITH {F0_SQL}, a AS (SELECT {_PAT} AS pattern, count(*) t FROM f0 WHERE fold<>0 GROUP BY 1), b AS (SELECT {_PAT} AS pattern, count(*) e FROM f0 WHERE fold=0 GROUP BY 1), n AS (SELECT (SELECT sum(t) FROM a) nt, (SELECT sum(e) FROM b) ne), w AS (SELECT t, (coalesce(e,0)/ne)/(t/nt) AS w FROM a LEFT JOIN b USING (pattern), n) SELECT {R('sum(t*w)*sum(t*w)/sum(t*w*w)')} AS ess, CAST(coalesce(sum(t) FILTER (w=0),0) AS BIGINT) AS zero_rows FROM w")
def kish_effective_sample(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    w = MI.row_weights(f.where("fold <> 0"), f.where("fold = 0"), COLS)
    return w.agg(S.stable(M.kish("weight")).alias("ess"), F.sum((F.col("weight") == 0).cast("long")).alias("zero_rows"))


_FLAGS = {c: f"({c} IS NULL)::INTEGER::DOUBLE" for c in COLS}
_PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1 :]]


@query("missing_mask_phi", f"WITH {F0_SQL} " + " UNION ALL ".join(f"SELECT '{a}:{b}' AS pair, {R(f'corr({_FLAGS[a]},{_FLAGS[b]})')} AS phi, {R(f'corr({_FLAGS[a]},{_FLAGS[b]})*sqrt(count(*))')} AS z FROM f0" for a, b in _PAIRS))
def missing_mask_phi(spark, sf_dir):
    return MI.mask_dependence(base_frame(spark, sf_dir), COLS).select("pair", S.stable("phi").alias("phi"), S.stable("z").alias("z"))


@query("missing_cohen_d", f"WITH {F0_SQL} " + " UNION ALL ".join(f"SELECT '{c}:{v}' AS pair, {R(f'(avg({v}) FILTER ({c} IS NULL)-avg({v}) FILTER ({c} IS NOT NULL))/stddev_samp({v})')} AS d FROM f0" for c in ("daily", "social") for v in ("weekend", "age")))
def missing_cohen_d(spark, sf_dir):
    return MI.cohen_d(base_frame(spark, sf_dir), ["daily", "social"], ["weekend", "age"]).select("pair", S.stable("d").alias("d"))


@query("missing_count_tv_distance")
def missing_count_tv_distance(spark, sf_dir):
    return MI.missing_count_distance(base_frame(spark, sf_dir), COLS).select(S.stable("tv").alias("tv"))


@query("hanley_mcneil_and_wilson", f"WITH {F0_SQL}, {MEMBERS_SQL}, a AS (SELECT member, auc FROM {auc_sql('mm', 'member')}), c AS (SELECT sum(y) p, sum(1-y) q FROM f0), v AS (SELECT member, auc, p, q, auc/(2-auc) q1, 2*auc*auc/(1+auc) q2 FROM a, c) SELECT member, {R('sqrt((auc*(1-auc)+(p-1)*(q1-auc*auc)+(q-1)*(q2-auc*auc))/(p*q))')} AS sd, {R('(p/(p+q)+3.8416/(2*(p+q))-1.96*sqrt((p/(p+q))*(1-p/(p+q))/(p+q)+3.8416/(4*(p+q)*(p+q))))/(1+3.8416/(p+q))')} AS low FROM v")
def hanley_mcneil_and_wilson(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    c = f.agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("q"))
    a = M.auc(members(f), "pred", "y", ["member"]).crossJoin(F.broadcast(c))
    low, _ = S.wilson("p", F.col("p") + F.col("q"))
    return a.select("member", S.stable(S.hanley_mcneil("auc", "p", "q")).alias("sd"), S.stable(low).alias("low"))
