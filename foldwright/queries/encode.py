"""Group encodings and their joins back to rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwright.functions.semantics import logit, stable
from foldwright.operators import encoders as E
from foldwright.operators import neighbors as N
from foldwright.sources.tables import F0_SQL, base_frame, table

from . import query

R = lambda x: f"round_even(({x})*1e6,0)/1e6"


def _te_sql(stems: dict[str, str], m: float, g: str = "(ts-coalesce(gs,0))/(tn-gn)") -> str:
    """Outer fold 0 is held out; fit rows lose their own inner fold."""
    keys = " UNION ALL ".join(f"""SELECT id, y, "inner", fold<>0 AS fit, '{s}' AS stem, {k} AS key FROM f0""" for s, k in stems.items())
    return f"""k AS ({keys}), a AS (SELECT stem, key, sum(y) s, count(*) n FROM k WHERE fit GROUP BY 1,2),
    b AS (SELECT stem, key, "inner", sum(y) ps, count(*) pn FROM k WHERE fit GROUP BY 1,2,3), t AS (SELECT sum(y) ts, count(*) tn FROM f0 WHERE fold<>0),
    gi AS (SELECT "inner", sum(y) gs, count(*) gn FROM f0 WHERE fold<>0 GROUP BY 1),
    j AS (SELECT k.*, coalesce(s,0) - CASE WHEN fit THEN coalesce(ps,0) ELSE 0 END AS rs, coalesce(n,0) - CASE WHEN fit THEN coalesce(pn,0) ELSE 0 END AS rn,
      CASE WHEN fit THEN (ts-gs)/(tn-gn) ELSE ts/tn END AS g FROM k LEFT JOIN a USING (stem,key) LEFT JOIN b USING (stem,key,"inner") LEFT JOIN gi USING ("inner"), t)
    SELECT id, stem, {R(f'(rs+{m}*g)/(rn+{m})')} AS te, CAST(rn AS BIGINT) AS ct FROM j"""


def _k(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR),'__nan__')"


def _fl(c: str) -> str:
    return f"coalesce(CAST(floor({c}) AS VARCHAR),'__nan__')"


_EXACT = {c: _k(c) for c in ("daily", "social", "age")}


@query("enc_target_exact_value", f"WITH {F0_SQL}, {_te_sql(_EXACT, 10.0)}")
def enc_target_exact_value(spark, sf_dir):
    stems = {c: E.value_key(c) for c in _EXACT}
    out = E.target_encode(base_frame(spark, sf_dir), stems, "y", F.col("fold") != 0, "inner", 10.0)
    return out.select("id", "stem", stable("te").alias("te"), "ct")


_PAIRS = {f"{a}_{b}": f"{_fl(a)}||'|'||{_fl(b)}" for a, b in (("daily", "social"), ("daily", "gaming"), ("social", "gaming"))}


@query("enc_lattice_pairs", f"WITH {F0_SQL}, {_te_sql(_PAIRS, 20.0)}")
def enc_lattice_pairs(spark, sf_dir):
    out = E.target_encode(base_frame(spark, sf_dir), E.lattice_stems(["daily", "social", "gaming"]), "y", F.col("fold") != 0, "inner", 20.0)
    return out.select("id", "stem", stable("te").alias("te"), "ct")


_RICH = {
    "daily_r1": "coalesce(CAST(round_even(daily*10,0)/10 AS VARCHAR),'__nan__')",
    "daily_floor": _fl("daily"),
    "stress_daily": f"{_k('stress')}||'|'||{_fl('daily')}",
    "placebo_pair": f"{_fl('age')}||'|'||{_fl('weekend')}",
}


def _rich():
    return {
        "daily_r1": E.value_key("daily", 1),
        "daily_floor": E.value_key("daily", floor=True),
        "stress_daily": E.pair_key(E.value_key("stress"), E.value_key("daily", floor=True)),
        "placebo_pair": E.pair_key(E.value_key("age", floor=True), E.value_key("weekend", floor=True)),
    }


@query("enc_rich_lattice", f"WITH {F0_SQL}, {_te_sql(_RICH, 10.0)}")
def enc_rich_lattice(spark, sf_dir):
    out = E.target_encode(base_frame(spark, sf_dir), _rich(), "y", F.col("fold") != 0, "inner", 10.0)
    return out.select("id", "stem", stable("te").alias("te"), "ct")


_FK = " UNION ALL ".join(f"SELECT id, fold, '{s}' AS stem, {k} AS key FROM f0" for s, k in _RICH.items())


@query("enc_frequency", f"WITH {F0_SQL}, k AS ({_FK}), n AS (SELECT stem, key, count(*) c FROM k WHERE fold<>0 GROUP BY 1,2) SELECT id, stem, coalesce(c,0) AS freq FROM k LEFT JOIN n USING (stem,key)")
def enc_frequency(spark, sf_dir):
    return E.frequency_encode(base_frame(spark, sf_dir), _rich(), F.col("fold") != 0)


@query("enc_pair_count", f"WITH {F0_SQL}, n AS (SELECT {_k('gender')} a, {_k('age')} b, count(*) n FROM f0 GROUP BY 1,2) SELECT id, {R('ln(1+n)')} AS ce FROM f0 JOIN n ON {_k('gender')}=a AND {_k('age')}=b")
def enc_pair_count(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    return E.pair_count_encode(f.where("fold <> 0"), f.where("fold = 0"), "gender", "age").select("id", stable("gender_age_ce").alias("ce"))


@query(
    "enc_prior_statistics",
    f"""WITH {F0_SQL}, p AS (SELECT * FROM f0 WHERE fold=1), g AS (SELECT avg(y) g FROM p), t AS (SELECT {_k('age')} AS key, sum(y) s, count(*) n FROM p GROUP BY 1),
    m AS (SELECT key, n, g, (s+2.0*g)/(n+2.0) AS mean FROM t, g) SELECT key, {R('mean')} AS mean, {R('ln(mean/(1-mean))-ln(g/(1-g))')} AS woe, {R('-(mean*ln(mean)+(1-mean)*ln(1-mean))')} AS entropy, {R('ln(1+n)')} AS "count" FROM m""",
)
def enc_prior_statistics(spark, sf_dir):
    p = E.prior_stats(base_frame(spark, sf_dir).where("fold = 1"), "age", "y", 2.0)
    return p.select("key", *[stable(c).alias(c) for c in ("mean", "woe", "entropy", "count")])


@query("enc_vocabulary_codes", f"WITH {F0_SQL}, v AS (SELECT social, row_number() OVER (ORDER BY social) AS code FROM (SELECT DISTINCT social FROM f0 WHERE fold<>0 AND social IS NOT NULL)), s AS (SELECT count(*) AS size FROM v) SELECT id, CAST(CASE WHEN f0.social IS NULL THEN 0 ELSE coalesce(code, size+1) END AS INTEGER) AS social_code FROM f0 LEFT JOIN v USING (social), s")
def enc_vocabulary_codes(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    v = E.vocabulary(f.where("fold <> 0"), "social")
    return E.encode_vocabulary(f, v, "social").select("id", "social_code")


@query("enc_auto_smoothed_target", f"""WITH {F0_SQL}, g AS (SELECT avg(y) gm, var_pop(y) gv FROM f0 WHERE fold<>0), k AS (SELECT age, avg(y) m, var_pop(y) v, count(*) n FROM f0 WHERE fold<>0 GROUP BY 1)
    SELECT age, {R('CASE WHEN gv>0 THEN (n*gv*m + v*gm)/(n*gv+v) ELSE m END')} AS te FROM k, g""")
def enc_auto_smoothed_target(spark, sf_dir):
    return N.auto_smoothed(base_frame(spark, sf_dir).where("fold <> 0"), "age", "y").select("age", stable("te").alias("te"))


@query("enc_high_order_group_correction", f"""WITH {F0_SQL}, b AS (SELECT avg(y) g FROM f0 WHERE fold<>0), t AS (SELECT gender, stress, age, sum(y) s, count(*) n FROM f0 WHERE fold<>0 GROUP BY 1,2,3)
    SELECT gender, stress, age, n, {R('ln(least(greatest(s/n,1e-6),1-1e-6)/(1-least(greatest(s/n,1e-6),1-1e-6)))-ln(g/(1-g))')} AS correction, n>=5 AS covered5, n>=20 AS covered20 FROM t, b""")
def enc_high_order_group_correction(spark, sf_dir):
    f = base_frame(spark, sf_dir).where("fold <> 0")
    g = f.agg(F.avg("y").alias("g"))
    t = f.groupBy("gender", "stress", "age").agg(F.sum("y").alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(g))
    return t.select("gender", "stress", "age", "n", stable(logit(F.col("s") / F.col("n")) - logit("g")).alias("correction"), (F.col("n") >= 5).alias("covered5"), (F.col("n") >= 20).alias("covered20"))


@query("join_left_one_to_one", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey=c_custkey")
def join_left_one_to_one(spark, sf_dir):
    from foldwright.operators.joins import one_to_one

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return one_to_one(table(spark, sf_dir, "orders"), c, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("join_align_or_fail_counts", f"WITH {F0_SQL} SELECT CAST(count(*) FILTER (r.id IS NULL) AS BIGINT) AS missing, 0::BIGINT AS duplicates FROM f0 LEFT JOIN (SELECT id FROM f0 WHERE id%9<>2) r USING (id)")
def join_align_or_fail_counts(spark, sf_dir):
    from foldwright.operators.joins import alignment

    f = base_frame(spark, sf_dir)
    return alignment(f.select("id"), f.where("id % 9 <> 2").select("id"), "id").select("missing", "duplicates")


@query("join_full_outer_distributions", f"WITH {F0_SQL}, a AS (SELECT age, count(*) n FROM f0 WHERE fold<>0 AND gender='x' GROUP BY 1), b AS (SELECT age, count(*) n FROM f0 WHERE fold=0 AND age<40 GROUP BY 1) SELECT coalesce(a.age,b.age) AS age, coalesce(a.n,0) AS train, coalesce(b.n,0) AS test FROM a FULL JOIN b ON a.age=b.age")
def join_full_outer_distributions(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    a = f.where("fold <> 0 and gender = 'x'").groupBy("age").agg(F.count("*").alias("train"))
    return a.join(f.where("fold = 0 and age < 40").groupBy("age").agg(F.count("*").alias("test")), "age", "full").na.fill(0, ["train", "test"])


@query("knn_masked_label_mean", f"""WITH {F0_SQL}, s AS (SELECT stddev_samp(age) a, stddev_samp(weekend) b FROM f0 WHERE fold=1), r AS (SELECT id, age/s.a a, weekend/s.b b, y FROM f0, s WHERE fold=1 AND weekend IS NOT NULL),
    q AS (SELECT id, age/s.a a, weekend/s.b b FROM f0, s WHERE fold=0), d AS (SELECT q.id, r.y, row_number() OVER (PARTITION BY q.id ORDER BY round_even((coalesce((q.a-r.a)*(q.a-r.a),0)+coalesce((q.b-r.b)*(q.b-r.b),0))*1e9,0), r.id) k FROM q, r)
    SELECT id, {R('avg(y)')} AS nn3 FROM d WHERE k<=3 GROUP BY 1""")
def knn_masked_label_mean(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    ref = f.where("fold = 1 and weekend is not null")
    scale = f.where("fold = 1").agg(F.stddev_samp("age").alias("age"), F.stddev_samp("weekend").alias("weekend"))
    out = N.knn_mean(ref, f.where("fold = 0"), ["age", "weekend"], scale, "y", 3)
    return out.select("id", stable("nn3").alias("nn3"))


@query("class_cdf_difference", f"""WITH {F0_SQL}, r AS (SELECT age, y FROM f0 WHERE fold=1), c AS (SELECT sum(1-y) n0, sum(y) n1 FROM r), q AS (SELECT DISTINCT age FROM f0 WHERE fold=0)
    SELECT f.id, {R('d.a/n0-d.b/n1')} AS cdf_diff FROM f0 f JOIN (SELECT q.age, sum(1-r.y) FILTER (r.age<=q.age) a, sum(r.y) FILTER (r.age<=q.age) b FROM q, r GROUP BY 1) d USING (age), c WHERE f.fold=0""")
def class_cdf_difference(spark, sf_dir):
    from foldwright.operators.metrics import class_ecdf_difference

    f = base_frame(spark, sf_dir)
    return class_ecdf_difference(f.where("fold = 1"), f.where("fold = 0"), "age", "y", ["id"]).select("id", stable("cdf_diff").alias("cdf_diff"))


@query("kde_log_ratio", f"""WITH {F0_SQL}, r AS (SELECT age, y FROM f0 WHERE fold=1), b AS (SELECT y, CASE WHEN count(*)>1 AND least(stddev_samp(age),(quantile_cont(age,.75)-quantile_cont(age,.25))/1.34)>0 THEN least(greatest(0.9*least(stddev_samp(age),(quantile_cont(age,.75)-quantile_cont(age,.25))/1.34)*pow(count(*),-0.2),0.1),1.0) ELSE 0.3 END AS h FROM r GROUP BY 1),
    q AS (SELECT DISTINCT age AS x FROM f0), d AS (SELECT x, r.y, avg(exp(-0.5*((x-age)/h)*((x-age)/h))/(h*sqrt(2*pi()))) AS p FROM q, r JOIN b USING (y) GROUP BY 1,2)
    SELECT x AS age, {R('least(greatest(ln(greatest(max(p) FILTER (y=1),1e-300))-ln(greatest(max(p) FILTER (y=0),1e-300)),-20),20)')} AS log_ratio FROM d GROUP BY 1""")
def kde_log_ratio(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    return N.kde_log_ratio(f.where("fold = 1"), f, "age", "y").select("age", stable("log_ratio").alias("log_ratio"))


@query("impute_median", f"WITH {F0_SQL}, m AS (SELECT quantile_cont(daily,0.5) d, quantile_cont(social,0.5) s FROM f0 WHERE fold<>0) SELECT id, coalesce(daily,d) AS daily_fill, coalesce(social,s) AS social_fill FROM f0, m")
def impute_median(spark, sf_dir):
    from foldwright.operators.impute import median_fill

    f = base_frame(spark, sf_dir)
    return median_fill(f.where("fold <> 0"), f, ["daily", "social"]).select("id", "daily_fill", "social_fill")


@query("impute_constrained_clip", f"""WITH {F0_SQL}, e AS (SELECT *, coalesce(social,0)+coalesce(gaming,0)+coalesce(work,0) AS obs FROM f0)
    SELECT id, coalesce(daily, greatest(5.0, obs)) AS daily_fill, {", ".join(f"coalesce({c}, CASE WHEN daily IS NOT NULL THEN least(greatest(2.0,0.0), greatest(daily-obs,0.0)) ELSE greatest(2.0,0.0) END) AS {c}_fill" for c in ("social", "gaming", "work"))} FROM e""")
def impute_constrained_clip(spark, sf_dir):
    from foldwright.operators.impute import constrained_clip

    f = base_frame(spark, sf_dir)
    est = {"daily": F.lit(5.0), **{c: F.lit(2.0) for c in ("social", "gaming", "work")}}
    return constrained_clip(f, est, "daily", ("social", "gaming", "work")).select("id", "daily_fill", "social_fill", "gaming_fill", "work_fill")


@query("window_first_two_digits_quantized", f"WITH {F0_SQL} SELECT age, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, age) AS rank FROM f0 GROUP BY 1")
def window_first_two_digits_quantized(spark, sf_dir):
    g = base_frame(spark, sf_dir).groupBy("age").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "age")).cast("long"))
