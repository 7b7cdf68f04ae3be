"""Row-wise providers, scalar functions, filters and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwright.functions import derived as D
from foldwright.functions import semantics as S
from foldwright.operators import missingness as M
from foldwright.sources.tables import F0_SQL, base_frame, table

from . import query

R = lambda x: f"round_even(({x})*1e6,0)/1e6"
MOD10 = lambda x: f"CAST(floor(((({x}) % 10) + 10) % 10) AS BIGINT)"

_SGW = "(coalesce(social,0.0)+coalesce(gaming,0.0)+coalesce(work,0.0))"
_STRESS = "(CASE stress WHEN 'Low' THEN 0.0::DOUBLE WHEN 'Medium' THEN 1.0::DOUBLE WHEN 'High' THEN 2.0::DOUBLE END)"
_RATIO = lambda a, b: f"CASE WHEN {b}>0 THEN ({a})/{b} END"
DERIVED_SQL = {
    "other_screen": "daily-(social+gaming+work)",
    "screen_slack": f"daily-{_SGW}",
    "screen_slack_n_obs": "CASE WHEN daily IS NOT NULL THEN CAST(social IS NOT NULL AS INTEGER)+CAST(gaming IS NOT NULL AS INTEGER)+CAST(work IS NOT NULL AS INTEGER) END",
    "sgw_sum": _SGW,
    "sgw_frac": f"{_SGW}/CASE WHEN daily IS NOT NULL THEN greatest(daily,0.1) END",
    "slack_frac": f"(daily-{_SGW})/CASE WHEN daily IS NOT NULL THEN greatest(daily,0.1) END",
    "wk_minus_sgw": f"weekend-{_SGW}",
    "wk_other": f"weekend-(daily-{_SGW})",
    "gaming_minus_work": "gaming-work",
    "screen_minus_work": "daily-work",
    "weekend_minus_daily": "weekend-daily",
    "social_share": _RATIO("social", "daily"),
    "gaming_share": _RATIO("gaming", "daily"),
    "work_share": _RATIO("work", "daily"),
    "screen_per_sleep": _RATIO("daily", "sleep"),
    "total_screen": "daily+weekend",
    "activity_total": "social+gaming+work",
    "engagement_total": "notifications+opens",
    "activity_share_screen": _RATIO("social+gaming+work", "daily"),
    "notif_per_app": _RATIO("notifications", "opens"),
    "screen_per_app": _RATIO("daily*60", "opens"),
    "sleep_deficit": "CASE WHEN sleep IS NOT NULL THEN greatest(9-sleep,0.0) END",
    "log_notifications": "ln(1+notifications)",
    "log_app_opens": "ln(1+opens)",
    "screen_x_stress": f"daily*{_STRESS}",
    "social_x_stress": f"social*{_STRESS}",
    "sleep_x_stress": f"sleep*{_STRESS}",
}
_WHOLE = {"screen_slack_n_obs"}


@query("row_derived_columns", f"WITH {F0_SQL} SELECT id, " + ", ".join(f"{v if k in _WHOLE else R(v)} AS {k}" for k, v in DERIVED_SQL.items()) + " FROM f0")
def row_derived_columns(spark, sf_dir):
    out = D.derive(base_frame(spark, sf_dir), list(DERIVED_SQL))
    return out.select("id", *[F.col(k) if k in _WHOLE else S.stable(k).alias(k) for k in DERIVED_SQL])


@query("row_decimal_digit", f"WITH {F0_SQL} SELECT id, " + ", ".join(f"{MOD10(f'round_even(({c}*10)*1e6,0)/1e6')} AS {c}_dec1" for c in D.DEC_COLUMNS) + " FROM f0")
def row_decimal_digit(spark, sf_dir):
    names = [f"{c}_dec1" for c in D.DEC_COLUMNS]
    return D.derive(base_frame(spark, sf_dir), names).select("id", *names)


def _identity_sql(c: str) -> list[str]:
    r = {d: f"round_even({c}*{10**d}.0::DOUBLE,0)/{10**d}.0::DOUBLE" for d in (0, 1, 2)}
    out = [f"{v} AS {c}_round{d}" for d, v in r.items()] + [f"{R(f'abs({c}-{v})')} AS {c}_absdiff{d}" for d, v in r.items()]
    out += [f"CAST(abs({c}-{r[d]})<1e-9 AS INTEGER) AS {c}_is_round{d}" for d in (0, 1)]
    return out + [f"{MOD10(f'round_even(abs({c})*{k}*1e6,0)/1e6')} AS {c}_{n}" for k, n in ((10, "tenths"), (100, "hundredths"))]


@query("row_identity_digits", f"WITH {F0_SQL} SELECT id, " + ", ".join(x for c in D.IDENTITY_COLUMNS for x in _identity_sql(c)) + " FROM f0")
def row_identity_digits(spark, sf_dir):
    cols = {k: v for c in D.IDENTITY_COLUMNS for k, v in D.identity_digits(c).items()}
    return base_frame(spark, sf_dir).select("id", *[(S.stable(v) if "_absdiff" in k else v).alias(k) for k, v in cols.items()])


_R2 = lambda x: f"round_even(({x})*100.0::DOUBLE,0)/100.0::DOUBLE"


@query("row_constraint_parts", f"WITH {F0_SQL} SELECT id, {_R2('social+gaming+work')} AS fake_daily, {_R2('daily-(gaming+work)')} AS fake_social, {_R2('daily-(social+work)')} AS fake_gaming, {_R2('daily-(social+gaming)')} AS fake_work FROM f0")
def row_constraint_parts(spark, sf_dir):
    return base_frame(spark, sf_dir).select("id", *[v.alias(k) for k, v in D.constraint_parts().items()])


@query("row_missing_flags", f"WITH {F0_SQL} SELECT id, " + ", ".join(f"CAST({c} IS NULL AS FLOAT) AS {c}_missing" for c in ("daily", "social", "gaming", "work")) + " FROM f0")
def row_missing_flags(spark, sf_dir):
    return base_frame(spark, sf_dir).select("id", *D.missing_flags(["daily", "social", "gaming", "work"]))


_FILL = "f AS (SELECT id, y, stress, gender, price, coalesce(daily,3.0) AS daily, coalesce(social,1.0) AS social, coalesce(gaming,1.0) AS gaming, coalesce(work,1.0) AS work, coalesce(weekend,5.0) AS weekend, coalesce(sleep,4.0) AS sleep, coalesce(notifications,8.0) AS notifications, coalesce(opens,0.0) AS opens FROM f0)"
_COMP = {
    "imp_resid": "daily-(social+gaming+work)", "imp_leisure": "social+gaming", "imp_social_frac": "social/nullif(daily,0)", "imp_work_frac": "work/nullif(daily,0)",
    "imp_leisure_frac": "(social+gaming)/nullif(daily,0)", "imp_resid_frac": "(daily-(social+gaming+work))/nullif(daily,0)", "imp_wk_ratio": "weekend/nullif(daily,0)",
    "imp_week_total": "5*daily+2*weekend", "imp_awake_screen_frac": "daily/nullif(24-sleep,0)", "imp_free_time": "24-sleep-daily", "imp_notif_per_open": "notifications/nullif(opens,0)",
    "imp_min_per_open": "60*daily/nullif(opens,0)", "imp_over_9h": "CAST(sleep>9 AS INTEGER)", "imp_under_3h": "CAST(daily<3 AS INTEGER)", "imp_screen_over_sleep": "daily/nullif(sleep,0)",
    "imp_screen_minus_sleep": "daily-sleep", "imp_gaming_over_daily": "gaming/nullif(daily,0)", "imp_weekend_minus_daily": "weekend-daily", "imp_screen_mean_dw": "(daily+weekend)/2",
}
_FLAG = {"imp_over_9h", "imp_under_3h"}


@query("row_imputed_compositions", f"WITH {F0_SQL}, {_FILL} SELECT id, " + ", ".join(f"{v if k in _FLAG else R(v)} AS {k}" for k, v in _COMP.items()) + " FROM f")
def row_imputed_compositions(spark, sf_dir):
    fill = {"daily": 3.0, "social": 1.0, "gaming": 1.0, "work": 1.0, "weekend": 5.0, "sleep": 4.0, "notifications": 8.0, "opens": 0.0}
    f = base_frame(spark, sf_dir).na.fill(fill)
    return f.select("id", *[(v if k in _FLAG else S.stable(v)).alias(k) for k, v in D.compositions().items()])


@query(
    "row_scalar_functions",
    f"""WITH {F0_SQL}, p AS (SELECT id, daily, round_even(age*2,0)/100.0::DOUBLE AS p FROM f0)
    SELECT id, {R('ln(least(greatest(p,1e-6),1-1e-6)/(1-least(greatest(p,1e-6),1-1e-6)))')} AS logit_p, {R('1/(1+exp(-(p*8-4)))')} AS sigmoid_p,
    {R('CASE WHEN p>0 AND p<1 THEN -(p*ln(p)+(1-p)*ln(1-p)) ELSE 0.0 END')} AS entropy_p, {R('sign(p-0.5)*(p-0.5)*(p-0.5)')} AS signed_square_p,
    CAST(floor(round_even(daily/0.25*1e8,0)/1e8) AS BIGINT) AS cell, {R('((id*1103515245+7*12345)%2147483648)/2147483648.0::DOUBLE')} AS u FROM p""",
)
def row_scalar_functions(spark, sf_dir):
    p = base_frame(spark, sf_dir).select("id", "daily", (F.rint(F.col("age") * 2) / 100.0).alias("p"))
    f = {"logit_p": S.logit("p"), "sigmoid_p": S.sigmoid(F.col("p") * 8 - 4), "entropy_p": S.entropy("p"), "signed_square_p": S.signed_square(F.col("p") - 0.5), "u": S.uniform("id", 7)}
    return p.select("id", *[S.stable(v).alias(k) for k, v in f.items()], S.quantize("daily", 0.25).alias("cell"))


@query("row_rule_margin", f"WITH {F0_SQL}, m AS (SELECT id, CASE WHEN daily>8 OR social>4 THEN 1.0 WHEN daily<=6 AND social<=4 THEN 0.0 ELSE 0.5 END::DOUBLE AS p FROM f0) SELECT id, p, {R('ln(least(greatest(p,1e-3),0.999)/(1-least(greatest(p,1e-3),0.999)))')} AS margin FROM m")
def row_rule_margin(spark, sf_dir):
    m = base_frame(spark, sf_dir).select("id", D.rule_margin().alias("p"))
    return m.select("id", "p", S.stable(S.logit("p", 1e-3)).alias("margin"))


@query("row_placebo_mask", f"WITH {F0_SQL} SELECT id, CASE WHEN social IS NOT NULL THEN {R('((id*1103515245+42*12345)%2147483648)/2147483648.0::DOUBLE')} END AS placebo FROM f0")
def row_placebo_mask(spark, sf_dir):
    return base_frame(spark, sf_dir).select("id", F.when(F.col("social").isNotNull(), S.stable(S.uniform("id", 42))).alias("placebo"))


@query("row_names_and_digests", "SELECT p_partkey, regexp_extract(p_type, '^([A-Za-z]+)', 1) AS head, lower(trim(regexp_replace(p_brand || '  ' || p_type, '[^0-9A-Za-z]+', '_', 'g'), '_')) AS clean, sha256(p_name || '|' || p_size) AS digest FROM part")
def row_names_and_digests(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.regexp_extract("p_type", "^([A-Za-z]+)", 1).alias("head"), S.sanitize(F.concat("p_brand", F.lit("  "), "p_type")).alias("clean"), F.sha2(F.concat("p_name", F.lit("|"), F.col("p_size").cast("string")), 256).alias("digest"))


@query("row_epoch_to_local_time", "SELECT event_id, strftime(make_timestamp((epoch_us(ts)//1000)*1000) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time FROM events")
def row_epoch_to_local_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return e.select("event_id", F.date_format(F.from_utc_timestamp(F.timestamp_millis("ms"), "Asia/Seoul"), "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("filter_complete_cases", f"WITH {F0_SQL} SELECT id, daily, social, gaming, work FROM f0 WHERE daily IS NOT NULL AND social IS NOT NULL AND gaming IS NOT NULL AND work IS NOT NULL")
def filter_complete_cases(spark, sf_dir):
    cols = ["daily", "social", "gaming", "work"]
    return base_frame(spark, sf_dir).dropna(subset=cols).select("id", *cols)


@query("filter_fold_split_all_folds", f'WITH {F0_SQL} SELECT k.k AS "outer", count(*) AS n_train, CAST(sum(y) AS BIGINT) AS pos FROM f0, (SELECT unnest([0,1,2,3,4])::INTEGER AS k) k WHERE fold<>k.k GROUP BY 1')
def filter_fold_split_all_folds(spark, sf_dir):
    from foldwright.operators.ensemble import outer_folds

    return outer_folds(base_frame(spark, sf_dir), 5).groupBy("outer").agg(F.count("*").alias("n_train"), F.sum("y").alias("pos"))


@query("filter_unknown_vocabulary", f"WITH {F0_SQL}, v AS (SELECT DISTINCT price FROM f0 WHERE fold<>0) SELECT id, price FROM f0 WHERE fold=0 AND price IS NOT NULL AND price NOT IN (SELECT price FROM v)")
def filter_unknown_vocabulary(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    return f.where("fold = 0 and price is not null").join(f.where("fold <> 0").select("price").distinct(), "price", "left_anti").select("id", "price")


@query("filter_grid_membership", f"WITH {F0_SQL}, g AS (SELECT DISTINCT social FROM f0 WHERE gender='x' AND social IS NOT NULL) SELECT id FROM f0 WHERE gender='z' AND social IN (SELECT social FROM g)")
def filter_grid_membership(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    grid = f.where("gender = 'x' and social is not null").select("social").distinct()
    return f.where("gender = 'z'").join(grid, "social", "left_semi").select("id")


@query("filter_quantile_slice", f"WITH {F0_SQL}, q AS (SELECT quantile_cont(age,0.25) a, quantile_cont(age,0.5) b, quantile_cont(age,0.75) c FROM f0) SELECT id, CASE WHEN age<=a THEN 'q1' WHEN age<=b THEN 'q2' WHEN age<=c THEN 'q3' ELSE 'q4' END AS slice FROM f0, q")
def filter_quantile_slice(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    q = f.agg(F.percentile("age", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    a = F.col("age")
    return f.crossJoin(F.broadcast(q)).select("id", F.when(a <= F.col("q")[0], "q1").when(a <= F.col("q")[1], "q2").when(a <= F.col("q")[2], "q3").otherwise("q4").alias("slice"))


@query("filter_interval_bins_last_closed", f"WITH {F0_SQL} SELECT CASE WHEN age<10 THEN 0 WHEN age<20 THEN 1 WHEN age<30 THEN 2 WHEN age<=49 THEN 3 END AS bin, count(*) AS n FROM f0 GROUP BY 1")
def filter_interval_bins_last_closed(spark, sf_dir):
    from foldwright.operators.diagnostics import interval_bin

    return base_frame(spark, sf_dir).groupBy(interval_bin("age", [0, 10, 20, 30, 49]).alias("bin")).agg(F.count("*").alias("n"))


@query("missing_pattern_bitmask", f"WITH {F0_SQL} SELECT id, CAST((daily IS NULL)::INTEGER + 2*(social IS NULL)::INTEGER + 4*(gaming IS NULL)::INTEGER + 8*(work IS NULL)::INTEGER AS BIGINT) AS pattern, CASE WHEN m<=1 THEN 0 WHEN m<=3 THEN 1 ELSE 2 END AS band, CASE WHEN m=0 THEN '0' WHEN m<=2 THEN '1-2' WHEN m<=5 THEN '3-5' ELSE '6+' END AS bucket FROM (SELECT *, (daily IS NULL)::INTEGER+(social IS NULL)::INTEGER+(gaming IS NULL)::INTEGER+(work IS NULL)::INTEGER AS m FROM f0)")
def missing_pattern_bitmask(spark, sf_dir):
    c = ["daily", "social", "gaming", "work"]
    return base_frame(spark, sf_dir).select("id", M.bitmask(c).alias("pattern"), M.band(c).alias("band"), M.bucket(c).alias("bucket"))


@query("reshape_unpivot_describe", f"WITH {F0_SQL}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM f0" for c in ("daily", "social", "gaming", "work", "weekend")) + f") SELECT col, count(*) AS n, count(v) AS observed, min(v) AS lo, max(v) AS hi, {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS sd, count(DISTINCT v) AS nunique FROM u GROUP BY 1")
def reshape_unpivot_describe(spark, sf_dir):
    cols = ["daily", "social", "gaming", "work", "weekend"]
    u = base_frame(spark, sf_dir).unpivot(["id"], cols, "col", "v")
    return u.groupBy("col").agg(F.count("*").alias("n"), F.count("v").alias("observed"), F.min("v").alias("lo"), F.max("v").alias("hi"), S.stable(F.avg("v")).alias("mean"), S.stable(F.stddev_samp("v")).alias("sd"), F.count_distinct("v").alias("nunique"))


@query("reshape_pivot_rate_by_set", f"WITH {F0_SQL} SELECT stress, {R('avg(y) FILTER (fold=0)')} AS f0, {R('avg(y) FILTER (fold=1)')} AS f1, {R('avg(y) FILTER (fold=2)')} AS f2 FROM f0 GROUP BY 1")
def reshape_pivot_rate_by_set(spark, sf_dir):
    p = base_frame(spark, sf_dir).groupBy("stress").pivot("fold", [0, 1, 2]).agg(F.avg("y"))
    return p.select("stress", *[S.stable(F.col(str(k))).alias(f"f{k}") for k in range(3)])


@query("set_union_distinct_dictionary", "SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code, v FROM (SELECT c_mktsegment AS v FROM customer UNION SELECT o_orderpriority FROM orders)")
def set_union_distinct_dictionary(spark, sf_dir):
    v = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("v")).union(table(spark, sf_dir, "orders").select("o_orderpriority")).distinct()
    return v.select((F.row_number().over(Window.orderBy("v")) - 1).alias("code"), "v")


@query("set_intersect_except", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_intersect_except(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    n = lambda d, k: d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(c.intersect(s), "both").unionByName(n(c.subtract(s), "only"))


@query("dedup_keep_first_after_sort", "SELECT l_partkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity) k FROM lineitem) WHERE k=1")
def dedup_keep_first_after_sort(spark, sf_dir):
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).where("k = 1").select("l_partkey", "l_orderkey", "l_extendedprice")


@query("sort_topk_by_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 25")
def sort_topk_by_abs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(25)


@query("sort_stratified_prefix_sample", f"WITH {F0_SQL} SELECT y, id FROM (SELECT y, id, row_number() OVER (PARTITION BY y ORDER BY (id*2654435761)%1000003, id) k FROM f0) WHERE k<=20")
def sort_stratified_prefix_sample(spark, sf_dir):
    w = Window.partitionBy("y").orderBy(F.pmod(F.col("id") * 2654435761, F.lit(1000003)), "id")
    return base_frame(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 20").select("y", "id")


@query("agg_missing_duplicates", "SELECT count(*) AS n, count(*)-count(DISTINCT (l_orderkey,l_linenumber)) AS duplicate_keys, count(DISTINCT l_partkey) AS parts FROM lineitem")
def agg_missing_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("l_orderkey", "l_linenumber")).alias("duplicate_keys"), F.count_distinct("l_partkey").alias("parts"))
