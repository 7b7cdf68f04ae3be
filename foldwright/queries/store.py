"""Plans end to end, sources, sinks and run stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldwright.functions.semantics import stable
from foldwright.operators import encoders, metrics
from foldwright.plans import plan as PL
from foldwright.sources import io
from foldwright.sources.tables import F0_SQL, base_frame, table

from . import query
from .encode import _k, _te_sql
from .metric import R, auc_sql


def scratch(spark) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    return f"{folder}/store-{uuid.uuid4().hex}"


_HEAD, _, _TAIL = _te_sql({"age": _k("age")}, 10.0).rpartition("SELECT id, stem")


@query("flagship_oof_target_encoding_auc", f"WITH {F0_SQL}, {_HEAD}, te AS (SELECT id, stem{_TAIL}), s AS (SELECT CAST(fold AS VARCHAR) AS scope, te AS pred, y FROM te JOIN f0 USING (id) UNION ALL SELECT 'all', te, y FROM te JOIN f0 USING (id)) SELECT scope, {R('auc')} AS auc FROM {auc_sql('s', 'scope')}")
def flagship_oof_target_encoding_auc(spark, sf_dir):
    """Smoothed target encoding with out-of-fold values, joined back, scored per
    fold and overall."""
    f = base_frame(spark, sf_dir)
    te = encoders.target_encode(f, {"age": encoders.value_key("age")}, "y", F.col("fold") != 0, "inner", 10.0)
    rows = te.withColumn("pred", stable("te")).join(f.select("id", "fold", "y"), "id")
    return metrics.auc_per_fold_and_overall(rows, "pred", "y").select("scope", stable("auc").alias("auc"))


@query("plan_build_matrix", f"WITH {F0_SQL}, n AS (SELECT gender, age, ln(1+count(*)) ce FROM f0 GROUP BY 1,2) SELECT id, {R('ce')} AS gender_age_ce, {R('daily-(coalesce(social,0.0)+coalesce(gaming,0.0)+coalesce(work,0.0))')} AS screen_slack, CAST(social IS NULL AS FLOAT) AS social_missing, CASE WHEN social IS NOT NULL THEN {R('((id*1103515245+7*12345)%2147483648)/2147483648.0::DOUBLE')} END AS placebo_7 FROM f0 JOIN n USING (gender, age)")
def plan_build_matrix(spark, sf_dir):
    p = PL.FeaturePlan([PL.PairCount(a="gender", b="age"), PL.Derived(names=["screen_slack"]), PL.MissingFlags(of=["social"]), PL.Placebo(source="social", seed=7)])
    m = p.build(base_frame(spark, sf_dir))
    return m.select("id", stable("gender_age_ce").alias("gender_age_ce"), stable("screen_slack").alias("screen_slack"), "social_missing", stable("placebo_7").alias("placebo_7"))


@query("plan_fold_fit")
def plan_fold_fit(spark, sf_dir):
    p = PL.FeaturePlan([PL.Derived(names=["sgw_sum"]), PL.TargetEncoding(of=["age", "gender"])])
    m = p.build(base_frame(spark, sf_dir), fold=0)
    return m.select("id", stable("sgw_sum").alias("sgw_sum"), *[stable(c).alias(c) for c in ("age_te", "gender_te", "placebo_te")])


@query("source_csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def source_csv_round_trip(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    return io.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query("source_parquet_single_column", "SELECT p_retailprice AS pred FROM part")
def source_parquet_single_column(spark, sf_dir):
    return io.read_spec(spark, f"{sf_dir}/part.parquet[p_retailprice]")


@query("sink_run_store_pivot", "SELECT 'run-' || n_nationkey AS run_id, CAST(n_regionkey AS DOUBLE) AS a, CAST(n_nationkey AS DOUBLE) AS b FROM nation WHERE n_nationkey<3")
def sink_run_store_pivot(spark, sf_dir):
    s = io.RunStore(spark, scratch(spark))
    for r in table(spark, sf_dir, "nation").where("n_nationkey < 3").collect():
        s.log(f"run-{r['n_nationkey']}", metrics={"a": float(r["n_regionkey"]), "b": float(r["n_nationkey"])})
    return s.wide("metrics", ["a", "b"])


@query("sink_submission", f"WITH {F0_SQL} SELECT id, daily AS pred FROM f0 WHERE fold=0")
def sink_submission(spark, sf_dir):
    f = base_frame(spark, sf_dir).where("fold = 0")
    path = scratch(spark)
    io.write_csv(io.submission(f, f.select("id", F.col("daily").alias("pred"))), path, "id")
    return io.read_csv(spark, path, "id long, pred double")


@query("sink_artifact_round_trip", f"WITH {F0_SQL} SELECT id, fold, price FROM f0")
def sink_artifact_round_trip(spark, sf_dir):
    s = io.RunStore(spark, scratch(spark))
    s.artifact("r1", "oof", base_frame(spark, sf_dir).select("id", "fold", "price"))
    return s.read_artifact("r1", "oof")


@query("seed_reuse_order_equality", f"WITH {F0_SQL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing, CAST(0 AS DOUBLE) AS max_diff FROM f0")
def seed_reuse_order_equality(spark, sf_dir):
    f = base_frame(spark, sf_dir).select("id", "fold", "price")
    path = scratch(spark)
    f.write.parquet(path)
    j = f.join(spark.read.parquet(path).select("id", F.col("fold").alias("f2"), F.col("price").alias("p2")), "id")
    return j.agg(F.count("*").alias("n"), F.sum((F.col("fold") != F.col("f2")).cast("long")).alias("differing"), F.max(F.abs(F.col("price") - F.col("p2"))).alias("max_diff"))
