"""Further sources, weighted scores, searches and grids."""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwright.functions.semantics import stable
from foldwright.operators import joins
from foldwright.operators import metrics as M
from foldwright.operators import missingness as MI
from foldwright.operators import search as SE
from foldwright.sources import io
from foldwright.sources.tables import F0_SQL, MEMBERS_SQL, base_frame, members, table

from . import query
from .ensembles import NAMES
from .metric import _PAT, COLS, R, auc_sql


@query("source_fold_attach", f"WITH {F0_SQL} SELECT o_orderkey AS id, fold FROM orders JOIN f0 ON id=o_orderkey")
def source_fold_attach(spark, sf_dir):
    folds = base_frame(spark, sf_dir).select("id", "fold")
    return joins.align_or_fail(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), folds, "id").select("id", "fold")


@query("source_label_lookup", f"WITH {F0_SQL} SELECT id, y FROM f0")
def source_label_lookup(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    return joins.labels_for(f.select("id"), f, "id", "y")


@query("source_json_lines_events", "SELECT event_type, count(*) AS n, CAST(sum((event_id%50=0)::INTEGER) AS BIGINT) AS bad_version FROM events GROUP BY 1")
def source_json_lines_events(spark, sf_dir):
    from .store import scratch

    e = table(spark, sf_dir, "events").select(F.lit("timing").alias("record_type"), F.when(F.col("event_id") % 50 == 0, 2).otherwise(1).alias("schema_version"), F.col("event_type").alias("operation"), F.col("event_id").alias("start_ns"), F.lit(1).cast("long").alias("duration_ns"))
    path = scratch(spark)
    e.write.option("compression", "gzip").json(path)
    back = io.read_events(spark, path)
    return back.groupBy(F.col("operation").alias("event_type")).agg(F.count("*").alias("n"), F.sum((F.col("schema_version") != 1).cast("long")).alias("bad_version"))


@query("source_ledger_nested_struct", "SELECT 'champion' AS name, 42 AS seed, 0.97::DOUBLE AS auc UNION ALL SELECT 'champion', 43, 0.96 UNION ALL SELECT 'runner', 42, 0.95")
def source_ledger_nested_struct(spark, sf_dir):
    rows = [{"name": "champion", "seeds": [42, 43], "evidence": {"oof": 0.97, "seed_aucs": {"42": 0.97, "43": 0.96}}}, {"name": "runner", "seeds": [42], "evidence": {"oof": 0.95, "seed_aucs": {"42": 0.95}}}]
    with tempfile.TemporaryDirectory() as d:  # a ledger is a small file of the driver's
        io.publish_json(f"{d}/pool.json", rows)
        df = io.read_ledger(spark, f"{d}/pool.json")
    return df.select("name", F.explode("evidence.seed_aucs").alias("k", "auc")).select("name", F.col("k").cast("int").alias("seed"), "auc")


@query("source_sqlite_select", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey=1")
def source_sqlite_select(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]  # 25 rows
    with tempfile.TemporaryDirectory() as d:
        c = sqlite3.connect(os.path.join(d, "runs.db"))
        c.execute("CREATE TABLE nation (k INT, name TEXT, region INT)")
        c.executemany("INSERT INTO nation VALUES (?, ?, ?)", rows)
        c.commit()
        c.close()
        return io.sqlite_table(spark, os.path.join(d, "runs.db"), "SELECT k, name FROM nation WHERE region = ?", "n_nationkey int, n_name string", [1])


@query("source_member_specs_in_order", "SELECT CAST(i AS INTEGER) AS pos, 'm' || i || '.parquet[pred]' AS spec FROM (SELECT unnest(range(0,6)) AS i)")
def source_member_specs_in_order(spark, sf_dir):
    from .store import scratch

    text = json.dumps({"members": [f"m{i}.parquet[pred]" for i in range(6)]})
    path = scratch(spark)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return io.ordered_members(spark, path)


@query("auc_weighted_by_missingness", f"WITH {F0_SQL}, {MEMBERS_SQL}, a AS (SELECT {_PAT} AS pattern, count(*) t FROM f0 WHERE fold<>0 GROUP BY 1), b AS (SELECT {_PAT} AS pattern, count(*) e FROM f0 WHERE fold=0 GROUP BY 1), n AS (SELECT (SELECT sum(t) FROM a) nt, (SELECT sum(e) FROM b) ne), wt AS (SELECT id, (coalesce(e,0)/ne)/(t/nt) AS wgt FROM (SELECT id, fold, {_PAT} AS pattern FROM f0) JOIN a USING (pattern) LEFT JOIN b USING (pattern), n WHERE fold<>0), s AS (SELECT member, pred, y, wgt FROM mm JOIN wt USING (id)) SELECT member, {R('auc')} AS auc FROM {auc_sql('s', 'member', 'wgt')}")
def auc_weighted_by_missingness(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    w = MI.row_weights(f.where("fold <> 0"), f.where("fold = 0"), COLS).select("id", "weight")
    return M.auc(members(f).join(w, "id"), "pred", "y", ["member"], F.col("weight")).select("member", stable("auc").alias("auc"))


@query("search_removal")
def search_removal(spark, sf_dir):
    s = SE.SubsetScores(members(base_frame(spark, sf_dir)), NAMES)
    try:
        return spark.createDataFrame([(n,) for n in SE.removal_search(s, NAMES)], "member string")
    finally:
        s.close()


@query("search_exchange")
def search_exchange(spark, sf_dir):
    s = SE.SubsetScores(members(base_frame(spark, sf_dir)), NAMES)
    try:
        return spark.createDataFrame([(n,) for n in SE.exchange_search(s, ["m3", "m5"], ["m1", "m2", "m4"])], "member string")
    finally:
        s.close()


@query("search_parameter_grid", f"WITH {F0_SQL}, {MEMBERS_SQL}, g AS (SELECT beta, rho, id, y, round_even((m1+beta*(m2-m1)+rho*m3)*1e9,0) AS pred FROM mw, (SELECT unnest([0.0,0.25,0.5])::DOUBLE AS beta), (SELECT unnest([0.0,0.1])::DOUBLE AS rho)), a AS (SELECT beta, rho, auc FROM {auc_sql('g', 'beta, rho')}) SELECT beta, rho, {R('auc')} AS auc, row_number() OVER (ORDER BY {R('auc')} DESC, beta, rho) AS place FROM a")
def search_parameter_grid(spark, sf_dir):
    w = members(base_frame(spark, sf_dir)).groupBy("id", "y").pivot("member", ["m1", "m2", "m3"]).agg(F.first("pred"))
    grid = F.array(*[F.struct(F.lit(b).alias("beta"), F.lit(r).alias("rho")) for b, r in product([0.0, 0.25, 0.5], [0.0, 0.1])])
    g = w.select("y", "m1", "m2", "m3", F.inline(grid)).withColumn("pred", F.rint((F.col("m1") + F.col("beta") * (F.col("m2") - F.col("m1")) + F.col("rho") * F.col("m3")) * 1e9))
    a = M.auc(g, "pred", "y", ["beta", "rho"]).select("beta", "rho", stable("auc").alias("auc"))
    return a.withColumn("place", F.row_number().over(Window.orderBy(F.desc("auc"), "beta", "rho")).cast("long"))


@query("bundle_rescore", f"WITH {F0_SQL}, {MEMBERS_SQL} SELECT true AS matches")
def bundle_rescore(spark, sf_dir):
    m = members(base_frame(spark, sf_dir)).where("member = 'm1'")
    stored = M.auc(m, "pred", "y").head()["auc"]
    ok = io.rescore(m.select("id", "pred"), m.select("id", "y"), stored)
    return spark.range(1).select(F.lit(ok).alias("matches"))


@query("equivalence_band_by_size", f"WITH {F0_SQL}, {MEMBERS_SQL}, a AS (SELECT member, fold, auc FROM {auc_sql('mm', 'member, fold')}), p AS (SELECT l.fold, abs(l.auc-r.auc) AS d FROM a l JOIN a r ON l.fold=r.fold AND l.member<r.member) SELECT fold, {R('min(d)')} AS lo, {R('quantile_cont(d,0.5)')} AS median, {R('max(d)')} AS hi FROM p GROUP BY 1")
def equivalence_band_by_size(spark, sf_dir):
    a = M.auc(members(base_frame(spark, sf_dir)), "pred", "y", ["member", "fold"])
    l, r = a.select("fold", F.col("member").alias("a"), F.col("auc").alias("x")), a.select("fold", F.col("member").alias("b"), F.col("auc").alias("z"))
    p = l.join(r, "fold").where("a < b").select("fold", F.abs(F.col("x") - F.col("z")).alias("d"))
    return p.groupBy("fold").agg(stable(F.min("d")).alias("lo"), stable(F.percentile("d", F.lit(0.5))).alias("median"), stable(F.max("d")).alias("hi"))
