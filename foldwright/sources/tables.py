"""The driver's tables and the base frame of features built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions.semantics import round_even

N_FOLDS, N_INNER = 5, 4
FEATURES = ("daily", "social", "gaming", "work", "weekend", "sleep", "notifications", "opens", "age")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outer_fold(id_col: str = "id"):
    return F.pmod(F.col(id_col) * 31 + 7, F.lit(N_FOLDS)).cast("int")


def inner_fold(id_col: str = "id"):
    return F.pmod(F.floor((F.col(id_col) * 17 + 3) / 5), F.lit(N_INNER)).cast("int")


def base_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: id, y, fold, inner, numeric features with injected
    missing values, and three categories.  All values lie on decimal grids, so sums
    don't depend on their order."""
    li = table(spark, sf_dir, "lineitem")
    agg = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_quantity").alias("q"),
        F.sum(F.rint(F.col("l_discount") * 100)).alias("d"),
        F.sum(F.rint(F.col("l_tax") * 100)).alias("t"),
        F.max("l_quantity").alias("hi"),
        F.min("l_quantity").alias("lo"),
        F.count("*").alias("n"),
        F.sum("l_linenumber").alias("ln"),
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_orderpriority", "o_totalprice", "o_custkey")
    df = o.join(agg, "id", "left")
    gap = lambda k, r, c: F.when(F.pmod(F.col("id") * k, F.lit(10)) != r, c)
    p = F.substring("o_orderpriority", 1, 1)
    return df.select(
        "id",
        "y",
        outer_fold().alias("fold"),
        inner_fold().alias("inner"),
        gap(7, 3, round_even(F.col("q") / 20, 1)).alias("daily"),
        gap(3, 4, F.col("d") / 10).alias("social"),
        gap(9, 5, F.col("t") / 10).alias("gaming"),
        gap(1, 6, F.col("n") / 2).alias("work"),
        gap(3, 7, F.col("hi") / 5).alias("weekend"),
        (F.col("lo") / 5).alias("sleep"),
        F.col("ln").cast("double").alias("notifications"),
        gap(7, 8, F.col("n").cast("double")).alias("opens"),
        F.pmod("o_custkey", F.lit(50)).cast("double").alias("age"),
        F.when(p <= "2", "High").when(p <= "3", "Medium").when(p < "5", "Low").alias("stress"),
        F.when(F.pmod("o_custkey", F.lit(3)) == 0, "x").otherwise("z").alias("gender"),
        (F.rint(F.col("o_totalprice")) / 1000).alias("price"),
    )


#: The same frame in DuckDB's SQL, to begin a WITH.
F0_SQL = """f0 AS (SELECT id, y, CAST((id*31+7) % 5 AS INTEGER) AS fold, CAST(((id*17+3)//5) % 4 AS INTEGER) AS "inner",
 CASE WHEN (id*7)%10<>3 THEN round_even(round_even(q/20*10,0)/10*10,0)/10 END AS daily,
 CASE WHEN (id*3)%10<>4 THEN d/10 END AS social, CASE WHEN (id*9)%10<>5 THEN t/10 END AS gaming,
 CASE WHEN id%10<>6 THEN n/2 END AS work, CASE WHEN (id*3)%10<>7 THEN hi/5 END AS weekend, lo/5 AS sleep,
 CAST(ln AS DOUBLE) AS notifications, CASE WHEN (id*7)%10<>8 THEN CAST(n AS DOUBLE) END AS opens, CAST(ck%50 AS DOUBLE) AS age,
 CASE WHEN p<='2' THEN 'High' WHEN p<='3' THEN 'Medium' WHEN p<'5' THEN 'Low' END AS stress,
 CASE WHEN ck%3=0 THEN 'x' ELSE 'z' END AS gender, round_even(tp,0)/1000 AS price
 FROM (SELECT o_orderkey AS id, CAST(o_orderstatus='F' AS INTEGER) AS y, substr(o_orderpriority,1,1) AS p, o_totalprice AS tp, o_custkey AS ck FROM orders) o
 LEFT JOIN (SELECT l_orderkey AS id, sum(l_quantity) AS q, sum(round_even(l_discount*100,0)) AS d, sum(round_even(l_tax*100,0)) AS t, max(l_quantity) AS hi, min(l_quantity) AS lo, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS ln FROM lineitem GROUP BY 1) a USING (id))"""


def members(f0: DataFrame) -> DataFrame:
    """Synthetic member predictions in long form (id, fold, y, member, pred): each
    a number on a grid, so ranks have ties."""
    p = {
        "m1": F.coalesce(F.col("daily") / 20, F.lit(0.4)) * 0.8 + F.col("y") * 0.1,
        "m2": F.coalesce(F.col("social") / 10, F.lit(0.3)) * 0.7 + F.col("y") * 0.15,
        "m3": F.coalesce(F.col("weekend") / 12, F.lit(0.5)) * 0.9,
        "m4": F.pmod(F.col("id") * 37, F.lit(101)) / 101.0 * 0.9 + F.col("y") * 0.05,
        "m5": 0.9 - F.pmod(F.col("id") * 37, F.lit(101)) / 101.0 * 0.5 - F.col("y") * 0.3,
    }
    wide = f0.select("id", "fold", "y", *[round_even(v + 0.01, 3).alias(k) for k, v in p.items()])
    return wide.unpivot(["id", "fold", "y"], list(p), "member", "pred")


MEMBERS_SQL = """mw AS (SELECT id, fold, y,
 round_even((coalesce(daily/20,0.4)*0.8 + y*0.1 + 0.01)*1000,0)/1000 AS m1, round_even((coalesce(social/10,0.3)*0.7 + y*0.15 + 0.01)*1000,0)/1000 AS m2,
 round_even((coalesce(weekend/12,0.5)*0.9 + 0.01)*1000,0)/1000 AS m3, round_even(((id*37)%101/101.0::DOUBLE*0.9 + y*0.05 + 0.01)*1000,0)/1000 AS m4,
 round_even((0.9 - (id*37)%101/101.0::DOUBLE*0.5 - y*0.3 + 0.01)*1000,0)/1000 AS m5 FROM f0),
 mm AS (SELECT id, fold, y, 'm1' AS member, m1 AS pred FROM mw UNION ALL SELECT id, fold, y, 'm2', m2 FROM mw UNION ALL SELECT id, fold, y, 'm3', m3 FROM mw
 UNION ALL SELECT id, fold, y, 'm4', m4 FROM mw UNION ALL SELECT id, fold, y, 'm5', m5 FROM mw)"""
