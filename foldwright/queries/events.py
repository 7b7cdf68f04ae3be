"""Interval and ordered queries over the event stream table, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions.semantics import stable
from foldwright.operators import eventlog as E
from foldwright.sources.tables import table
from foldwright.streaming import events as ST

from . import query
from .metric import R

_IV = "iv AS (SELECT event_id AS id, user_id, event_type, epoch_us(ts)//1000 AS s, epoch_us(ts)//1000 + 3600000*(1+event_id%48) AS e, value FROM events)"


def _intervals(spark, sf_dir):
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", start.alias("start"), (start + 3600000 * (1 + F.pmod("event_id", F.lit(48)))).alias("end"), "value")


_ISL = "n AS (SELECT *, CASE WHEN s<=max(e) OVER w THEN 0 ELSE 1 END AS new FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS island FROM n), i AS (SELECT user_id, island, min(s) AS s, max(e) AS e FROM k GROUP BY 1,2)"


@query("event_interval_union", f'WITH {_IV}, {_ISL} SELECT user_id, s AS "start", e AS "end" FROM i')
def event_interval_union(spark, sf_dir):
    return E.islands(_intervals(spark, sf_dir), "start", "end", ["user_id"])


@query("event_covered_time", f"WITH {_IV}, {_ISL} SELECT user_id, CAST(sum(e-s) AS BIGINT) AS covered FROM i GROUP BY 1")
def event_covered_time(spark, sf_dir):
    return E.covered(_intervals(spark, sf_dir), "start", "end", ["user_id"])


@query("event_unclassified_time", f"""WITH {_IV}, p AS (SELECT * FROM iv WHERE id%48=47), c AS (SELECT p.id, iv.s, iv.e FROM p JOIN iv ON iv.user_id=p.user_id AND iv.id%48<>47 AND iv.s>=p.s AND iv.e<=p.e),
 n AS (SELECT *, CASE WHEN s<=max(e) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY id ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), k AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY s,e ROWS UNBOUNDED PRECEDING) g FROM n), i AS (SELECT id, g, max(e)-min(s) AS t FROM k GROUP BY 1,2), t AS (SELECT id, sum(t) t FROM i GROUP BY 1)
 SELECT p.id, CAST(p.e-p.s-coalesce(t,0) AS BIGINT) AS unclassified FROM p LEFT JOIN t USING (id)""")
def event_unclassified_time(spark, sf_dir):
    iv = _intervals(spark, sf_dir)
    return E.unclassified(iv.where("id % 48 = 47").select("user_id", "id", "start", "end"), iv.where("id % 48 <> 47").select("user_id", "start", "end"), ["user_id"])


@query("event_weighted_percentile", f"WITH {_IV}, v AS (SELECT event_type, value, sum(1+id%5) w FROM iv GROUP BY 1,2), c AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING) c, sum(w) OVER (PARTITION BY event_type) t FROM v) SELECT event_type, min(value) AS percentile FROM c WHERE c>=0.95*t GROUP BY 1")
def event_weighted_percentile(spark, sf_dir):
    iv = _intervals(spark, sf_dir).withColumn("w", 1 + F.pmod("id", F.lit(5)))
    return E.weighted_percentile(iv, "value", "w", 0.95, ["event_type"])


@query("event_nearest_rank", f"WITH {_IV}, k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) k, count(*) OVER (PARTITION BY user_id) n FROM iv) SELECT user_id, value AS percentile FROM k WHERE k=greatest(CAST(ceil(0.5*n) AS BIGINT),1)")
def event_nearest_rank(spark, sf_dir):
    return E.nearest_rank(_intervals(spark, sf_dir), "value", 0.5, ["user_id"])


@query("event_running_best", f"WITH {_IV}, b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM iv) SELECT user_id, id, value FROM b WHERE b IS NULL OR value>b+1e-12")
def event_running_best(spark, sf_dir):
    return E.running_best(_intervals(spark, sf_dir), "value", ["start", "id"], ["user_id"]).select("user_id", "id", "value")


@query("event_latest_per_user", f"WITH {_IV} SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type<>'click')::INTEGER, s DESC, id DESC) k FROM iv) WHERE k=1")
def event_latest_per_user(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy((F.col("event_type") != "click").cast("int"), F.desc("start"), F.desc("id"))
    return _intervals(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "id")


@query("event_step_metrics", f"WITH {_IV} SELECT user_id, CAST(sum(CASE WHEN event_type='click' THEN e-s ELSE 0 END) AS BIGINT) AS click_total, CAST(sum(CASE WHEN event_type='view' THEN e-s ELSE 0 END) AS BIGINT) AS view_total FROM iv GROUP BY 1")
def event_step_metrics(spark, sf_dir):
    iv = _intervals(spark, sf_dir).withColumn("ms", F.col("end") - F.col("start"))
    return E.step_metrics(iv, ["click", "view"], "event_type", "ms", ["user_id"])


@query("event_props_json", f"SELECT CAST(json_extract(props,'$.k') AS BIGINT) AS k, count(*) AS n, {R('avg(round_even(value,0))')} AS mean FROM events GROUP BY 1")
def event_props_json(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), stable(F.avg(F.rint("value"))).alias("mean"))


@query("stream_tumbling_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1,2")
def stream_tumbling_counts(spark, sf_dir):
    return ST.run_available(spark, sf_dir, ST.tumbling_counts, "complete").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query("stream_user_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM k GROUP BY user_id, s")
def stream_user_sessions(spark, sf_dir):
    return ST.run_available(spark, sf_dir, ST.sessions, "complete").select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("stream_liveness_state")
def stream_liveness_state(spark, sf_dir):
    return ST.run_available(spark, sf_dir, ST.liveness, "update").groupBy("user_id").agg(F.max("beats").alias("beats"))
