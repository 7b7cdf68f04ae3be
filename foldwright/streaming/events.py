"""Structured Streaming forms of the event-log queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEFAULT_FOLDER = "/tmp/checkpoints"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def _beat(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
    import pandas as pd

    beats, last = state.get if state.exists else (0, 0)
    for b in batches:
        beats += len(b)
        last = max(last, int(b["ts"].max().value // 10**9))
    state.update((beats, last))
    yield pd.DataFrame({"user_id": [key[0]], "beats": [beats], "last_seen": [last]})


def liveness(events: DataFrame) -> DataFrame:
    """Beats and the last of them per user, kept as arbitrary state."""
    rows = events.select("user_id", "ts").groupBy("user_id")
    return rows.applyInPandasWithState(_beat, "user_id long, beats long, last_seen long", "beats long, last_seen long", "update", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a stream over what is there and return as a table, for the mode complete, its
    last state, else all its rows.  Each batch is written beside the checkpoint by the
    tasks that make it: no row passes through the driver."""
    name = f"s_{uuid.uuid4().hex}"
    folder = spark.conf.get("spark.checkpoint.dir", None) or DEFAULT_FOLDER
    out, written = f"{folder}/{name}_out", []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{n}")
        written.append(n)

    stream = build(source(spark, sf_dir))
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{out}/{n}" for n in (written[-1:] if mode == "complete" else sorted(set(written)))])
