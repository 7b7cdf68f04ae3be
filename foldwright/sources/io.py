"""Sources and sinks."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = "record_type string, schema_version int, operation string, outcome string, seed int, fold int, worker string, start_ns long, duration_ns long, interval_s double, cpu double, gpus array<struct<util: double, mem: double, power: double>>"
RECORD_TYPES = ("metadata", "timing", "resource", "summary")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema; an empty cell is NULL, and only the
    wanted columns are parsed."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def write_csv(df: DataFrame, path: str, order: str) -> None:
    """One file in the order of a column (submissions are small)."""
    df.coalesce(1).sortWithinPartitions(order).write.option("header", True).csv(path)


def submission(sample: DataFrame, pred: DataFrame, id_col: str = "id") -> DataFrame:
    from foldwright.operators.joins import one_to_one

    return one_to_one(sample.select(id_col), pred, id_col)


def sha256_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def locked_proxy(spark: SparkSession, path: str, digest: str, required: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """A reference table whose bytes and columns are checked before it is read."""
    if sha256_of(path) != digest:
        raise ValueError("the reference file has changed")
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if bad := [c for c in forbidden if c in df.columns] or [c for c in required if c not in df.columns]:
        raise ValueError(f"forbidden or missing columns: {bad}")
    return df


def read_spec(spark: SparkSession, spec: str) -> DataFrame:
    """A prediction vector by its spec: ``file.parquet[column]``, ``file.npy`` or
    ``file.npy[:, i]``; rows (pos, pred)."""
    path, _, part = spec.partition("[")
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select(F.col(part.rstrip("]")).cast("double").alias("pred"))
    import numpy as np

    a = np.load(path)
    if part:
        a = a[:, int(part.rstrip("]").split(",")[1])]
    a = a.reshape(len(a), -1)[:, 0].astype(float)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "pos long, pred double")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event log of JSON lines (gzip too), with the declared schema."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def event_faults(events: DataFrame, version: int = 1) -> DataFrame:
    """One row of counts of what is wrong with an event log."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("long"))
    return events.agg(n(F.col("schema_version") != version).alias("version"), n(~F.col("record_type").isin(*RECORD_TYPES)).alias("kind"), n((F.col("record_type") == "timing") & (F.col("start_ns").isNull() | F.col("duration_ns").isNull())).alias("timing"))


def write_events(path: str, records: Iterable[dict]) -> None:
    with gzip.open(path, "wt") as f:
        for r in records:
            f.write(json.dumps(r) + "\n")


CHAMPION = T.StructType([T.StructField("name", T.StringType()), T.StructField("seeds", T.ArrayType(T.IntegerType())), T.StructField("evidence", T.StructType([T.StructField("oof", T.DoubleType()), T.StructField("seed_aucs", T.MapType(T.StringType(), T.DoubleType()))]))])


def read_ledger(spark: SparkSession, path: str, schema: T.StructType = CHAMPION) -> DataFrame:
    """A JSON or YAML ledger as typed rows with nested structs."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    rows = data if isinstance(data, list) else [data]
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def ordered_members(spark: SparkSession, path: str) -> DataFrame:
    """Member specs of a manifest in their frozen order: rows (pos, spec)."""
    return spark.read.option("multiLine", True).json(path).select(F.posexplode("members").alias("pos", "spec"))


def sqlite_table(spark: SparkSession, path: str, sql: str, schema: str, args: Sequence = ()) -> DataFrame:
    """Rows of a SELECT on a (small) SQLite store."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return spark.createDataFrame(c.execute(sql, tuple(args)).fetchall(), schema)


class RunStore:
    """Runs as long Parquet tables params, metrics, tags (run_id, key, value)."""

    KINDS = {"params": "string", "metrics": "double", "tags": "string"}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def log(self, run_id: str, **kinds: dict) -> None:
        for kind, values in kinds.items():
            rows = [(run_id, k, v) for k, v in values.items()]
            self.spark.createDataFrame(rows, f"run_id string, key string, value {self.KINDS[kind]}").coalesce(1).write.mode("append").parquet(f"{self.folder}/{kind}")

    def table(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}")

    def wide(self, kind: str, keys: Sequence[str]) -> DataFrame:
        return self.table(kind).groupBy("run_id").pivot("key", list(keys)).agg(F.first("value"))

    def artifact(self, run_id: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/artifacts/{run_id}/{name}")

    def read_artifact(self, run_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/artifacts/{run_id}/{name}")


def publish_json(path: str, value: object) -> None:
    """Atomically: written beside, synced, renamed."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def export_bundle(folder: str, path: str) -> None:
    """A folder as a zip with the digests of its files."""
    files = [p for p in sorted(Path(folder).rglob("*")) if p.is_file()]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps({str(p.relative_to(folder)): sha256_of(str(p)) for p in files}))
        for p in files:
            z.write(p, str(p.relative_to(folder)))


def import_bundle(path: str, folder: str) -> None:
    with zipfile.ZipFile(path) as z:
        manifest = json.loads(z.read("manifest.json"))
        for name, digest in manifest.items():
            data = z.read(name)
            if hashlib.sha256(data).hexdigest() != digest:
                raise ValueError(f"{name} does not match its digest")
            target = (Path(folder) / name).resolve()
            if not target.is_relative_to(Path(folder).resolve()):
                raise ValueError(f"{name} leaves the folder")
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(data)


def rescore(pred: DataFrame, labels: DataFrame, stored: float, tolerance: float = 1e-9) -> bool:
    """Whether predictions still give the stored AUC."""
    from foldwright.operators.metrics import auc

    got = auc(pred.join(labels, "id"), "pred", "y").head()["auc"]
    return got is not None and abs(got - stored) <= tolerance


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-insensitive digest."""
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).head()
    return int(r[0]), int(r[1] or 0)


def canonical_digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
