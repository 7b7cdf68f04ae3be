"""Shared-folder tables and size-checked joins used by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only where the cluster names no shared folder (tests, single machine).
DEFAULT_SHARED_DIR = "/tmp/checkpoints"
#: Rows of a two-column key table that may be broadcast (16 B a row: 32 MB).
BROADCAST_ROWS = 2_000_000


#: Bytes of an Arrow batch to a Python worker (the default is eight times that).
ARROW_BATCH = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor can reach."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = DEFAULT_SHARED_DIR
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fw-{name}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query when it has ended, not when the driver's garbage is collected.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, tidy: bool = False) -> tuple[DataFrame, str]:
    """Cut lineage: write df to the shared folder and reread it (with its path).
    tidy: the shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.set(TIDY, before) if before is not None else spark.conf.unset(TIDY)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by materialize() that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def by_size(df: DataFrame, keys: DataFrame, col: str, n_keys: int, how: str = "left_semi") -> DataFrame:
    """df LEFT SEMI (or ANTI) keys on col: the key table travels by broadcast while
    its counted size is within BROADCAST_ROWS, and by shuffle beyond that."""
    side = F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys
    return df.join(side, col, how)
