"""Missing-value patterns, their shares and reweighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.semantics import missing


def bitmask(cols: Sequence[str]) -> Column:
    """Sum of 2**position over the missing columns."""
    total = F.lit(0).cast("long")
    for i, c in enumerate(cols):
        total = total + F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return total


def band(cols: Sequence[str]) -> Column:
    """0: none or one missing, 1: two or three, 2: four or more."""
    m = missing(*cols)
    return F.when(m <= 1, 0).when(m <= 3, 1).otherwise(2)


def bucket(cols: Sequence[str]) -> Column:
    m = missing(*cols)
    return F.when(m == 0, "0").when(m <= 2, "1-2").when(m <= 5, "3-5").otherwise("6+")


def names(cols: Sequence[str]) -> Column:
    """Names of the missing columns, '-' where there are none."""
    a = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(a) == 0, "-").otherwise(F.array_join(a, ","))


def pattern_weights(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per pattern of train or test: rows, shares, weight test share / train share
    (0 where test has none, NULL where train has none)."""
    p = [bitmask(cols).alias("pattern"), names(cols).alias("names")]
    a = train.groupBy(*p).agg(F.count("*").alias("train_rows"))
    b = test.groupBy(*p).agg(F.count("*").alias("test_rows"))
    j = a.join(b, ["pattern", "names"], "full").na.fill(0, ["train_rows", "test_rows"])
    n = train.agg(F.count("*").alias("nt")).crossJoin(test.agg(F.count("*").alias("ne")))
    j = j.crossJoin(F.broadcast(n)).withColumn("train_share", F.col("train_rows") / F.col("nt")).withColumn("test_share", F.col("test_rows") / F.col("ne"))
    return j.select("pattern", "names", "train_rows", "test_rows", "train_share", "test_share", F.when(F.col("train_rows") > 0, F.col("test_share") / F.col("train_share")).alias("weight"))


def row_weights(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    w = pattern_weights(train, test, cols).select("pattern", "weight")
    return train.withColumn("pattern", bitmask(cols)).join(F.broadcast(w), "pattern")  # at most 2**len(cols) rows


def mask_dependence(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Phi correlation of the missing flags of all pairs of columns, z = phi sqrt(n)."""
    flag = lambda c: F.col(c).isNull().cast("double")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(F.count("*").alias("n"), *[F.corr(flag(a), flag(b)).alias(f"{a}:{b}") for a, b in pairs])
    return row.unpivot(["n"], [f"{a}:{b}" for a, b in pairs], "pair", "phi").select("pair", "phi", (F.col("phi") * F.sqrt("n")).alias("z"))


def missing_count_distance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Total variation distance of the histogram of missing counts from that of
    independent columns (Poisson-binomial, by convolution over arrays)."""
    counts = df.groupBy(missing(*cols).alias("k")).agg(F.count("*").alias("c"))
    rates = df.agg(F.array(*[F.avg(F.col(c).isNull().cast("double")) for c in cols]).alias("r"), F.count("*").alias("n"))
    pmf = F.aggregate("r", F.array(F.lit(1.0)), lambda acc, p: F.zip_with(F.concat(F.transform(acc, lambda x: x * (1 - p)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(acc, lambda x: x * p)), lambda a, b: a + b))
    expected = rates.select("n", F.posexplode(pmf).alias("k", "e"))
    both = expected.join(counts, "k", "left")
    return both.agg((F.sum(F.abs(F.coalesce("c", F.lit(0)) / F.col("n") - F.col("e"))) / 2).alias("tv"))


def cohen_d(df: DataFrame, cols: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(mean where missing - mean where there) / sd, per missing column and value."""
    aggs = []
    for c in cols:
        for v in values:
            if c != v:
                m = F.col(c).isNull()
                aggs.append(((F.avg(F.when(m, F.col(v))) - F.avg(F.when(~m, F.col(v)))) / F.stddev_samp(v)).alias(f"{c}:{v}"))
    row = df.agg(F.lit(1).alias("one"), *aggs)
    return row.unpivot(["one"], [x for x in row.columns if x != "one"], "pair", "d").drop("one")
