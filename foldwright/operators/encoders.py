"""Group encodings joined back to rows, with out-of-fold values for fit rows.

All encoders share one shape: keys in long form (id, stem, key), one aggregation
by (stem, key) and one by (stem, key, fold); the value of a fit row is what is left
after its own inner fold is subtracted, so K folds cost two aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.semantics import entropy, round_even

MISSING = "__nan__"


def value_key(c: str, digits: int | None = None, floor: bool = False) -> Column:
    """A column's value as a key: exact, rounded, or its floor; missing has a key
    of its own."""
    x = F.col(c)
    if floor:
        x = F.floor(x).cast("double")
    elif digits is not None:
        x = round_even(x, digits)
    return F.coalesce(x.cast("string"), F.lit(MISSING))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", a, b)


def long_keys(df: DataFrame, stems: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """Rows (keep..., stem, key): one per row and stem, in one pass."""
    items = F.array(*[F.struct(F.lit(s).alias("stem"), k.alias("key")) for s, k in stems.items()])
    return df.select(*keep, F.inline(items))


def smoothed(total: Column, n: Column, m: float, g: Column) -> Column:
    """(total + m g) / (n + m); g where nothing is left to average."""
    return F.when(n + m > 0, (total + m * g) / (n + m)).otherwise(g)


def target_encode(df: DataFrame, stems: dict[str, Column], target: str, fit: Column, inner: str, smoothing: float, id_col: str = "id") -> DataFrame:
    """Rows (id, stem, te, ct).  Rows where fit is true get out-of-fold values (and
    counts); all others the full table's, unknown keys the fit mean and count 0."""
    if not smoothing >= 0 or smoothing == float("inf"):
        raise ValueError("smoothing must be finite and not negative")
    rows = df.select("*", fit.alias("_fit"))
    keys = long_keys(rows, stems, [id_col, target, inner, "_fit"])
    fitted = keys.where("_fit")
    full = fitted.groupBy("stem", "key").agg(F.sum(target).alias("s"), F.count("*").alias("n"))
    part = fitted.groupBy("stem", "key", inner).agg(F.sum(target).alias("ps"), F.count("*").alias("pn"))
    base = rows.where("_fit").groupBy(inner).agg(F.sum(target).alias("gs"), F.count("*").alias("gn"))
    whole = rows.where("_fit").agg(F.sum(target).alias("ts"), F.count("*").alias("tn"))
    g = base.crossJoin(F.broadcast(whole)).select(inner, ((F.col("ts") - F.col("gs")) / (F.col("tn") - F.col("gn"))).alias("g_out"))
    out = keys.join(full, ["stem", "key"], "left").join(part, ["stem", "key", inner], "left")
    out = out.join(F.broadcast(g), inner, "left").crossJoin(F.broadcast(whole))  # as many rows as folds, and one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    own_s, own_n = F.when(F.col("_fit"), zero("ps")).otherwise(0), F.when(F.col("_fit"), zero("pn")).otherwise(0)
    s, n = zero("s") - own_s, zero("n") - own_n
    mean = F.when(F.col("_fit"), F.col("g_out")).otherwise(F.col("ts") / F.col("tn"))
    return out.select(id_col, "stem", smoothed(s, n, smoothing, mean).alias("te"), n.cast("long").alias("ct"))


def lattice_stems(cols: Sequence[str], floor: bool = True, digits: int | None = None) -> dict[str, Column]:
    """All pairs of columns as cell keys."""
    return {f"{a}_{b}": pair_key(value_key(a, digits, floor), value_key(b, digits, floor)) for a, b in combinations(cols, 2)}


def frequency_encode(df: DataFrame, stems: dict[str, Column], fit: Column, id_col: str = "id") -> DataFrame:
    """Rows (id, stem, freq): count of the key among fit rows, 0 if unknown."""
    keys = long_keys(df.select("*", fit.alias("_fit")), stems, [id_col, "_fit"])
    n = keys.where("_fit").groupBy("stem", "key").agg(F.count("*").alias("freq"))
    return keys.join(n, ["stem", "key"], "left").select(id_col, "stem", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))


def pair_count_encode(train: DataFrame, test: DataFrame, a: str, b: str, id_col: str = "id") -> DataFrame:
    """log1p of the count of a pair of values in both tables together."""
    both = train.select(id_col, value_key(a).alias("a"), value_key(b).alias("b")).unionByName(test.select(id_col, value_key(a).alias("a"), value_key(b).alias("b")))
    n = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    return both.join(n, ["a", "b"]).select(id_col, F.log1p(F.col("n").cast("double")).alias(f"{a}_{b}_ce"))


def prior_stats(proxy: DataFrame, c: str, target: str, m: float) -> DataFrame:
    """Per value of a reference table: smoothed mean, weight of evidence, entropy,
    log count."""
    g = proxy.agg(F.avg(target).alias("g"))
    t = proxy.groupBy(value_key(c).alias("key")).agg(F.sum(target).alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(g))
    mean = smoothed(F.col("s"), F.col("n"), m, F.col("g"))
    t = t.select("key", "n", "g", mean.alias("mean"))
    woe = F.log(F.col("mean") / (1 - F.col("mean"))) - F.log(F.col("g") / (1 - F.col("g")))
    return t.select("key", "mean", woe.alias("woe"), entropy("mean").alias("entropy"), F.log1p(F.col("n").cast("double")).alias("count"))


def vocabulary(df: DataFrame, c: str, cap: int | None = None) -> DataFrame:
    """Rows (value, code): sorted values from 1 on; 0 is missing and the number
    after the last is unknown."""
    from pyspark.sql import Window

    v = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    if cap:
        v = v.orderBy(F.desc("n"), "value").limit(cap)
    return v.select("value", F.row_number().over(Window.orderBy("value")).alias("code"))


def encode_vocabulary(df: DataFrame, vocab: DataFrame, c: str) -> DataFrame:
    size = vocab.agg(F.count("*").cast("int").alias("size"))
    out = df.join(vocab.withColumnRenamed("value", c), c, "left").crossJoin(F.broadcast(size))
    code = F.when(F.col(c).isNull(), 0).otherwise(F.coalesce("code", F.col("size") + 1))
    return out.select(*df.columns, code.alias(f"{c}_code"))
