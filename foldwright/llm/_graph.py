"""Connected components of edge tables by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """Rows (node, root), root the smallest node of its component, for every
    node with an edge; and the folder that holds them.

    A round makes each node hand its larger neighbours (large star), then its
    smaller ones (small star), to the smallest node it knows; a logarithmic
    number of rounds leaves stars around the roots.  A hub's neighbours are
    aggregated to one minimum before they meet, so hubs cost their degree."""
    spark = edges.sparkSession
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    e, path = materialize(e, "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        down = large.select(F.col("v").alias("x"), F.col("u").alias("y"))
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(least, "x")
        new = small.select(F.col("m").alias("u"), F.col("y").alias("v")).unionByName(least.select(F.col("m").alias("u"), F.col("x").alias("v")))
        new, new_path = materialize(new.where("u < v").distinct(), "edges")
        s = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        discard(spark, path)
        e, path = new, new_path
        if s == mark:
            break
        mark = s
    roots = e.select(F.col("u").alias("root")).distinct()
    out = e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots.select(F.col("root").alias("node"), "root"))
    out, out_path = materialize(out, "components")
    discard(spark, path)
    return out, out_path
