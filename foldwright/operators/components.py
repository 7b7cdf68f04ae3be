"""Connected components of small catalogues (members, lineage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def groups(nodes: DataFrame, edges: DataFrame, node: str = "member", strength: str = "auc", rounds: int = 20) -> DataFrame:
    """Rows (node, group, representative): groups joined by edges (a, b); the
    strongest node represents (ties by name).  Minimum labels travel along edges
    until nothing changes."""
    e = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lab = nodes.select(F.col(node).alias("n"), F.col(node).alias("g"))
    for _ in range(rounds):
        near = e.join(lab.withColumnRenamed("n", "b"), "b").groupBy(F.col("a").alias("n")).agg(F.min("g").alias("m"))
        new = lab.join(near, "n", "left").select("n", F.least("g", F.coalesce("m", "g")).alias("g"), (F.coalesce("m", "g") < F.col("g")).alias("moved"))
        rows = new.collect()  # a row per member of a catalogue
        lab = nodes.sparkSession.createDataFrame([(r["n"], r["g"]) for r in rows], lab.schema)
        if not any(r["moved"] for r in rows):
            break
    j = nodes.join(lab.withColumnRenamed("n", node), node)
    w = Window.partitionBy("g").orderBy(F.desc(strength), node)
    return j.select(node, F.col("g").alias("group"), F.first(node).over(w).alias("representative"))


def greedy_dedup(nodes: list[tuple[str, float]], rho: dict[tuple[str, str], float], limit: float = 0.998) -> list[str]:
    """Members by strength, dropping those too close to one already kept."""
    kept: list[str] = []
    for name, _ in sorted(nodes, key=lambda x: (-x[1], x[0])):
        if all(abs(rho.get((min(name, k), max(name, k)), 0.0)) < limit for k in kept):
            kept.append(name)
    return kept
