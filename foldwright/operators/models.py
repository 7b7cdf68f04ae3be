"""Learners from MLlib with the interface (fit rows, rows) -> predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.metrics import auc
from foldwright.operators.resampling import permute


def _predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("pred", vector_to_array("probability")[1])


def boosted_trees(fit: DataFrame, df: DataFrame, cols: Sequence[str], y: str, rounds: int = 20, depth: int = 3, seed: int = 0) -> DataFrame:
    p = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=y, maxIter=rounds, maxDepth=depth, seed=seed)])
    return _predict(p.fit(fit), df)


def logistic_onehot(fit: DataFrame, df: DataFrame, categories: Sequence[str], numbers: Sequence[str], y: str, c: float = 1.0) -> DataFrame:
    """Unseen and missing categories are the zero vector."""
    fill = {k: "__missing__" for k in categories}
    fit, df = fit.na.fill(fill), df.na.fill(fill)
    idx = StringIndexer(inputCols=list(categories), outputCols=[f"_i_{k}" for k in categories], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"_i_{k}" for k in categories], outputCols=[f"_h_{k}" for k in categories], dropLast=True)
    x = VectorAssembler(inputCols=[*[f"_h_{k}" for k in categories], *numbers], outputCol="_x")
    lr = LogisticRegression(featuresCol="_x", labelCol=y, regParam=1 / (c * max(1, fit.count())), elasticNetParam=0.0)
    return _predict(Pipeline(stages=[idx, hot, x, lr]).fit(fit), df)


def permutation_importance(fit: DataFrame, df: DataFrame, cols: Sequence[str], of: Sequence[str], y: str, repeats: int = 1) -> DataFrame:
    """AUC lost when a column's values move by a fixed number of rows."""
    p = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=y, maxIter=5, maxDepth=3, seed=0)]).fit(fit)
    base = auc(_predict(p, df), "pred", y).head()["auc"]
    out = None
    for c in of:
        for r in range(repeats):
            d = auc(_predict(p, permute(df, c, 7 + 13 * r)), "pred", y).select(F.lit(c).alias("feature"), (base - F.col("auc")).alias("drop"))
            out = d if out is None else out.unionByName(d)
    return out.groupBy("feature").agg(F.avg("drop").alias("drop"))


def adversarial_auc(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How well a classifier tells two tables apart (on the third of rows that it
    wasn't fitted on)."""
    both = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)))
    part = F.pmod(F.col("id"), F.lit(3))
    return auc(boosted_trees(both.where(part != 0), both.where(part == 0), cols, "_s", rounds=3), "pred", "_s")
