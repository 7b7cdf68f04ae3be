"""MLlib learners on the base frame (values differ from other libraries' learners
by construction, so these have no SQL equivalent)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions.semantics import stable
from foldwright.operators import metrics as M
from foldwright.operators import models as L
from foldwright.sources.tables import base_frame

from . import query

COLS = ["daily", "social", "gaming", "work", "weekend", "sleep"]


def _frame(spark, sf_dir):
    return base_frame(spark, sf_dir).na.fill(0.0, COLS).withColumn("y", F.when(F.col("age") > 25, 1).otherwise(F.col("y") * F.pmod("id", F.lit(2))).cast("int"))


@query("model_boosted_trees_nested")
def model_boosted_trees_nested(spark, sf_dir):
    f = _frame(spark, sf_dir)
    p = L.boosted_trees(f.where("fold <> 0"), f.where("fold = 0"), [*COLS, "age"], "y", rounds=5)
    return M.auc(p.withColumn("pred", stable("pred")), "pred", "y").select("n", stable("auc", 3).alias("auc"))


@query("model_logistic_onehot")
def model_logistic_onehot(spark, sf_dir):
    f = _frame(spark, sf_dir)
    p = L.logistic_onehot(f.where("fold <> 0"), f.where("fold = 0"), ["gender", "stress"], ["age", "daily"], "y")
    return M.auc(p.withColumn("pred", stable("pred", 4)), "pred", "y").select("n", stable("auc", 3).alias("auc"))


@query("model_permutation_importance")
def model_permutation_importance(spark, sf_dir):
    f = _frame(spark, sf_dir)
    return L.permutation_importance(f.where("fold <> 0"), f.where("fold = 0"), [*COLS, "age"], ["age", "daily"], "y").select("feature", stable("drop", 2).alias("drop"))


@query("model_adversarial_drift")
def model_adversarial_drift(spark, sf_dir):
    f = _frame(spark, sf_dir)
    return L.adversarial_auc(f.where("fold = 0"), f.where("fold = 1"), COLS).select(stable("auc", 2).alias("auc"))


@query("model_chained_imputation")
def model_chained_imputation(spark, sf_dir):
    from foldwright.operators.impute import chained_fill

    f = base_frame(spark, sf_dir).select("id", "fold", "daily", "social", "gaming")
    out = chained_fill(f.where("fold <> 0"), f, ["daily", "social", "gaming"], rounds=1)
    return out.select("id", *[stable(f"{c}_fill", 3).alias(f"{c}_fill") for c in ("daily", "social", "gaming")])
