"""Declared feature plans: ordered column providers in three stages.

A plan is a list of providers; each declares its columns before it sees data, and
what it returns is checked against that.  Dataset-wide providers see all rows,
row-wise ones each row alone, fold-fit ones the training rows of a fold.  Only a
fold-fit provider may use the target, and it must carry a placebo column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions import derived
from foldwright.functions.semantics import uniform
from foldwright.operators import encoders

STAGES = ("dataset", "row", "fold")


@dataclass
class Provider:
    name: str = "provider"
    stage: str = "row"
    uses_target: bool = False

    def columns(self) -> list[str]:
        raise NotImplementedError

    def apply(self, df: DataFrame, fit: Column | None = None) -> DataFrame:
        raise NotImplementedError


@dataclass
class Derived(Provider):
    names: Sequence[str] = ()
    name: str = "derived"

    def columns(self) -> list[str]:
        return list(self.names)

    def apply(self, df: DataFrame, fit: Column | None = None) -> DataFrame:
        return derived.derive(df, self.names)


@dataclass
class MissingFlags(Provider):
    of: Sequence[str] = ()
    name: str = "missing_flags"

    def columns(self) -> list[str]:
        return [f"{c}_missing" for c in self.of]

    def apply(self, df: DataFrame, fit: Column | None = None) -> DataFrame:
        return df.select("*", *derived.missing_flags(self.of))


@dataclass
class Placebo(Provider):
    source: str = ""
    seed: int = 0
    name: str = "placebo"

    def columns(self) -> list[str]:
        return [f"placebo_{self.seed}"]

    def apply(self, df: DataFrame, fit: Column | None = None) -> DataFrame:
        return df.withColumn(f"placebo_{self.seed}", F.when(F.col(self.source).isNotNull(), uniform("id", self.seed)))


@dataclass
class PairCount(Provider):
    a: str = ""
    b: str = ""
    name: str = "pair_count"
    stage: str = "dataset"

    def columns(self) -> list[str]:
        return [f"{self.a}_{self.b}_ce"]

    def apply(self, df: DataFrame, fit: Column | None = None) -> DataFrame:
        ce = self.columns()[0]
        n = df.groupBy(F.col(self.a).alias("_a"), F.col(self.b).alias("_b")).agg(F.log1p(F.count("*").cast("double")).alias(ce))
        same = F.col(self.a).eqNullSafe(F.col("_a")) & F.col(self.b).eqNullSafe(F.col("_b"))
        return df.join(n, same).select(*df.columns, ce)


@dataclass
class TargetEncoding(Provider):
    of: Sequence[str] = ()
    smoothing: float = 10.0
    target: str = "y"
    placebo: bool = True
    name: str = "target_encoding"
    stage: str = "fold"
    uses_target: bool = True

    def columns(self) -> list[str]:
        return [f"{c}_te" for c in [*self.of, *(["placebo"] if self.placebo else [])]]

    def apply(self, df: DataFrame, fit: Column | None = None) -> DataFrame:
        stems = {c: encoders.value_key(c) for c in self.of}
        if self.placebo:  # a key without information
            stems["placebo"] = F.pmod(F.col("id") * 2654435761, F.lit(97)).cast("string")
        te = encoders.target_encode(df, stems, self.target, fit, "inner", self.smoothing)
        wide = te.groupBy("id").pivot("stem", list(stems)).agg(F.first("te"))
        return df.join(wide.select("id", *[F.col(s).alias(f"{s}_te") for s in stems]), "id")


@dataclass
class FeaturePlan:
    providers: list[Provider] = field(default_factory=list)

    def __post_init__(self) -> None:
        seen: set[str] = set()
        for p in self.providers:
            if p.stage not in STAGES:
                raise ValueError(f"unknown stage {p.stage}")
            if p.uses_target and p.stage != "fold":
                raise ValueError(f"{p.name} uses the target outside the fold stage")
            cols = p.columns()
            if p.uses_target and not any("placebo" in c for c in cols):
                raise ValueError(f"{p.name} uses the target without a placebo column")
            if clash := seen & set(cols):
                raise ValueError(f"declared twice: {sorted(clash)}")
            seen |= set(cols)

    def describe(self) -> list[tuple[str, str, list[str], bool]]:
        return [(p.stage, p.name, p.columns(), p.uses_target) for s in STAGES for p in self.providers if p.stage == s]

    def build(self, df: DataFrame, fold: int | None = None) -> DataFrame:
        """Dataset-wide and row-wise columns, then (for a fold) the fold-fit ones,
        fitted on the rows of other folds."""
        for s in STAGES:
            for p in self.providers:
                if p.stage != s or (s == "fold" and fold is None):
                    continue
                out = p.apply(df, F.col("fold") != fold if fold is not None else None)
                got = [c for c in out.columns if c not in df.columns]
                if got != p.columns():
                    raise ValueError(f"{p.name} declared {p.columns()} and made {got}")
                df = out
        return df
