"""Steps with an inverse and the pipeline that undoes them.

Each step maps a table to model space and back.  Going back need not meet the
very values that went in: a model returns floats, so codes are rounded and
clipped to the known range, and columns that only helped the model are dropped.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxtab.operators.scale import StandardScaler


@dataclass
class ConstantColumns:
    """Leaves out given columns and puts their single values back."""
    cols: list[str]
    values: dict = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        row = df.agg(*[F.first(c, ignorenulls=True).alias(c) for c in self.cols]).first()
        self.values = {c: (row[c], df.schema[c].dataType) for c in self.cols}
        return df.drop(*self.cols)

    def undo(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.lit(v).cast(t) for c, (v, t) in self.values.items()})


@dataclass
class PermutedCodes:
    """Category to a seeded permutation of its sorted codes; back by rounding, clipping and looking up."""
    col: str
    seed: int = 0
    levels: list = field(default_factory=list)
    order: list[int] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        self.levels = sorted(r[0] for r in df.select(self.col).where(F.col(self.col).isNotNull()).distinct().collect())
        self.order = random.Random(self.seed).sample(range(len(self.levels)), len(self.levels))
        code = F.array_position(F.array(*[F.lit(v) for v in self.levels]), F.col(self.col)).cast("int")
        return df.withColumn(self.col, F.element_at(F.array(*[F.lit(float(k)) for k in self.order]), code))

    def undo(self, df: DataFrame) -> DataFrame:
        at = F.least(F.greatest(F.round(self.col), F.lit(0)), F.lit(len(self.levels) - 1)).cast("int")
        back = [self.levels[self.order.index(k)] for k in range(len(self.levels))]
        return df.withColumn(self.col, F.element_at(F.array(*[F.lit(v) for v in back]), at + 1))


@dataclass
class OneHot:
    """Category to one indicator for each level; back by the largest indicator (ties: first level)."""
    col: str
    levels: list = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        self.levels = sorted(r[0] for r in df.select(self.col).where(F.col(self.col).isNotNull()).distinct().collect())
        return df.withColumns({f"{self.col}__{k}": (F.col(self.col) == F.lit(v)).cast("double") for k, v in enumerate(self.levels)}).drop(self.col)

    def undo(self, df: DataFrame) -> DataFrame:
        names = [f"{self.col}__{k}" for k in range(len(self.levels))]
        best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        value = F.coalesce(*[F.when(F.col(n) == best, F.lit(v)) for n, v in zip(names, self.levels)])
        return df.withColumn(self.col, value).drop(*names)


@dataclass
class Standardised:
    """Train mean and deviation, and back."""
    cols: list[str]
    scaler: StandardScaler | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        self.scaler = StandardScaler(self.cols).fit(df)
        return self.scaler.transform(df)

    def undo(self, df: DataFrame) -> DataFrame:
        return self.scaler.inverse(df)


@dataclass
class ExtraColumns:
    """Appends columns that a transform makes (SVD, quantile maps); going back drops them."""
    make: object
    names: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.make(df)
        self.names = [c for c in out.columns if c not in df.columns]
        return out

    def undo(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.names)


@dataclass
class Reordered:
    """Feature columns in a seeded order (the others first), and back."""
    features: list[str]
    seed: int = 0
    before: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        self.before = df.columns
        order = random.Random(self.seed).sample(self.features, len(self.features))
        return df.select(*[c for c in df.columns if c not in self.features], *order)

    def undo(self, df: DataFrame) -> DataFrame:
        return df.select(*self.before)


class InversePipeline:
    """Steps in order, undone in the opposite order; the first columns' order comes back."""

    def __init__(self, steps: list):
        self.steps, self.columns = steps, []

    def apply(self, df: DataFrame) -> DataFrame:
        self.columns = df.columns
        for step in self.steps:
            df = step.apply(df)
        return df

    def undo(self, df: DataFrame) -> DataFrame:
        for step in reversed(self.steps):
            df = step.undo(df)
        return df.select(*self.columns)
