"""Fitting the power transform (R6): profile likelihoods of all columns from mergeable moments.

One pass evaluates a set of exponents for every column at once: tasks hold Arrow batches and keep,
for each (column, exponent), the count, mean and squared deviations of the transformed values and
the sum of the log term; these merge exactly, whatever the order.  A pass over a coarse grid
brackets the maximum of each column (the profile likelihood is concave in the exponent), the
parabola through the best three points gives its place, and passes with ever finer steps around
it end when the place moves by less than ``TOLERANCE``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-7
GRID = tuple(np.linspace(-2, 2, 9).tolist())
FINER = 16.0   # times smaller steps in each pass after the bracket
SIDE = 2       # points on either side
ROUNDING = 1e-14  # of a mean: a smaller deviation is that of the arithmetic


def transformed(x: Column, lam: float) -> Column:
    """Yeo-Johnson of ``x`` with exponent ``lam``."""
    pos = F.expm1(F.lit(lam) * F.log1p(x)) / lam if lam else F.log1p(x)
    neg = -F.expm1(F.lit(2.0 - lam) * F.log1p(-x)) / (2.0 - lam) if lam != 2.0 else -F.log1p(-x)
    return F.when(x >= 0, pos).otherwise(neg)


def _values(x: np.ndarray, log: np.ndarray, lam: float) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        up = np.expm1(lam * log) / lam if lam else log
        down = -np.expm1((2.0 - lam) * log) / (2.0 - lam) if lam != 2.0 else -log
    return np.where(x >= 0, up, down)


def _states(lams: list[list[float]]):
    """(f, k, n, mean, m2, j) of a task: moments of column f under its k-th exponent."""
    def fn(batches):
        held = [np.zeros((len(ls), 3)) for ls in lams]
        logs = [0.0] * len(lams)
        for batch in batches:
            for f, ls in enumerate(lams):
                x = batch.column(f).to_numpy(zero_copy_only=False).astype(float)
                x = x[np.isfinite(x)]
                if not len(x):
                    continue
                log = np.log1p(np.abs(x))
                logs[f] += float((np.sign(x) * log).sum())
                for k, lam in enumerate(ls):
                    t = _values(x, log, lam)
                    with np.errstate(over="ignore", invalid="ignore"):
                        n, mean = len(t), t.mean()
                        m2 = ((t - mean) ** 2).sum()
                        n0, mean0, m20 = held[f][k]
                        all_ = n0 + n
                        held[f][k] = all_, mean0 + (mean - mean0) * n / all_, m20 + m2 + (mean - mean0) ** 2 * n0 * n / all_
        rows = [(f, k, int(n), mean, m2, logs[f]) for f, h in enumerate(held) for k, (n, mean, m2) in enumerate(h) if n]
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["f", "k", "n", "mean", "m2", "j"])
    return fn


def likelihoods(df: DataFrame, cols: list[str], lams: list[list[float]]) -> list[list[float]]:
    """Profile log-likelihood of each column for each of its exponents; -inf where it is not defined."""
    states = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(
        _states(lams), "f int, k int, n bigint, mean double, m2 double, j double")
    over = Window.partitionBy("f", "k")
    mean = F.sum(F.col("n") * F.col("mean")).over(over) / F.sum("n").over(over)
    merged = (states.withColumn("_g", mean).withColumn("_d", F.col("mean") - F.col("_g")).groupBy("f", "k")
              .agg(F.sum("n").alias("n"), F.max("_g").alias("g"), F.sum(F.col("m2") + F.col("n") * F.col("_d") * F.col("_d")).alias("m2"), F.sum("j").alias("j")))
    out = [[-math.inf] * len(ls) for ls in lams]
    for r in merged.collect():  # a row for each column and exponent
        var = r["m2"] / r["n"]
        if math.isfinite(var) and var > (ROUNDING * r["g"]) ** 2:  # below it the values are one
            out[r["f"]][r["k"]] = -r["n"] / 2.0 * math.log(var) + (lams[r["f"]][r["k"]] - 1.0) * r["j"]
    return out


def _top(x: list[float], y: list[float]) -> tuple[float, int]:
    """Place of the maximum by the parabola around the best point, and the index of that point."""
    k = max(range(len(y)), key=lambda i: y[i])
    if not 0 < k < len(x) - 1 or not all(map(math.isfinite, y[k - 1:k + 2])):
        return x[k], k
    h, bend = x[k] - x[k - 1], y[k - 1] - 2 * y[k] + y[k + 1]
    return (x[k] + h / 2 * (y[k - 1] - y[k + 1]) / bend if bend < 0 else x[k]), k


def fit(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """The exponent of the greatest profile likelihood of each column's finite values.

    NaN for a column without a finite likelihood (constant, or no values): it is to be left as it is.
    """
    place = {c: 0.0 for c in cols}
    step = {c: GRID[1] - GRID[0] for c in cols}
    lams, open_ = {c: list(GRID) for c in cols}, list(cols)
    bracketed: set[str] = set()
    while open_:
        found = likelihoods(df, open_, [lams[c] for c in open_])
        for c, y in zip(list(open_), found):
            if not any(map(math.isfinite, y)):
                place[c] = math.nan
                open_.remove(c)
                continue
            at, k = _top(lams[c], y)
            edge = not 0 < k < len(lams[c]) - 1
            if edge:  # further that way; an end beyond which nothing is finite is the maximum
                if c in bracketed or at == place[c]:
                    bracketed.add(c)
                half = len(lams[c]) // 2
                place[c], lams[c] = at, [at + step[c] * i for i in range(-half, half + 1)]
                if c not in bracketed:
                    continue
            moved, place[c] = abs(at - place[c]), at
            if (c in bracketed and moved < TOLERANCE) or step[c] < TOLERANCE:
                open_.remove(c)
                continue
            bracketed.add(c)
            step[c] /= FINER
            lams[c] = [at + step[c] * i for i in range(-SIDE, SIDE + 1)]
    return place
