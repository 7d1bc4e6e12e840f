"""Distribution rebalancing and scaling (R0-R17) and feature relevance.

Every fitted step collects its statistics for all columns in one
aggregation (driver sees one row), then transforms with a pure ``select``
that stays inside whole-stage codegen.  Quantile grids stay in Spark: one
range sort ranks the distinct values of all columns, and knots are found there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxtab.functions.exprs import inv_norm_cdf, nonfinite_to_null
from ctxtab.functions.ranking import prefix_sum
from ctxtab.operators import power

Z75_MINUS_Z25 = 1.3489795003921634  # fixed value: Phi^-1(0.75) - Phi^-1(0.25)


def _train(df: DataFrame, split: str | None, fit_on: str) -> DataFrame:
    return df if (fit_on == "all" or split is None) else df.filter(F.col(split) == "train")


# ------------------------------------------------------------------ R1/R2/R12
def min_max_scale(df, cols, split="split", fit_on="train"):
    """(x - min) / (max - min) with train statistics; zero range maps to 0."""
    st = _train(df, split, fit_on).agg(*[F.min(c).alias(f"{c}__lo") for c in cols],
                                      *[F.max(c).alias(f"{c}__hi") for c in cols]).first()
    out = {}
    for c in cols:
        lo, hi = st[f"{c}__lo"], st[f"{c}__hi"]
        rng = (hi - lo) if (lo is not None and hi is not None) else 0.0
        out[c] = F.lit(0.0) * F.col(c) if not rng else (F.col(c) - F.lit(lo)) / F.lit(rng)
    return df.withColumns(out)


@dataclass
class StandardScaler:
    """R2: centred (or not) scaling by population std; zero std treated as 1."""
    cols: list[str]
    center: bool = True
    mean: dict = field(default_factory=dict)
    std: dict = field(default_factory=dict)

    def fit(self, df, split="split", fit_on="train"):
        st = _train(df, split, fit_on).agg(*[F.avg(c).alias(f"{c}__m") for c in self.cols],
                                          *[F.stddev_pop(c).alias(f"{c}__s") for c in self.cols]).first()
        self.mean = {c: float(st[f"{c}__m"] or 0.0) for c in self.cols}
        self.std = {c: float(st[f"{c}__s"]) if st[f"{c}__s"] else 1.0 for c in self.cols}
        return self

    def transform(self, df):
        return df.withColumns({c: (F.col(c) - F.lit(self.mean[c] if self.center else 0.0)) / F.lit(self.std[c])
                               for c in self.cols})

    def inverse(self, df):
        return df.withColumns({c: F.col(c) * F.lit(self.std[c]) + F.lit(self.mean[c] if self.center else 0.0)
                               for c in self.cols})


def standard_scale(df, cols, split="split", fit_on="train", center=True):
    return StandardScaler(cols, center).fit(df, split, fit_on).transform(df)


def mean_impute(df, cols, split="split", fit_on="train"):
    """Fill missing with the train mean; an all-missing column gets 0."""
    st = _train(df, split, fit_on).agg(*[F.avg(nonfinite_to_null(c)).alias(c) for c in cols]).first()
    return df.withColumns({c: F.coalesce(nonfinite_to_null(c), F.lit(float(st[c]) if st[c] is not None else 0.0))
                           for c in cols})


# ------------------------------------------------------------------ quantiles over ranked distinct values
def _sorted_values(df: DataFrame, cols: list[str], split: str | None, fit_on: str):
    """Distinct values of all columns in one range sort by (column, value), kept; of each column the first position, train count and number of values.

    ``(f, v, n, below)``: ``n`` train rows hold the value, ``below`` stand before it (those of earlier columns too).
    """
    cells = ", ".join(f"{i}, `__q{i}`" for i in range(len(cols)))
    seen = F.lit(1) if fit_on == "all" or split is None else (F.col(split) == "train").cast("int")
    long = (df.select(seen.cast("long").alias("n"), *[nonfinite_to_null(c).alias(f"__q{i}") for i, c in enumerate(cols)])
            .select("n", F.expr(f"stack({len(cols)}, {cells}) AS (f, v)")).where("v IS NOT NULL"))
    ranked = prefix_sum(long.groupBy("f", "v").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")), ["f", "v"], "n", "below")
    rows = {r["f"]: r for r in ranked.groupBy("f").agg(F.min("below").alias("base"), F.sum("n").alias("m"), F.count("v").alias("d")).collect()}
    return ranked, *[[int(rows[i][c]) if i in rows else 0 for i in range(len(cols))] for c in ("base", "m", "d")]


def ranked_values(df: DataFrame, cols: list[str], split: str | None = "split", fit_on: str = "train"):
    """Distinct values of all columns with their train ranks, and the train count of each column.

    Long form ``(f, v, below, upto)``: train values of column ``f`` below ``v`` and up to ``v``.  One
    range sort over the distinct values of every column, at every size; only the counts (a row for
    each column) reach the driver.
    """
    ranked, first, counts, _ = _sorted_values(df, cols, split, fit_on)
    base = F.element_at(F.array(*[F.lit(b).cast("long") for b in first]), F.col("f") + 1)
    ranked = ranked.select("f", "v", (F.col("below") - base).alias("below"), (F.col("below") - base + F.col("n")).alias("upto"))
    return ranked, counts


def quantiles(df: DataFrame, cols: list[str], probs: list[float], split="split", fit_on="train") -> dict[str, list[float]]:
    """Exact linear-interpolated quantiles of each column for a few given probabilities (empty without train values)."""
    ranked, counts = ranked_values(df, cols, split, fit_on)
    at = [[(m - 1) * p for p in probs] if m else [] for m in counts]
    need = [sorted({k for h in hs for k in (math.floor(h), math.ceil(h))}) for hs in at]
    lists = F.element_at(F.array(*[F.array(*[F.lit(k).cast("long") for k in n]).cast("array<long>") for n in need]), F.col("f") + 1)
    held = F.filter(lists, lambda k: (k >= F.col("below")) & (k < F.col("upto")))
    got = {(r["f"], r["k"]): r["v"] for r in ranked.select("f", "v", F.explode(held).alias("k")).collect()}
    out = {}
    for i, c in enumerate(cols):
        low = [(got[i, math.floor(h)], got[i, math.ceil(h)], h - math.floor(h)) for h in at[i]]
        out[c] = [x + t * (y - x) for x, y, t in low]
    return out


def n_quantiles_for(n_train: int, variant: str) -> int:
    """R3 grid size: a tenth of the rows, or a fifth (also for ``all_data``); at least 2, at most the rows."""
    base = {"10": n_train // 10, "5": n_train // 5, "all_data": n_train // 5}[variant]
    return max(1, min(max(base, 2), n_train))


HALO = 128  # train positions beside a run of values that hold all knots next to it: knots are less than 30 apart
RUN_ROWS = 1 << 16  # sorted values whose images are found at once


def _edges(batches):
    """Of a sorted part: its first and last ``HALO`` values with train rows, as (start, end, value)."""
    left, last = HALO, None
    out = lambda part: pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["start", "end", "v"])
    for batch in batches:
        f, v, n, below = _columns(batch)
        rows = [x[n > 0] for x in (below, below + n, v)]
        if left:
            yield out([x[:left] for x in rows])
            rows, left = [x[left:] for x in rows], left - len(rows[0][:left])
        last = [x[-HALO:] for x in (rows if last is None else map(np.concatenate, zip(last, rows)))]
    if last is not None:
        yield out(last)


def _columns(batch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy() for c in ("f", "v", "n", "below")]


def _images(base, counts, grid, edges):
    """Kernel over sorted parts: ``(f, v, q)``.  A value's knots lie between train values at most ``HALO`` positions away;
    those beyond the part are among the ``edges`` of the parts beside it."""
    base, m, g = np.array(base), np.array(counts) - 1, np.array(grid) - 1

    def image(f, v, n, start, own):
        """Of values of column ``f``; ``own`` are the train values around them."""
        below = start - base[f]
        if g[f] <= 0:
            return np.zeros(len(v))  # a single knot: all values at 0
        a = (below * g[f] + m[f] - 1) // m[f]  # first knot at or after the value's first position
        b = np.where(n > 0, ((below + n - 1) * g[f]) // m[f], a - 1)  # last one at or before its last position
        _, o_end, o_v = own

        def knot(k):
            inside = (k >= 0) & (k <= g[f])
            at, part = np.divmod(np.where(inside, k, 0) * m[f], g[f])
            j = np.minimum(np.searchsorted(o_end, base[f] + at, side="right"), len(o_v) - 1)
            here, there = o_v[j], o_v[np.minimum(j + 1, len(o_v) - 1)]
            with np.errstate(over="ignore"):
                x = np.where((part > 0) & (o_end[j] == base[f] + at + 1), here + part / g[f] * (there - here), here)
            return np.where(inside, x, np.nan)

        q = (a + b) / g[f] / 2
        free = np.nonzero(a > b)[0]
        if len(free):
            a, v = a[free], v[free]
            x2, x1, x0 = knot(a - 2), knot(a - 1), knot(a)
            ref = lambda k: k / g[f]
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                line = lambda x, y, k: np.where(np.isnan(x), 0.0, np.where(
                    np.isnan(y), 1.0, ref(k) + (v - x) / (y - x) * (ref(k + 1) - ref(k))))
                q[free] = np.where(x1 == v, ref(a - 1), np.where(x1 > v, line(x2, x1, a - 2), line(x1, x0, a - 1)))
        return q

    def with_own(before, held):
        f, v, n, start = held
        return [np.concatenate([x, y[n > 0]]) for x, y in zip(before, (start, start + n, v))]

    def finished(f, v, n, start, own):
        cut = np.nonzero(np.diff(f))[0] + 1
        q = np.concatenate([image(int(fs[0]), *rest, own) for fs, *rest in zip(*[np.split(x, cut) for x in (f, v, n, start)])])
        known = np.array(counts)[f] > 0
        return pa.RecordBatch.from_arrays([pa.array(f[known], pa.int32()), pa.array(v[known]), pa.array(q[known])], names=["f", "v", "q"])

    def kernel(batches):
        start, end, value = edges.value
        parts, rows, want, before = [], 0, RUN_ROWS, None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(_columns(batch))
            rows += batch.num_rows
            if before is None:
                i = np.searchsorted(end, parts[0][3][0], side="right")
                before = [x[max(0, i - HALO):i] for x in (start, end, value)]
            if rows < want:
                continue
            held = [np.concatenate(x) for x in zip(*parts)]
            ends = held[3] + held[2]
            ready = int(np.searchsorted(ends, ends[-1] - HALO, side="right"))  # enough train positions follow
            if ready:
                done = [x[:ready] for x in held]
                yield finished(*done, with_own(before, held))
                before = [x[-HALO:] for x in with_own(before, done)]
            parts, rows = [[x[ready:] for x in held]], len(held[0]) - ready
            want = max(RUN_ROWS, 2 * rows)
        if rows:
            held = [np.concatenate(x) for x in zip(*parts)]
            i = np.searchsorted(start, held[3][-1] + held[2][-1], side="left")
            after = [x[i:i + HALO] for x in (start, end, value)]
            yield finished(*held, [np.concatenate(x) for x in zip(with_own(before, held), after)])

    return kernel


MAP_BROADCAST = 100_000  # distinct values up to which a column's map is broadcast: rows are not dealt by a column of few values


def quantile_map(df, cols, variant="10", split="split", fit_on="train") -> list[DataFrame]:
    """For each column ``(v, q)``: the image in [0, 1] of every distinct value.

    Knot k of K lies at position (m - 1) k / (K - 1) of the m sorted train values.  A value that knots
    equal gets the middle of their references, another one lies on the line between the knots around
    it, and values beyond the ends get 0 or 1.  Knots are never gathered or joined: they are less than
    30 positions apart, so those around a value are found in the sorted part that holds it and at the
    edges of the parts beside it (``HALO`` values at each end of a part and no more go to all tasks).
    """
    ranked, base, counts, sizes = _sorted_values(df, cols, split, fit_on)
    found = ranked.mapInArrow(_edges, "start long, end long, v double").toArrow()
    edges = [found.column(c).to_numpy() for c in ("start", "end", "v")]
    order = np.argsort(edges[0], kind="stable")
    shared = df.sparkSession.sparkContext.broadcast([x[order] for x in edges])
    image = _images(base, counts, [n_quantiles_for(m, variant) for m in counts], shared)
    found = [ranked.where(F.col("f") == i).mapInArrow(image, "f int, v double, q double").select("v", "q") for i in range(len(cols))]
    return [F.broadcast(t) if n <= MAP_BROADCAST else t for t, n in zip(found, sizes)]


def _mapped(df: DataFrame, cols: list[str], maps: list[DataFrame], suffix: str) -> DataFrame:
    """``df`` with each column's values replaced by their images (missing stays missing)."""
    for c, table in zip(cols, maps):
        side = table.select(F.col("v").alias("__v"), F.col("q").alias("__q"))
        df = df.withColumn("__v", nonfinite_to_null(c)).join(side, "__v", "left").withColumn(c + suffix, F.col("__q")).drop("__v", "__q")
    return df


def _in_place(df, cols, maps, suffix):
    order = [*df.columns, *[c + suffix for c in cols if c + suffix not in df.columns]]
    return _mapped(df, cols, maps, suffix).select(*order)


def quantile_uniform(df, cols, variant="10", split="split", fit_on="train", suffix=""):
    """Map to [0, 1] through the train quantile grid; a column without train values becomes missing."""
    return _in_place(df, cols, quantile_map(df, cols, variant, split, fit_on), suffix)


BOUNDS = 1e-7  # fixed value: clip applied before the normal inverse CDF


def quantile_normal(df, cols, variant="10", split="split", fit_on="train", suffix=""):
    """R3 then the inverse normal CDF, clipped away from 0 and 1 (worked out once for each distinct value)."""
    clipped = F.least(F.greatest(F.col("q"), F.lit(BOUNDS)), F.lit(1 - BOUNDS))
    maps = [t.select("v", inv_norm_cdf(clipped).alias("q")) for t in quantile_map(df, cols, variant, split, fit_on)]
    return _in_place(df, cols, maps, suffix)


def robust_scale(df, cols, split="split", fit_on="train"):
    """(x - median) / (IQR / (z75 - z25)); zero IQR treated as 1."""
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], split, fit_on)
    out = {}
    for c in cols:
        q25, med, q75 = (qs[c] + [0.0, 0.0, 0.0])[:3] if qs[c] else (0.0, 0.0, 0.0)
        scale = (q75 - q25) / Z75_MINUS_Z25 if (q75 - q25) else 1.0
        out[c] = (F.col(c) - F.lit(med)) / F.lit(scale)
    return df.withColumns(out)


# ------------------------------------------------------------------ power / log
VAR_TOLERANCE, MAX_POWER = 1e-3, 100.0  # fixed values: when a power transform is taken back


def yeo_johnson_fit(df, cols, split="split", fit_on="train") -> dict[str, float]:
    """R6 fit: the exponent of the greatest profile likelihood of each column (see ``power``)."""
    return power.fit(_train(df, split, fit_on).select(*cols), list(cols))


def yeo_johnson(df, cols, split="split", fit_on="train"):
    """Power transform with fitted lambda, non-finite to missing, mean fill, standardise.

    A column goes back to its own values when its standardised train variance
    is not 1 within ``VAR_TOLERANCE`` or a train value exceeds ``MAX_POWER``.
    """
    from ctxtab.session import reuse
    df = reuse(df)  # the lambda passes, two moment passes and the transform scan it
    lam = yeo_johnson_fit(df, cols, split, fit_on)
    turned = {c: nonfinite_to_null(c) if math.isnan(lam[c]) else nonfinite_to_null(power.transformed(nonfinite_to_null(c), lam[c])) for c in cols}
    d = df.withColumns({f"__raw_{c}": F.col(c) for c in cols}).withColumns(turned)
    d = standard_scale(mean_impute(d, cols, split, fit_on), cols, split, fit_on)
    st = _train(d, split, fit_on).agg(*[F.var_pop(c).alias(f"{c}__v") for c in cols], *[F.max(c).alias(f"{c}__x") for c in cols]).first()
    back = [c for c in cols if st[f"{c}__v"] is not None and (abs(st[f"{c}__v"] - 1.0) > VAR_TOLERANCE or st[f"{c}__x"] > MAX_POWER)]
    return d.withColumns({c: F.col(f"__raw_{c}") for c in back}).drop(*[f"__raw_{c}" for c in cols])


def log_normal(df, cols, split="split", fit_on="train"):
    """Non-finite to missing, mean fill, shift by |min| + 1e-10, log, fill again."""
    d = mean_impute(df, cols, split, fit_on)
    st = _train(d, split, fit_on).agg(*[F.min(c).alias(c) for c in cols]).first()
    d = d.withColumns({c: F.log(F.col(c) + F.lit(abs(float(st[c] or 0.0))) + F.lit(1e-10)) for c in cols})
    return mean_impute(d, cols, split, fit_on)


# ------------------------------------------------------------------ kernel-density integral
KDI_GRID = 1000  # points between which the kernel CDF is a line


def _phi(z: np.ndarray) -> np.ndarray:
    """Normal CDF (the published polynomial 7.1.26 for erf, error below 1e-7)."""
    x = np.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * np.exp(-x * x)
    return np.where(z >= 0, 1.0 - half, half)


def kdi_fit(df, cols, alpha=1.0, split="split", fit_on="train"):
    """R8 fit: the Gaussian-kernel CDF of all train values of each column, on a grid over their range.

    Bandwidth is ``alpha`` x std.  Tasks sum the kernels of the distinct values they hold (with counts);
    the driver gets one number for each column and grid point.
    """
    full = mean_impute(df, cols, split, fit_on)
    st = _train(full, split, fit_on).agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)],
                                         *[F.stddev_pop(c).alias(f"sd{i}") for i, c in enumerate(cols)]).first()
    values, counts = ranked_values(full, cols, split, fit_on)
    h = [alpha * float(st[f"sd{i}"] or 0.0) for i in range(len(cols))]
    grid = [np.linspace(st[f"lo{i}"] - 3 * h[i], st[f"hi{i}"] + 3 * h[i], KDI_GRID) if h[i] > 0 else None for i in range(len(cols))]

    def sums(batches):
        total = {}
        for pdf in batches:
            for f, part in pdf.groupby("f"):
                if grid[f] is None:
                    continue
                for k in range(0, len(part), 1000):
                    v, n = part["v"].to_numpy()[k:k + 1000], part["n"].to_numpy()[k:k + 1000]
                    total[f] = total.get(f, 0) + _phi((grid[f][:, None] - v) / h[f]) @ n
        for f, t in total.items():
            yield pd.DataFrame({"f": f, "k": np.arange(KDI_GRID), "s": t})

    held = values.where("upto > below").select("f", "v", (F.col("upto") - F.col("below")).cast("double").alias("n"))
    cdf = {}
    for r in held.mapInPandas(sums, "f int, k int, s double").groupBy("f", "k").agg(F.sum("s").alias("s")).collect():
        cdf.setdefault(r["f"], np.zeros(KDI_GRID))[r["k"]] = r["s"] / counts[r["f"]]
    return {c: (grid[i], cdf[i]) if i in cdf else (np.zeros(1), np.full(1, 0.5)) for i, c in enumerate(cols)}


def kdi_uniform(df, cols, alpha=1.0, output="uniform", split="split", fit_on="train", suffix=""):
    """Kernel-density-integral map to [0, 1] (``output='normal'``: then inverse normal)."""
    grids = kdi_fit(df, cols, alpha, split=split, fit_on=fit_on)

    def mapped(c):
        g, cdf = grids[c]

        @F.pandas_udf("double")
        def image(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float, na_value=np.nan)
            return pd.Series(np.where(np.isnan(v), np.nan, np.interp(v, g, cdf)))

        return F.nanvl(image(nonfinite_to_null(c)), F.lit(None).cast("double"))

    for c in cols:
        df = df.withColumn(c + suffix, mapped(c))
        if output == "normal":
            df = df.withColumn(c + suffix, inv_norm_cdf(F.least(F.greatest(F.col(c + suffix), F.lit(BOUNDS)),
                                                                F.lit(1 - BOUNDS))))
    return df


# ------------------------------------------------------------------ SVD
def append_svd(df, cols, split="split", fit_on="train", n_components=None, prefix="svd_"):
    """Mean fill, scale by std (no centering), append the top-k right
    singular directions' projections, k = max(1, min(n/10 + 1, d/2)).

    The d x d Gram matrix comes from one aggregation; its eigendecomposition
    is metadata on the driver; projection is a ``select`` of dot products.
    """
    if len(cols) < 2:
        return df
    d0 = mean_impute(df, cols, split, fit_on)
    d0 = standard_scale(d0, cols, split, fit_on, center=False)
    tr = _train(d0, split, fit_on)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}"))
    row = tr.agg(*aggs).first()
    n, dim = int(row["__n"]), len(cols)
    G = np.zeros((dim, dim))
    for i, a in enumerate(cols):
        for j in range(i, dim):
            G[i, j] = G[j, i] = row[f"{a}__{cols[j]}"] or 0.0
    k = n_components or max(1, min(n // 10 + 1, dim // 2))
    vals, vecs = np.linalg.eigh(G)
    order = np.argsort(vals)[::-1][:k]
    V = vecs[:, order]
    for j in range(V.shape[1]):
        if V[np.argmax(np.abs(V[:, j])), j] < 0:
            V[:, j] = -V[:, j]
    scaled = {c: F.col(f"__s_{c}") for c in cols}
    both = standard_scale(mean_impute(df.withColumns({f"__s_{c}": F.col(c) for c in cols}), [f"__s_{c}" for c in cols], split, fit_on),
                          [f"__s_{c}" for c in cols], split, fit_on, center=False)
    proj = {f"{prefix}{j}": sum((scaled[c] * F.lit(float(V[i, j])) for i, c in enumerate(cols)), F.lit(0.0)) for j in range(V.shape[1])}
    return both.withColumns(proj).drop(*[f"__s_{c}" for c in cols])


# ------------------------------------------------------------------ network-side data maths
def soft_clip_outliers(df, cols, sigma=4.0, split="split", fit_on="train"):
    """Bounds mean +/- sigma*std (sample std) from train, recomputed once
    without the values outside, then a log-softened clip to those bounds."""
    tr = _train(df, split, fit_on)
    st = tr.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_samp(c).alias(f"{c}__s") for c in cols]).first()
    conds = []
    for c in cols:
        m, s = st[f"{c}__m"] or 0.0, st[f"{c}__s"] if st[f"{c}__s"] is not None else float("nan")
        lo, hi = m - sigma * s, m + sigma * s
        keep = (F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi)) if math.isfinite(s) else F.lit(True)
        conds.append((c, keep))
    st2 = tr.agg(*[F.avg(F.when(k, F.col(c))).alias(f"{c}__m") for c, k in conds],
                 *[F.stddev_samp(F.when(k, F.col(c))).alias(f"{c}__s") for c, k in conds]).first()
    out = {}
    for c in cols:
        m, s = st2[f"{c}__m"] or 0.0, st2[f"{c}__s"] if st2[f"{c}__s"] is not None else float("nan")
        lo, hi = m - sigma * s, m + sigma * s
        x = F.greatest(-F.log1p(F.abs(F.col(c))) + F.lit(lo), F.col(c))
        x = F.least(F.log1p(F.abs(x)) + F.lit(hi), x)
        out[c] = x
    return df.withColumns(out)


def train_standardise_clip(df, cols, split="split", fit_on="train"):
    """(x - mean) / (sample std + 1e-20), clipped to +/-100; std 1 for a single row."""
    tr = _train(df, split, fit_on)
    st = tr.agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"{c}__m") for c in cols],
                *[F.stddev_samp(c).alias(f"{c}__s") for c in cols]).first()
    out = {}
    for c in cols:
        s = 1.0 if st["__n"] <= 1 else float(st[f"{c}__s"] or 0.0) + 1e-20
        out[c] = F.least(F.greatest((F.col(c) - F.lit(float(st[f"{c}__m"] or 0.0))) / F.lit(s), F.lit(-100.0)),
                         F.lit(100.0))
    return df.withColumns(out)


def scale_by_valid_features(df, cols, width: int):
    """Multiply by sqrt(width / #non-constant features), zero-pad to ``width``."""
    st = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in cols]).first()
    n_valid = max(1, sum(1 for c in cols if st[c]))
    mult = math.sqrt(width / n_valid)
    pads = {f"pad_{i}": F.lit(0.0) for i in range(len(cols), width)}
    return df.withColumns({c: F.col(c) * F.lit(mult) for c in cols}).withColumns(pads)


@dataclass
class TargetScaler:
    """Standardise the regression target with train mean and std (``ddof``)."""
    ddof: int = 1
    mean: float = 0.0
    std: float = 1.0

    def fit(self, df, y="y", split="split"):
        tr = df.filter(F.col(split) == "train")
        agg = F.stddev_samp(y) if self.ddof == 1 else F.stddev_pop(y)
        r = tr.agg(F.avg(y), agg).first()
        self.mean, self.std = float(r[0] or 0.0), float(r[1] or 1.0) or 1.0
        return self

    def transform(self, df, y="y", out="y_std"):
        return df.withColumn(out, (F.col(y) - F.lit(self.mean)) / F.lit(self.std))

    def inverse(self, df, col="pred", out=None):
        return df.withColumn(out or col, F.col(col) * F.lit(self.std) + F.lit(self.mean))


# ------------------------------------------------------------------ routing / union
def route_columns(df, continuous: list[str], categorical: list[str], transform, original_flag: bool,
                  discrete_flag: bool, suffix: str = "_t"):
    """Assemble the output column set of a rebalancing member.

    ``original_flag``: all originals, then transformed continuous (and
    categorical when ``discrete_flag``) appended.  ``discrete_flag`` alone:
    everything transformed, no categoricals remain.  Neither: categoricals
    first, then transformed continuous.
    """
    rest = [c for c in df.columns if c not in continuous and c not in categorical]
    if original_flag:
        tcols = continuous + (categorical if discrete_flag else [])
        t = transform(df.select(*rest, *[F.col(c).alias(c + suffix) for c in tcols], *continuous, *categorical),
                      [c + suffix for c in tcols])
        return t.select(*rest, *continuous, *categorical, *[c + suffix for c in tcols])
    if discrete_flag:
        return transform(df, continuous + categorical).select(*rest, *continuous, *categorical)
    return transform(df, continuous).select(*rest, *categorical, *continuous)


def union_transforms(df, cols, transforms: dict, id_col="row_id"):
    """Outputs of several transforms side by side, suffixed by tag; each works on its own copies of the columns."""
    out = df
    for tag, fn in transforms.items():
        names = [f"{c}_{tag}" for c in cols]
        out = fn(out.withColumns({n: F.col(c) for n, c in zip(names, cols)}), names)
    return out


# ------------------------------------------------------------------ relevance
def feature_relevance(df, cols, y_code="y_code"):
    """Q2 stand-in: softmax over |corr(feature, label code)|, all in one aggregation."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(y_code).cast("double")).alias(c) for c in cols]).first()
    r = {c: abs(float(row[c])) if row[c] is not None and math.isfinite(row[c]) else 0.0 for c in cols}
    mx = max(r.values()) if r else 0.0
    e = {c: math.exp(v - mx) for c, v in r.items()}
    tot = sum(e.values())
    recs = [(c, e[c] / tot) for c in cols]
    return df.sparkSession.createDataFrame(recs, "feature string, relevance double")


def select_by_relevance(rel: DataFrame, n: int) -> DataFrame:
    """Top-n features by relevance (ties by name); capped at the feature count."""
    from pyspark.sql import Window
    w = Window.orderBy(F.col("relevance").desc(), F.col("feature"))
    return rel.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
