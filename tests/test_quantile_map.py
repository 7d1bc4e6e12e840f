"""Quantile maps found in the sorted values (R3, R4): right across the parts' edges, and no shuffle of rows on few values."""

from __future__ import annotations

import numpy as np
import pytest

from ctxtab.operators import scale


def by_hand(train, values, variant):
    """Images by the definition, one value at a time."""
    s = np.sort(np.array(train, dtype=float))
    n = len(s)
    g = scale.n_quantiles_for(n, variant) - 1
    if g == 0:
        return {v: 0.0 for v in values}
    at = [divmod(k * (n - 1), g) for k in range(g + 1)]
    knots = np.array([s[i] if not r else s[i] + r / g * (s[i + 1] - s[i]) for i, r in at])
    out = {}
    for v in values:
        equal = np.nonzero(knots == v)[0]
        if len(equal):
            out[v] = (equal[0] + equal[-1]) / g / 2
        elif v < knots[0] or v > knots[-1]:
            out[v] = float(v > knots[-1])
        else:
            j = np.searchsorted(knots, v)
            out[v] = (j - 1) / g + (v - knots[j - 1]) / (knots[j] - knots[j - 1]) / g
    return out


@pytest.mark.parametrize("variant", ["10", "5"])
def test_images_across_parts(spark, variant, monkeypatch):
    monkeypatch.setattr(scale, "RUN_ROWS", 200)  # several runs in a part
    rng = np.random.default_rng(4)
    cols = {"a": np.round(rng.normal(size=3000), 4), "b": rng.integers(0, 7, 3000).astype(float), "c": np.round(rng.exponential(size=3000), 2)}
    split = np.where(rng.random(3000) < 0.6, "train", "test")
    split[cols["a"] > 1.5] = "test"  # a long run of values without train rows
    rows = [(i, str(split[i]), float(cols["a"][i]), float(cols["b"][i]), float(cols["c"][i]) if i % 10 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, split string, a double, b double, c double")
    got = {r.row_id: r for r in scale.quantile_uniform(df, ["a", "b", "c"], variant).collect()}
    for j, c in enumerate("abc"):
        held = [r for r in rows if r[2 + j] is not None]
        want = by_hand([r[2 + j] for r in held if r[1] == "train"], {r[2 + j] for r in held}, variant)
        assert all(got[r[0]][c] == pytest.approx(want[r[2 + j]], abs=1e-12) for r in held)
    assert all(got[i]["c"] is None for i in range(0, 3000, 10))


def test_small_and_empty_columns(spark):
    df = spark.createDataFrame([(1, "train", 2.0, None, 1.0), (2, "test", 3.0, 5.0, 2.0), (3, "test", None, None, 3.0), (4, "train", None, None, 3.0)],
                               "row_id long, split string, a double, b double, c double")
    got = {r.row_id: (r.a, r.b, r.c) for r in scale.quantile_uniform(df, ["a", "b", "c"]).collect()}
    assert got == {1: (0.0, None, 0.0), 2: (0.0, None, 0.5), 3: (None, None, 1.0), 4: (None, None, 1.0)}


def test_rows_are_not_dealt_by_few_values(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(5000).selectExpr("id AS row_id", "if(id % 5 = 0, 'test', 'train') AS split", "CAST(id % 9 AS double) AS a", "CAST(id % 11 AS double) AS b")
        plan = scale.quantile_uniform(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
