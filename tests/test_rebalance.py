"""The rebalancing members: fit planner, routes, tags and the executor; the power fit."""

from __future__ import annotations

import math

import numpy as np
import pytest
from ctxtab.operators import power, rebalance
from ctxtab.operators.meta import PipelineSpec
from ctxtab.operators.pipeline import rebalanced_ensemble
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(2)
    rows = [(i, "test" if i % 5 == 0 else "train", i % 3, float(r.normal() + i % 3), float(r.lognormal()), float(i % 4), 7.0, None if i % 9 == 0 else float(r.normal())) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, split string, y_code int, a double, b double, c double, flat double, gap double").cache()


def _rb(tags, original=False, discrete=False, svd=None, **more):
    return {"RebalanceFeatureDistribution": {"worker_tags": tags, "original_flag": original, "discrete_flag": discrete, "svd_tag": svd}, **more}


FEATURES = ["a", "b", "c", "flat", "gap"]


def test_passes_follow_levels_not_members(table):
    """Twelve members need no more aggregations than the longest one; equal requests are asked once."""
    members = [_rb(["logNormal", "robust"]), _rb(["robust"]), {}, _rb(["logNormal"], PolynomialInteractionGenerator={"max_interaction_features": 3})]
    one = [rebalance.fit_together(table, {0: rebalance._first_part(FEATURES, ["c"], m, 0)})[1] for m in members]
    _, all_ = rebalance.fit_together(table, {i: rebalance._first_part(FEATURES, ["c"], m, 0) for i, m in enumerate(members * 3)})
    assert all_ == max(one) == 5  # interactions, validity, and fill, shift, fill


def test_routes(table):
    shapes = [(_rb([None]), 4), (_rb([None], original=True), 4 + 3), (_rb([None], original=True, discrete=True), 4 + 4), (_rb([None], discrete=True), 4),
              (_rb(["robust", None]), 1 + 3 + 3), (_rb(["norm_and_kdi"]), 1 + 3 + 3), (_rb([None], svd="svd"), 4 + 2), ({}, 4),
              (_rb([None], FingerprintFeatureEncoder=True), 5), (_rb([None], CategoricalFeatureEncoder={"encoding_strategy": "onehot"}), 3 + 4),
              (_rb([None], PolynomialInteractionGenerator={"max_interaction_features": 2}), 4 + 2)]
    for (member, width), (out, order) in zip(shapes, rebalance.member_tables(table, FEATURES, ["c"], [m for m, _ in shapes])):
        assert len(order) == width == len(set(order)), member
        assert out.count() == 200 and set(order) <= set(out.columns)
    with pytest.raises(ValueError):
        rebalance.member_tables(table, ["flat"], [], [{}])


def test_every_tag_runs_and_svd_is_orthogonal(table):
    tags = ["quantile_uniform_5", "quantile_norm_10", "power", "logNormal", "robust", "kdi_uni", "kdi_norm_alpha_0.3", "norm_and_kdi", "no_such_tag"]
    member = _rb(tags, svd="svd", CategoricalFeatureEncoder={"encoding_strategy": "ordinal"}, FingerprintFeatureEncoder=True, FeatureShuffler={"mode": "shuffle"})
    (out, order), = rebalance.member_tables(table, FEATURES, ["c"], [member])
    rows = out.select(*order).toPandas()
    assert len(rows) == 200 and len([c for c in order if c.startswith("svd_")]) == 2 and rows["fingerprint"].between(0, 1).all()
    assert np.isfinite(rows[[c for c in order if c.startswith("svd_")]].to_numpy(float)).all()


def test_rebalanced_ensemble_gives_probabilities(table):
    spec = PipelineSpec.load([_rb(["power", "quantile_norm_5"], retrieval_config={"retrieval_len": "dynamic", "dynamic_ratio": 0.3}),
                              _rb(["robust"], original=True, retrieval_config={"retrieval_len": 0.2})], seed=3)
    probs = rebalanced_ensemble(table, FEATURES, ["c"], spec)
    total = probs.groupBy("test_id").agg(F.sum("p").alias("s"), F.max_by("class", "p").alias("best")).collect()
    assert len(total) == 40 and all(abs(r.s - 1) < 1e-9 for r in total)
    assert np.mean([r.best == r.test_id % 3 for r in total]) > 0.5


def test_power_fit_is_the_maximum(spark):
    r = np.random.default_rng(1)
    x = np.stack([r.normal(size=3000) ** 3, r.lognormal(size=3000), -3 * r.lognormal(size=3000), np.full(3000, 2.0), r.normal(size=3000) * 1e-3 + 40], 1)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x] + [(None, math.inf, math.nan, 2.0, None)], "a double, b double, c double, d double, e double").repartition(5)
    got = power.fit(df, list("abcde"))

    def value(v, lam):
        t = power._values(v, np.log1p(np.abs(v)), lam)
        return -len(v) / 2 * math.log(t.var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()

    for i, c in enumerate("abc"):
        low, high = got[c] - 1, got[c] + 1
        while high - low > 1e-7:
            p, q = low + (high - low) * 0.382, low + (high - low) * 0.618
            low, high = (p, high) if value(x[:, i], p) < value(x[:, i], q) else (low, q)
        assert abs(got[c] - (low + high) / 2) < 1e-6
    assert math.isnan(got["d"]) and power.fit(df.limit(0), ["a"])["a"] != power.fit(df.limit(0), ["a"])["a"]
