"""Physical plans at scale: with automatic broadcasts off, no query joins whole tables pair by pair."""

from __future__ import annotations

import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as entry

QUERIES = entry.queries()


@pytest.mark.parametrize("name", ["q1_context_scores", "q4_top_k_context", "q10_score_by_group", "m2_predict_values", "m6_sharded_predict",
                                  "m7_align_classes", "v5_auc_binary", "v6_auc_ovo", "p4_stratified_shards", "e13_target_rank", "r3_quantile_uniform",
                                  "q3_only_sample", "e12_relabel_inverse", "s7_regression_predictions"])
def test_no_cartesian_join(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_prefix_sum_and_index(spark):
    from ctxtab.functions.ranking import global_index, prefix_sum
    df = spark.createDataFrame([(k * 37 % 101, k % 5) for k in range(101)], "v long, w long")
    idx = {r.v: r.idx for r in global_index(df, ["v"]).collect()}
    assert idx == {v: v for v in range(101)}
    weight = {k * 37 % 101: k % 5 for k in range(101)}
    got = {r.v: r["_before"] for r in prefix_sum(df, ["v"], "w").collect()}
    assert got == {v: sum(weight[u] for u in range(v)) for v in range(101)}


def test_divisions_by_nothing(spark):
    from ctxtab.operators import metrics
    probs = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0)], "test_id long, class int, p double")
    truth = spark.createDataFrame([(1, 0)], "test_id long, y int")
    assert metrics.log_loss(probs, truth).first()["logloss"] > 30
    flat = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0)], "test_id long, y double, pred double")
    assert metrics.r2(flat).first()["r2"] is None


def test_weights_that_underflow(spark):
    from ctxtab.operators import predict
    ctx = spark.createDataFrame([(1, 10, 0.0, 2000.0), (1, 11, -1.0, 2000.0)], "test_id long, train_id long, score double, lse double")
    train = spark.createDataFrame([(10, 0, 1.0), (11, 1, 3.0)], "row_id long, y int, t double")
    logits = {r["class"]: r.logit for r in predict.class_logits(ctx, train).collect()}
    assert logits == {0: -2000.0, 1: -2001.0}
    value = predict.predict_values(ctx, train, label_col="t").first().pred
    assert 1.0 < value < 2.0


def test_power_transform_bracket_and_reversion(spark):
    import numpy as np
    from ctxtab.operators import scale
    r = np.random.default_rng(1)
    x = 50 - np.exp(r.standard_normal(4000) * 0.02 + 3)                 # left-skewed: lambda far above two
    df = spark.createDataFrame([(k, "train", float(v), 7.0) for k, v in enumerate(x)], "row_id long, split string, x double, flat double")
    lam = scale.yeo_johnson_fit(df, ["x", "flat"])
    assert np.isnan(lam["flat"])

    def likelihood(a):
        t = ((x + 1) ** a - 1) / a
        return -len(x) / 2 * np.log(t.var()) + (a - 1) * np.log1p(x).sum()

    assert likelihood(lam["x"]) >= max(likelihood(lam["x"] + d) for d in (-0.05, 0.05)) - 1e-6
    out = scale.yeo_johnson(df, ["x", "flat"]).toPandas()
    assert abs(out["x"].var(ddof=0) - 1) < 1e-6 and (out["flat"] == 7.0).all()


def test_kernel_cdf_is_monotone(spark):
    from ctxtab.operators import scale
    df = spark.createDataFrame([(k, "train", float(k * k % 97)) for k in range(500)] + [(999, "test", None), (998, "test", 1e9)], "row_id long, split string, x double")
    rows = scale.kdi_uniform(df.withColumnRenamed("x", "v").selectExpr("*", "v AS x"), ["x"]).orderBy("v").collect()
    known = [(r.v, r.x) for r in rows if r.v is not None]
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(known, known[1:])) and 0 <= known[0][1] and known[-1][1] <= 1
    assert [r.x for r in rows if r.v is None] == [None]


def test_svd_directions_are_orthogonal(spark):
    import numpy as np
    from ctxtab.operators import scale
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(k, "train", *map(float, v)) for k, v in enumerate(r.standard_normal((300, 4)) @ r.standard_normal((4, 4)))],
                               "row_id long, split string, a double, b double, c double, d double")
    out = scale.append_svd(df, list("abcd")).toPandas()
    p = out[[c for c in out.columns if c.startswith("svd_")]].to_numpy()
    g = p.T @ p
    assert p.shape[1] == 2 and abs(g[0, 1]) < 1e-6 * g[0, 0] and g[0, 0] >= g[1, 1]


def test_inverse_normal_against_the_standard_library(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from ctxtab.functions.exprs import inv_norm_cdf
    ps = [k / 2000 for k in range(1, 2000)] + [10.0 ** -k for k in range(4, 60)] + [1 - 10.0 ** -k for k in range(4, 16)]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", inv_norm_cdf("p").alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) <= 1e-9 * max(1, abs(r.z)) for r in rows)
    ends = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(inv_norm_cdf("p").alias("z"), F.lit(1)).collect()
    assert [r.z for r in ends] == [float("-inf"), float("inf"), None]


def test_relabelled_scores_come_back_in_all_classes(spark):
    from ctxtab.operators import encode
    ctx = spark.createDataFrame([(1, 7), (1, 3), (1, 7), (2, 9)], "g long, ctx_y int")
    known = encode.local_relabel(ctx, "g")
    scores = spark.createDataFrame([(1, 10, 0, -1.0), (1, 10, 1, -2.0), (1, 11, 1, 0.0), (2, 12, 0, 0.5)], "g long, test_id long, local_y int, score double")
    got = {(r.test_id, r["class"]): r.score for r in encode.local_relabel_inverse(scores, known, [3, 7, 9], "g", rows=["test_id"]).collect()}
    none = float("-inf")
    assert got == {(10, 3): -1.0, (10, 7): -2.0, (10, 9): none, (11, 3): none, (11, 7): 0.0, (11, 9): none, (12, 3): none, (12, 7): none, (12, 9): 0.5}


def test_ensemble_average_does_not_count_known_members(spark):
    from ctxtab.operators import predict
    members = spark.createDataFrame([(0, 1, 0, 0.6), (0, 1, 1, 0.4), (1, 1, 0, 1.0)], "member int, test_id long, class int, p double")
    for n in (None, 2):
        assert {r["class"]: round(r.p, 9) for r in predict.ensemble_average(members, n_members=n).collect()} == {0: 0.8, 1: 0.2}


def test_regression_table(spark):
    from ctxtab.sources import io
    preds = spark.createDataFrame([(1, 0.5), (3, 9.0)], "test_id long, pred double")
    truth = spark.createDataFrame([(1, 10.0), (2, 20.0)], "test_id long, y double")
    assert {tuple(r) for r in io.regression_table(preds, truth, 10.0, 4.0).collect()} == {(1, 10.0, 12.0), (2, 20.0, None)}
