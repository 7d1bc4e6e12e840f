"""Long contexts that are only voted on: no context row leaves the task that finds it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxtab.functions import softmax, spool
from ctxtab.operators import pipeline, predict, retrieve


def _brute(ids, valid, X, codes, t_ids, Xt, K):
    out = {}
    for t in np.unique(t_ids):
        near = sorted((-s, i) for r in np.nonzero(t_ids == t)[0] for s, i in zip(softmax.scores(Xt[r:r + 1], X, 0.5)[0], ids[valid]))
        for s, i in near[:K]:
            for c in codes[ids == i]:
                out.setdefault((t, c), []).append(-s)
    return {k: max(v) + np.log(np.exp(np.array(v) - max(v)).sum()) for k, v in out.items()}


@pytest.mark.parametrize("trial", range(12))
def test_voters(monkeypatch, trial):
    """Boxes, parts, files, ties, repeated ids on both sides and rows without a vector."""
    r = np.random.default_rng(trial)
    for where, name, value in ((softmax, "PART", 300), (softmax, "LEAF", 16), (softmax, "CELLS", 2000), (spool, "IN_MEMORY", 3000 * (trial % 2))):
        monkeypatch.setattr(where, name, value)
    d, n = 1 + trial % 10, 900
    ids = r.permutation(5 * n)[:n] if trial % 3 else r.integers(0, n, n)
    X = r.integers(-2, 3, (n, d)).astype(float) if trial % 2 else r.normal(size=(n, d))
    valid, codes = r.random(n) > 0.05, r.integers(0, 4, n)
    X[7] *= 30  # a box with one row far off
    Xt = r.integers(-3, 4, (25, d)).astype(float)
    t_ids = np.arange(25) if trial % 4 else r.integers(0, 18, 25)
    K = int(r.integers(1, valid.sum()))
    voters = softmax.Voters(Xt, K, 0.5, 5)
    for b in range(3):
        m = ids % 3 == b
        voters.add(ids[m], valid[m], X[valid & m], codes[m])
    got = {(a, c): x[c] for at, logit, voted in voters.logits(t_ids) for a, x, w in zip(at, logit, voted) for c in np.nonzero(w)[0]}
    want = _brute(ids, valid, X[valid], codes, t_ids, Xt, K)
    assert got.keys() == want.keys()
    for t in set(t_ids.tolist()):
        assert np.ptp([got[k] - want[k] for k in want if k[0] == t]) < 1e-9


def test_spool(monkeypatch):
    monkeypatch.setattr(spool, "IN_MEMORY", 100)
    x, s = np.arange(60.0).reshape(20, 3), spool.Spool()
    for part in np.array_split(x, 6):
        s.add(part)
    assert s.file is not None and not s.parts and (s.rows() == x).all() and s.n == 20


def _tables(spark, odd=False):
    test = [(i % 37, [float((i * 7 + j * 3) % 11 - 5) for j in range(3)]) for i in range(40)] + [(None, [1.0] * 3), (90, None)]
    train = []
    for i in range(1500):
        v = [float((i * 5 + j * 13 + i * j) % 97 - 48) / 13 for j in range(3)]
        train.append((i if i % 50 else 7, v if i % 29 else None, f"c{i % 4}" if i % 31 else None))  # ids, vectors and labels missing or repeated
    train.append((None, [2.0] * 3, "c1"))
    if odd:
        train.append((5000, [float("nan"), 0.0, 0.0], "c2"))
        test.append((91, [float("inf"), 1.0, 1.0]))
    return spark.createDataFrame(test, "row_id long, v array<double>"), spark.createDataFrame(train, "row_id long, v array<double>, y string")


@pytest.mark.parametrize("odd", [False, True])
def test_votes_are_those_of_the_table(spark, odd):
    test, train = _tables(spark, odd)
    rows = lambda ctx: {(r.test_id, r["class"]): r.p for r in predict.predict_classes(ctx, train, 0.7).collect()}
    want = rows(retrieve.top_k_context(test, train, "v", 700))
    got = rows(retrieve.top_k_context(test, train, "v", 700, votes=True))
    assert got.keys() == want.keys() and len(got) > 150
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9, nan_ok=True)


def test_only_votes_are_shuffled(spark):
    """the ensemble's long contexts are not joined to the labels."""
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
                                  (F.col("id") % 3).cast("int").alias("y_code"), F.sin("id").alias("a"), F.cos("id").alias("b"))
    probs = pipeline.table_probs(df, ["a", "b"], 800, [1, 2, 0], 0.9)
    assert "Join" not in probs._jdf.queryExecution().optimizedPlan().toString()
    assert probs.count() == 1200


def test_strips_are_copied_for_blocks_not_for_ranked_rows(spark, monkeypatch):
    """how many rows a task ranks at once says nothing on how often the train rows are shuffled."""
    monkeypatch.setattr(retrieve, "HELD", 3000)
    test, train = _tables(spark)
    ctx = retrieve.mass_context(test, train, "v", 0.5, 10, "max")
    assert ctx.rdd.getNumPartitions() == 1
    few = {(r.test_id, r["rank"]): r.train_id for r in ctx.collect()}
    monkeypatch.setattr(retrieve, "HELD", 1 << 22)
    assert {(r.test_id, r["rank"]): r.train_id for r in retrieve.mass_context(test, train, "v", 0.5, 10, "max").collect()} == few and len(few) > 300
