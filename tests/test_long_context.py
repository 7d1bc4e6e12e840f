"""Long contexts: ranked in one task per test block, no candidate lists between tasks."""

from __future__ import annotations

import numpy as np
import pytest

from ctxtab.functions.softmax import BestOfStrips
from ctxtab.operators import retrieve

R = np.random.default_rng(3)


@pytest.mark.parametrize("K", [0, 1, 40, 700, 1000])
@pytest.mark.parametrize("ties", [False, True])
def test_best_of_strips(K, ties):
    draw = (lambda n: R.integers(-2, 3, (n, 3)).astype(float)) if ties else (lambda n: R.normal(size=(n, 3)))
    Xt, Xr, ids = draw(20), draw(1000), R.permutation(5000)[:1000]
    state = BestOfStrips(Xt, K, 0.5)
    for rows in np.array_split(R.permutation(1000), 7):
        state.add(ids[rows], Xr[rows])
    S = Xt @ Xr.T * 0.5
    for i, (t, got, s, lse, n) in enumerate(state.ranked(np.arange(20), None)):
        order = np.lexsort((ids, -np.round(S[i], 12)))[:K]
        assert (t, n) == (i, 1000) and got.tolist() == ids[order].tolist()
        assert np.allclose(s, S[i][order]) and np.isclose(lse, np.log(np.exp(S[i]).sum()))


def _tables(spark, n=90):
    X = R.normal(size=(n, 4)).round(3)
    rows = [(i, X[i].tolist(), "test" if i % 9 == 0 else "train") for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, v array<double>, split string")
    return X, df.where("split = 'test'"), df.where("split = 'train'")


def test_mass_context_in_one_pass(spark, monkeypatch):
    """no rounds, so nothing is written between them; blocks of a few rows give the same."""
    monkeypatch.setattr("ctxtab.session.cut_lineage", lambda df: pytest.fail("a round was written"))
    monkeypatch.setattr(retrieve, "HELD", 200)
    monkeypatch.setattr(retrieve, "ROWS_OUT", 16)
    X, test, train = _tables(spark)
    got = {}
    for r in retrieve.mass_context(test, train, "v", 0.6, 10, "max").collect():
        got.setdefault(r["test_id"], []).append((r["rank"], r["train_id"], r["ctx_len"]))
    known = np.array([i for i in range(90) if i % 9])
    assert set(got) == set(range(0, 90, 9))
    for t, rows in got.items():
        s = X[known] @ X[t] / 2
        order = np.argsort(-s, kind="stable")
        w = np.exp(s[order] - np.log(np.exp(s).sum()))
        length = max(int(np.argmax(np.cumsum(w) >= 0.6)) + 1, 10)
        assert sorted(rows) == [(k + 1, known[order[k]], length) for k in range(length)]


def test_long_top_k_shuffles_no_candidates(spark):
    """more candidates than FEW come ranked out of the scoring task."""
    _, test, train = _tables(spark)
    ctx = retrieve.top_k_context(test, train, "v", 600)
    plan = ctx._jdf.queryExecution().toString()
    assert "Window" not in plan and "Generate explode(arrays_zip" not in plan
    few = {(r["test_id"], r["rank"]): (r["train_id"], round(r["weight"], 9)) for r in retrieve.top_k_context(test, train, "v", 100).collect()}
    assert {(r["test_id"], r["rank"]): (r["train_id"], round(r["weight"], 9)) for r in ctx.collect()} == few
