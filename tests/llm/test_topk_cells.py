"""Exact top-k: cells of narrow blocks, dealt one by one and searched for a few queries at a time."""

from __future__ import annotations

import re

import numpy as np
import pytest

from ctxtab.llm import topk_search


@pytest.mark.parametrize("size, width, kind", [(1.0, 2, np.float32), (3e2, 4, np.float64), (3e5, 4, np.int64)])
def test_cells_are_small_and_exact(spark, monkeypatch, size, width, kind):
    monkeypatch.setattr(topk_search, "BLOCK", 60)
    monkeypatch.setattr(topk_search, "QUERIES", 4)
    monkeypatch.setattr(topk_search, "TILE", 150)  # two or three queries at once
    x = (size * np.random.default_rng(12).standard_normal((600, 6))).astype(np.float32)
    x[200:250] = x[200]
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    top = topk_search.top_k(vecs.where("vec_id % 50 = 0"), vecs)
    ints = np.floor(256 * x.astype(float))
    packed = topk_search._narrow(ints.ravel())
    assert packed.itemsize == width and (packed == ints.ravel()).all()
    assert topk_search._exact(ints, ints)[0].dtype == kind
    got = {}
    for r in top.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    exact = [[int(a) for a in v] for v in ints]
    for q in range(0, 600, 50):
        score = [sum(a * b for a, b in zip(exact[q], v)) for v in exact]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [got[q][r] for r in range(1, 6)] == [(i, score[i]) for i in want]
    dealt = re.findall(r"hashpartitioning\(dims#\d+L?, qb#\d+L?, cb#\d+L?, (\d+)\)", top._jdf.queryExecution().executedPlan().toString())
    assert dealt and set(dealt) == {"30"}  # a partition for each of 3 x 10 cells


def test_narrow_holds_every_integer():
    for top, kind in ((2**15 - 1, np.int16), (2**15, np.int32), (2**31 - 1, np.int32), (2**31, np.float64), (2**60, np.float64)):
        x = np.array([1.0, -float(top), float(top)])
        assert topk_search._narrow(x).dtype == kind and (topk_search._narrow(x) == x).all()
