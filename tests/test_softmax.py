"""Best columns and exp-sums against all pairs, and the size of what a cell hands on."""

from __future__ import annotations

import time

import numpy as np
import pytest

from ctxtab.functions import softmax

R = np.random.default_rng(5)
SHAPES = {
    "normal": lambda n: R.normal(size=(n, 2)),
    "few values, many ties": lambda n: np.c_[R.integers(1, 9, n) - 4.0, R.integers(1, 6, n) - 3.0],
    "three wide": lambda n: np.c_[R.uniform(-1000, 9000, n), R.integers(0, 25, n), R.integers(0, 5, n)],
    "four in the unit box": lambda n: R.uniform(0, 1, (n, 4)),
    "all the same": lambda n: np.ones((n, 3)),
    "zeros asked": lambda n: np.where(R.random((n, 2)) < 0.4, 0.0, R.integers(1, 6, (n, 2)) - 3.0),
    "many dimensions": lambda n: R.normal(size=(n, 16)),
}


@pytest.mark.parametrize("shape", list(SHAPES))
@pytest.mark.parametrize("K", [0, 1, 7, 700])
def test_same_as_all_pairs(shape, K):
    Xt, Xr = SHAPES[shape](300), SHAPES[shape](3000)
    scale = Xt.shape[1] ** -0.5
    S = softmax.scores(Xt, Xr, scale)
    top = S.max(axis=1)
    lse = np.log(np.exp(S - top[:, None]).sum(axis=1)) + top
    want = np.sort(np.argsort(-S, axis=1, kind="stable")[:, :K], axis=1)
    seen = np.zeros(300, dtype=int)
    for rows, m, z, cols, best in softmax.strip_scores(Xt, Xr, K, scale):
        np.add.at(seen, rows, 1)
        assert np.allclose(m + np.log(z), lse[rows], rtol=1e-13, atol=1e-12)
        assert (np.sort(cols, axis=1) == want[rows]).all()
        assert np.allclose(best, np.take_along_axis(S[rows], cols, axis=1), rtol=1e-13, atol=1e-13)
    assert (seen == 1).all()


def test_few_dimensions_need_not_every_pair():
    """1.3e8 pairs with ties everywhere; one exponential for each takes a second and more, ordering ties tens of seconds."""
    Xt, Xr = SHAPES["few values, many ties"](4096), SHAPES["few values, many ties"](32_768)
    start = time.process_time()
    for _ in softmax.strip_scores(Xt, Xr, 10, 0.7):
        pass
    assert time.process_time() - start < 1


def test_output_of_many_cells_is_handed_on_in_parts():
    import pyarrow as pa

    from ctxtab.operators import retrieve
    pack = lambda X: pa.array([[{"id": i, "v": list(map(float, v))} for i, v in enumerate(X)]] * 12)
    batch = pa.RecordBatch.from_arrays([pack(R.normal(size=(400, 2))), pack(R.normal(size=(1200, 2)))], names=["_t", "_r"])
    out = list(retrieve._kernel_factory([], 1000, 1.0, [])([batch]))
    assert sum(b.num_rows for b in out) == 12 * 400
    assert max(b.nbytes for b in out) < 12 * 400 * 1000 * 16 / 4


@pytest.mark.parametrize("values", ["distinct", "copies"])
def test_all_pairs_are_scored_in_small_tiles(values):
    """A strip of 8,000 rows: tiles of 16 MB, held three times and more, took 50 MB and more of a Python worker."""
    import tracemalloc
    Xt, Xr = R.normal(size=(600, 16)), R.normal(size=(8000, 16))
    if values == "copies":
        Xr = Xr[np.arange(8000) % 400]
    tracemalloc.start()
    try:
        for _ in softmax.strip_scores(Xt, Xr, 15, 0.25):
            pass
        assert tracemalloc.get_traced_memory()[1] < 24e6
    finally:
        tracemalloc.stop()


def test_few_vectors_make_many_cells(spark, monkeypatch):
    """800 test rows met 300 train rows in one cell, so one worker did all of the work."""
    from ctxtab.operators import retrieve
    side = lambda n: spark.createDataFrame([(i, [float(x) for x in R.normal(size=8)]) for i in range(n)], "row_id long, v array<double>")
    test, train = side(800), side(300)
    found = [sorted((r["test_id"], round(r["_m"], 9), round(r["_z"], 9), r["_cid"])
                    for r in retrieve.block_scores(test, train, "v", 5, block_rows=rows).collect()) for rows in (None, 8192)]
    assert len(found[0]) == 800 and found[0] == found[1]

    def factory(*_):
        def rows_of_cells(batches):
            import pyarrow as pa
            for batch in batches:
                n = pa.array([len(x) for x in batch.column("_t")], pa.int64())
                none = [pa.nulls(len(n), t) for t in (pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([n, *none], names=["test_id", "_m", "_z", "_n", "_cid", "_cs"])
        return rows_of_cells

    monkeypatch.setattr(retrieve, "_kernel_factory", factory)
    cells = [r["test_id"] for r in retrieve.block_scores(test, train, "v", 5).collect()]
    assert len(cells) == 4 and sum(cells) == 800
