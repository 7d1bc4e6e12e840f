"""Property tests on small hand-made fixtures: CSV sources, catalog, overlap,
per-dataset status and the sweep (checked against brute force)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from ctxtab.operators import retrieve, suite
from ctxtab.sources import io


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _scratch():
    return tempfile.mkdtemp(prefix="ctxtab-test-", dir="/tmp")


def test_infer_target():
    assert io.infer_target(["a", "b", "label", "y"]) == "label"
    assert io.infer_target(["a", "Class"]) == "Class"
    assert io.infer_target(["a", "b"]) == "b"


def test_read_pair_csv(spark):
    d = _scratch()
    _write(f"{d}/iris/iris_train.csv", "f1,f2,target\n1,2,a\n3,4,b\n5,6,\n7,8,a\n")
    _write(f"{d}/iris/iris_test.csv", "f1,f2,target\n9,10,b\n11,12,\n")
    df = io.read_pair(spark, f"{d}/iris/iris_train.csv", f"{d}/iris/iris_test.csv")
    rows = sorted((r.split, r.f1, r.y) for r in df.collect())
    assert rows == [("test", 9, "b"), ("train", 1, "a"), ("train", 3, "b"), ("train", 7, "a")]
    assert df.select("row_id").distinct().count() == 4


def test_read_single_requires_two_rows(spark):
    d = _scratch()
    _write(f"{d}/one.csv", "x,label\n1,a\n2,\n")
    try:
        io.read_single(spark, f"{d}/one.csv")
    except ValueError as e:
        assert "fewer than two rows" in str(e)
    else:
        raise AssertionError("expected ValueError")


def test_dataset_catalog(spark):
    d = _scratch()
    _write(f"{d}/b/OpenML-ID-31/credit_train.csv", "x,y\n1,0\n")
    _write(f"{d}/b/OpenML-ID-31/credit_test.csv", "x,y\n1,0\n")
    _write(f"{d}/b/OpenML-ID-31/raw.csv", "x,y\n1,0\n")
    _write(f"{d}/b/wine/wine_train.csv", "x,y\n1,0\n")
    _write(f"{d}/b/solo/solo.csv", "x,y\n1,0\n")
    cat = {r.dataset_name: r for r in io.dataset_catalog(spark, f"{d}/b", "bench").collect()}
    assert set(cat) == {"credit", "raw", "wine", "solo"}
    assert cat["credit"].dataset_id == "OpenML-ID-31" and cat["credit"].test_csv.endswith("credit_test.csv")
    assert cat["wine"].test_csv is None and cat["wine"].train_csv.endswith("wine_train.csv")
    assert cat["solo"].single_csv.endswith("solo.csv") and cat["solo"].dataset_id == "solo"
    assert cat["raw"].dataset_id == "OpenML-ID-31"


def test_skip_name_normalisation(spark):
    raw = spark.createDataFrame([("C:\\data\\Adult_TRAIN.csv, wine.CSV\n  /x/y/Credit_test.csv ,,",)], "value string")
    got = sorted(r.skip_name for r in suite.skip_tokens(raw).collect())
    assert got == ["adult", "credit", "wine"]


def test_context_overlap_bruteforce(spark):
    ctx = spark.createDataFrame(
        [(t, r) for t, rs in {1: [10, 11, 12], 2: [11, 12], 3: [12, 13], 4: [20]}.items() for r in rs],
        "test_id long, train_id long")
    got = {(r.test_a, r.test_b): r.n_shared for r in retrieve.context_overlap(ctx, salt=3, diagonal=True).collect()}
    sets = {1: {10, 11, 12}, 2: {11, 12}, 3: {12, 13}, 4: {20}}
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a <= b and sets[a] & sets[b]}
    assert got == want


def test_run_per_dataset_captures_failures(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "ds long, v double")

    def fn(pdf):
        if len(pdf) < 2:
            raise ValueError("tiny")
        return {"m": pdf["v"].mean()}

    rows = {r.ds: r for r in suite.run_per_dataset(df, ["ds"], fn, ["m"]).collect()}
    assert rows[1].status == "ok" and rows[1].m == 1.5
    assert rows[2].status == "fail" and rows[2].error == "ValueError: tiny" and rows[2].m is None


def test_sweep_contexts_are_prefixes(spark):
    import math
    rows = []
    for t in range(3):
        ws = [0.4, 0.3, 0.2, 0.1]
        for i, w in enumerate(ws):
            rows.append((t, 100 + i, i + 1, math.log(w), w))
    ctx = spark.createDataFrame(rows, "test_id long, train_id long, rank int, score double, weight double")
    params = [{"param_id": 0, "k": 2}, {"param_id": 1, "k": 4, "threshold": 0.75}]
    got = suite.sweep_contexts(ctx, params).groupBy("param_id", "test_id").agg(F.max("rank").alias("m")).collect()
    # k=2 keeps ranks 1-2; threshold 0.75 keeps rows whose preceding mass < 0.75: ranks 1-3
    assert {(r.param_id, r.m) for r in got} == {(0, 2), (1, 3)}


def test_metadata_helpers(spark):
    from ctxtab.operators import meta
    spec = meta.PipelineSpec.load([{"a": 1}, {"a": 2}])
    assert spec.with_overrides(softmax_temperature=0.5, seed=3).seed == 3
    try:
        meta.PipelineSpec.load([])
    except ValueError:
        pass
    else:
        raise AssertionError("empty spec accepted")
    order, cat = meta.shuffle_features(["a", "b", "c", "d"], ["b"], mode="rotate", offset=1)
    assert order == ["d", "a", "b", "c"] and cat == ["b"]
    order2, _ = meta.shuffle_features(["a", "b", "c", "d"], [], seed=7)
    assert sorted(order2) == ["a", "b", "c", "d"]
    assert meta.resolve_tag("quantile") == "identity" and meta.resolve_tag("kdi_uni_alpha_0.3") == "kdi_uni_alpha_0.3"
    tr = spark.createDataFrame([(1.0, "a")], "x double, y string")
    te = spark.createDataFrame([(1.0,)], "z double")
    try:
        meta.check_features(tr, te, ["x"])
    except ValueError:
        pass
    else:
        raise AssertionError("missing test feature accepted")
