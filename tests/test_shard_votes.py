"""Sharded prediction (M6): votes summed where a test block meets the shards, as from the tables of contexts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ctxtab.operators import predict, retrieve


def _tables(spark):
    test = [(i % 37, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(40)]  # three ids stand twice
    test += [(None, [1.0] * 4), (90, None)]
    train = []
    for i in range(300):
        v = [float((i * 5 + j * 13 + i * j) % 17 - 8) / 3 for j in range(4)]
        train.append((i if i % 50 else 7, v if i % 29 else None, i % 4 if i % 31 else None, i % 6))  # ids, vectors and labels missing or repeated
    train.append((None, [2.0] * 4, 1, 2))
    return (spark.createDataFrame(test, "row_id long, emb array<float>"),
            spark.createDataFrame(train, "row_id long, emb array<float>, y int, shard int"))


def _by_tables(test, train, sizes, k):
    every = test.withColumn("shard", F.explode(F.array(*[F.lit(s) for s in range(6)])))
    ctx = retrieve.top_k_context(every, train, "emb", k, keys=["shard"])
    return predict.sharded_average(predict.predict_classes(ctx, train, 0.7, keys=["shard"]), sizes)


@pytest.mark.parametrize("k, long", [(5, False), (200, False), (5, True)])
def test_summed_votes_are_those_of_the_tables(spark, k, long, monkeypatch):
    test, train = _tables(spark)
    sizes = train.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    want = {(r.test_id, r["class"]): r.p for r in _by_tables(test, train, sizes, k).collect()}
    monkeypatch.setattr(retrieve, "SHARD_CELLS", 400)
    if long:
        monkeypatch.setattr(predict, "SHARD_ROWS", 50)  # shards 0 to 2 go through tables
    ctx = retrieve.top_k_context(test, train, "emb", k, shard="shard")
    got = {(r.test_id, r["class"]): r.p for r in predict.sharded_average(predict.predict_classes(ctx, train, 0.7), sizes).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)


def test_no_number_counts_as_in_the_tables(spark):
    test, train = _tables(spark)
    train = train.withColumn("emb", F.when(F.col("row_id") == 11, F.expr("array(CAST('NaN' AS float), 0f, 0f, 0f)")).otherwise(F.col("emb")))
    sizes = train.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    want = {(r.test_id, r["class"]): repr(r.p)[:9] for r in _by_tables(test, train, sizes, 5).collect()}
    ctx = retrieve.top_k_context(test, train, "emb", 5, shard="shard")
    got = {(r.test_id, r["class"]): repr(r.p)[:9] for r in predict.sharded_average(predict.predict_classes(ctx, train, 0.7), sizes).collect()}
    assert got.keys() == want.keys() and {k for k in got if got[k] == "nan"} == {k for k in want if want[k] == "nan"}
