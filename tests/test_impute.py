"""Imputed cells: means and modes come from one pass over the contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxtab.operators import predict, retrieve


def test_contexts_are_scored_once(spark):
    rows = [(i, float(i % 7), float(i % 3), "test" if i % 5 == 0 else "train") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, split string").withColumn("v", F.array("a", "b"))
    test, train = df.where("split = 'test'"), df.where("split = 'train'")
    ctx = retrieve.top_k_context(test, train, "v", 5)
    out = predict.impute_cells(ctx, train, ["a", "b"], categorical=["b"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # F3, F4
    want = {}
    cells = {r["row_id"]: r for r in train.collect()}
    for r in ctx.collect():
        for c in "ab":
            votes = want.setdefault((r["test_id"], c), {})
            votes[cells[r["train_id"]][c]] = votes.get(cells[r["train_id"]][c], 0.0) + r["weight"]
    for r in out.collect():
        votes = want.pop((r["test_id"], r["feature"]))
        if r["feature"] == "a":
            assert abs(r["imputed"] - sum(v * w for v, w in votes.items()) / sum(votes.values())) < 1e-9
        else:
            assert abs(votes[r["imputed"]] - max(votes.values())) < 1e-12
    assert not want
