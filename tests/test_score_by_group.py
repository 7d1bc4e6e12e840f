"""Scoring by cluster (Q10, E12): the contexts are found once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ctxtab.operators import pipeline, retrieve


@pytest.mark.parametrize("classes", [None, [0, 1, 2]])
def test_contexts_are_not_found_again(spark, classes):
    d = spark.range(60).select(F.col("id").alias("row_id"), F.array(*[((F.col("id") * k) % 7).cast("double") for k in (1, 3, 5)]).alias("emb"), (F.col("id") % 3).alias("y"))
    test, train = d.where("row_id < 12"), d.where("row_id >= 12")
    ctx = retrieve.top_k_context(test, train, "emb", 6)
    assign = test.select(F.col("row_id").alias("test_id"), (F.col("row_id") % 2).cast("int").alias("cluster_id"))
    out = pipeline.score_by_group(test, train, assign, ctx, "emb", 4, 2, 0.9, classes)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # the scoring by cluster itself
    sums = out.groupBy("test_id").agg(F.sum("p").alias("s"), F.count("p").alias("n")).collect()
    assert len(sums) == 12 and all(abs(r.s - 1) < 1e-9 for r in sums)
    assert classes is None or all(r.n == 3 for r in sums)
