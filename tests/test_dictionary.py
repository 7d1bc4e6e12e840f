"""Small dictionaries are broadcast: rows are not dealt by a column of few values."""

from __future__ import annotations

from ctxtab.operators import encode


def test_rows_stay_where_they_are(spark, monkeypatch):
    rows = [(i, ["a", "b", None, ""][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, c string")
    want = {i: [0, 1, -1, -1][i % 4] for i in range(40)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bound, dealt in ((100_000, False), (1, True)):
            monkeypatch.setattr(encode, "BROADCAST_VALUES", bound)
            out = encode.codes_full(df, ["c"])
            assert ("hashpartitioning(_key" in out._jdf.queryExecution().executedPlan().toString()) == dealt
            assert {r["row_id"]: r["c"] for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
