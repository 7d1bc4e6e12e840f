"""Queries for dataset sources and sinks (S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxtab.functions.exprs import r6
from ctxtab.plans.q_clean import SUITE_SPLIT_SQL, cust_suite_split
from ctxtab.plans.q_predict import PRT_Z_SQL, prt_context
from ctxtab.plans.q_retrieve import PROBS_SQL, vec_probs
from ctxtab.plans.registry import register
from ctxtab.sources import io, tables
from ctxtab.sources.tables import _split_sql


@register("s1_read_pair", f"""
SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS y, {_split_sql('label', 'vec_id')} AS split
FROM embeddings WHERE label IS NOT NULL""")
def s1_read_pair(spark, sf_dir):
    """Train file only (no test file): target inferred (``label``), then split by class."""
    d = io.read_pair(spark, f"{sf_dir}/embeddings.parquet", fmt="parquet", id_col="vec_id")
    return d.select("row_id", "y", "split")


@register("s2_read_single", f"""
SELECT doc_id AS row_id, quality, CAST(toxic AS VARCHAR) AS y, {_split_sql('toxic', 'doc_id')} AS split
FROM labels WHERE toxic IS NOT NULL""")
def s2_read_single(spark, sf_dir):
    """No candidate name in ``labels``: the last column (``toxic``) is the target."""
    d = io.read_single(spark, f"{sf_dir}/labels.parquet", fmt="parquet", id_col="doc_id")
    return d.select("row_id", "quality", "y", "split")


S3_SQL = "\nUNION ALL ".join(f"SELECT 'driver' AS benchmark, '{t}' AS dataset_id, '{t}' AS dataset_name, count(*) AS n_rows FROM {t}" for t in tables.TABLES)


@register("s3_dataset_catalog", S3_SQL)
def s3_dataset_catalog(spark, sf_dir):
    """Discovery over the driver folder (every table file is a single-file dataset) with the rows of each."""
    found = io.dataset_catalog(spark, sf_dir, "driver", ext="parquet")
    return io.catalog_rows(spark, found, fmt="parquet").select("benchmark", "dataset_id", "dataset_name", "n_rows")


def _doc_target(spark, sf_dir):
    d = tables.load(spark, sf_dir, "documents").select("doc_id")
    lab = tables.load(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("row_id"),
                                                 F.col("quality").cast("string").alias("y"))


@register("s5_drop_missing_target", """
SELECT d.doc_id AS row_id, CAST(l.quality AS VARCHAR) AS y
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND length(CAST(l.quality AS VARCHAR)) > 0""")
def s5_drop_missing_target(spark, sf_dir):
    return io.drop_missing_target(_doc_target(spark, sf_dir))


@register("s6_normalize_label", """
SELECT d.doc_id AS row_id, coalesce(CAST(l.quality AS VARCHAR), '__MISSING_LABEL__') AS y
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def s6_normalize_label(spark, sf_dir):
    return io.normalize_label(_doc_target(spark, sf_dir))


SHOWN = list(range(10))  # classes of the driver's table, for the columns of the SQL twin


@register("s7_write_predictions", "WITH " + PROBS_SQL + """
SELECT t.test_id, t.y AS label, """ + ", ".join(
    f"round(coalesce(max(CASE WHEN p.class = {c} THEN p.p END), 0), 6) AS pred_{c}" for c in SHOWN)
    + """
FROM truth t LEFT JOIN probs p ON t.test_id = p.test_id GROUP BY t.test_id, t.y""")
def s7_write_predictions(spark, sf_dir):
    test, probs = vec_probs(spark, sf_dir)
    truth = test.select(F.col("row_id").alias("test_id"), "y")
    classes = sorted(r[0] for r in tables.vec(spark, sf_dir).where("split = 'train'").select("y").distinct().collect())  # the fitted list
    wide = io.prediction_table(probs, truth, classes)
    return wide.select("test_id", "label", *[r6(f"pred_{c}", f"pred_{c}") for c in classes])


@register("s7_regression_predictions", "WITH " + PRT_Z_SQL + """
SELECT z.row_id AS test_id, round(z.y, 6) AS label, round(preds.pred, 6) AS pred
FROM pz z LEFT JOIN preds ON preds.test_id = z.row_id WHERE z.split = 'test'""")
def s7_regression_predictions(spark, sf_dir):
    """Predictions of the standardised target, back in its units, written as CSV and read again."""
    import uuid

    from ctxtab.operators.predict import predict_values
    from ctxtab.operators.scale import TargetScaler
    from ctxtab.session import ensure_checkpoint_dir
    d, test, _, ctx = prt_context(spark, sf_dir)
    target = TargetScaler().fit(d)
    preds = predict_values(ctx, target.transform(d), label_col="y_std")
    out = io.regression_table(preds, test.select(F.col("row_id").alias("test_id"), "y"), target.mean, target.std)
    path = f"{ensure_checkpoint_dir(spark)}/predictions-{uuid.uuid4().hex}"
    io.write_predictions(out, path)
    back = spark.read.option("header", "true").schema("test_id long, label double, pred double").csv(path)
    return back.select("test_id", r6("label", "label"), r6("pred", "pred"))


@register("s8_collect_results", f"""
SELECT CAST(c_nationkey AS BIGINT) AS dataset_id, 'ok' AS status,
       count(CASE WHEN {SUITE_SPLIT_SQL} = 'train' THEN 1 END) AS n_train,
       count(CASE WHEN {SUITE_SPLIT_SQL} = 'test' THEN 1 END) AS n_test,
       CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS benchmark
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_nationkey""")
def s8_collect_results(spark, sf_dir):
    """Per-worker result frames (one per benchmark, one empty): concatenated, appended in two runs and read back."""
    import uuid

    from ctxtab.session import ensure_checkpoint_dir
    s = cust_suite_split(spark, sf_dir).withColumn(
        "benchmark", F.when(F.col("dataset_id") % 2 == 0, "even").otherwise("odd"))
    parts = []
    for b in ["even", "odd", "none"]:
        parts.append(s.filter(F.col("benchmark") == b).groupBy("dataset_id", "benchmark").agg(
            F.count_if(F.col("split") == "train").alias("n_train"),
            F.count_if(F.col("split") == "test").alias("n_test"))
            .withColumn("status", F.lit("ok")))
    path = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    io.append_results(parts[0], path)
    io.append_results(io.collect_results(parts[1:]), path)
    return io.read_results(spark, path).select("dataset_id", "status", "n_train", "n_test", "benchmark")


@register("s9_export_table", "WITH " + tables.LINE_SQL + """,
ls AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT l_linestatus AS v FROM line WHERE l_linestatus IS NOT NULL AND l_linestatus <> '')),
ys AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT y AS v FROM line WHERE y IS NOT NULL AND y <> ''))
SELECT row_id, CAST(l_quantity AS DOUBLE) AS num_l_quantity, CAST(l_extendedprice AS DOUBLE) AS num_l_extendedprice,
       CAST(l_discount AS DOUBLE) AS num_l_discount, CAST(l_tax AS DOUBLE) AS num_l_tax,
       coalesce(ls.code, -1) AS cat_l_linestatus, CAST(coalesce(ys.code, -1) AS BIGINT) AS y
FROM line LEFT JOIN ls ON line.l_linestatus = ls.v LEFT JOIN ys ON line.y = ys.v""")
def s9_export_table(spark, sf_dir):
    d = tables.line(spark, sf_dir)
    return io.export_table(d, tables.LINE_FEATURES, ["l_linestatus"], "y")


@register("s10_dataset_profile", f"""
SELECT CAST(c_nationkey AS BIGINT) AS dataset_id,
       count(CASE WHEN {SUITE_SPLIT_SQL} = 'train' THEN 1 END) AS n_train,
       count(CASE WHEN {SUITE_SPLIT_SQL} = 'test' THEN 1 END) AS n_test,
       1 AS n_num_features, 0 AS n_cat_features,
       list_sort(list_distinct(list(c_mktsegment))) AS y_classes,
       CAST(0.2 AS DOUBLE) AS test_size, 42 AS random_state, true AS stratify
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_nationkey""")
def s10_dataset_profile(spark, sf_dir):
    p = io.dataset_profile(cust_suite_split(spark, sf_dir), ["c_acctbal"], [], keys=["dataset_id"])
    return p.select("dataset_id", "n_train", "n_test", "n_num_features", "n_cat_features", "y_classes",
                    "split_setting.*")
