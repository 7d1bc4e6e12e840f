"""Queries for suite reporting and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxtab.functions.exprs import r6
from ctxtab.operators import retrieve, suite
from ctxtab.operators.suite import TASK_KEYS
from ctxtab.plans.q_clean import SUITE_SPLIT_SQL, cust_suite_split
from ctxtab.plans.q_retrieve import TEMP, VEC_CTX_SQL, _vec_sides
from ctxtab.plans.registry import register
from ctxtab.sources import tables

KEYS_SQL = ", ".join(TASK_KEYS)
EXITCODES = [0] * 8


def _norm_sql(x: str) -> str:
    return (f"lower(trim(regexp_replace(regexp_replace(regexp_extract(replace(trim({x}), '\\', '/'), "
            f"'([^/]*)$', 1), '(?i)\\.csv$', ''), '(?i)(_train|_test)$', '')))")


SKIP_FILTER_SQL = tables.SUITE_RESULTS_SQL + ",\n" + tables.SKIP_SQL + f""",
toks AS (SELECT unnest(regexp_split_to_array(value, '[\\r\\n,]+')) AS t FROM skipraw),
skipn AS (SELECT DISTINCT {_norm_sql('t')} AS skip_name FROM toks WHERE length({_norm_sql('t')}) > 0),
cand AS (SELECT {KEYS_SQL}, unnest([{', '.join(_norm_sql(f"coalesce({c}, '')") for c in
                                              ['dataset_name', 'dataset_id', 'single_csv', 'train_csv', 'test_csv'])}]) AS skip_name
         FROM tasks),
hit AS (SELECT DISTINCT {KEYS_SQL} FROM cand WHERE length(skip_name) > 0 AND skip_name IN (SELECT skip_name FROM skipn)),
skipped AS (SELECT t.* FROM tasks t WHERE EXISTS (SELECT 1 FROM hit h WHERE h.benchmark = t.benchmark
            AND h.dataset_id = t.dataset_id AND h.dataset_dir = t.dataset_dir AND h.dataset_name = t.dataset_name)),
runnable AS (SELECT t.* FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.benchmark = t.benchmark
            AND h.dataset_id = t.dataset_id AND h.dataset_dir = t.dataset_dir AND h.dataset_name = t.dataset_name)),
runres AS (SELECT r.* FROM results r WHERE EXISTS (SELECT 1 FROM runnable t WHERE t.benchmark = r.benchmark
            AND t.dataset_id = r.dataset_id AND t.dataset_dir = r.dataset_dir AND t.dataset_name = r.dataset_name)),
missing AS (SELECT {KEYS_SQL}, CAST(0 AS BIGINT) AS n_train, CAST(0 AS BIGINT) AS n_test, CAST(0 AS BIGINT) AS n_features,
                   CAST(NULL AS BIGINT) AS n_classes, CAST(NULL AS DOUBLE) AS accuracy, CAST(NULL AS DOUBLE) AS f1_macro,
                   CAST(NULL AS DOUBLE) AS logloss, CAST(0 AS DOUBLE) AS predict_seconds, 'fail' AS status,
                   '{suite.MISSING_RESULT_ERROR}{",".join(str(c) for c in EXITCODES)}' AS error
            FROM runnable t WHERE NOT EXISTS (SELECT 1 FROM results r WHERE t.benchmark = r.benchmark
            AND t.dataset_id = r.dataset_id AND t.dataset_dir = r.dataset_dir AND t.dataset_name = r.dataset_name)),
allres AS (SELECT * FROM runres UNION ALL SELECT * FROM missing)"""


def _suite(spark, sf_dir):
    tasks = tables.suite_tasks(spark, sf_dir)
    results = tables.suite_results(spark, sf_dir)
    skip = suite.skip_tokens(tables.skip_text(spark, sf_dir))
    runnable, skipped = suite.skip_filter(tasks, skip)
    run_res = results.join(runnable.select(*TASK_KEYS), TASK_KEYS, "left_semi")
    missing = suite.missing_results(runnable, results, EXITCODES)
    all_res = run_res.unionByName(missing)
    return tasks, runnable, skipped, run_res, all_res


@register("v10_suite_summary", "WITH " + SKIP_FILTER_SQL + """
SELECT (SELECT count(*) FROM tasks) AS discovered_datasets, (SELECT count(*) FROM skipped) AS skipped_datasets,
       count(*) AS processed_datasets, count(CASE WHEN status = 'ok' THEN 1 END) AS ok_count,
       count(CASE WHEN status = 'fail' THEN 1 END) AS fail_count,
       round(avg(CASE WHEN status = 'ok' THEN accuracy END), 6) AS mean_accuracy,
       round(avg(CASE WHEN status = 'ok' THEN f1_macro END), 6) AS mean_f1_macro,
       round(avg(CASE WHEN status = 'ok' THEN logloss END), 6) AS mean_logloss
FROM allres""")
def v10_suite_summary(spark, sf_dir):
    _, runnable, skipped, _, all_res = _suite(spark, sf_dir)
    s = suite.suite_summary(suite.task_table(runnable, skipped), all_res)
    return s.select("discovered_datasets", "skipped_datasets", "processed_datasets", "ok_count", "fail_count",
                    r6("mean_accuracy", "mean_accuracy"), r6("mean_f1_macro", "mean_f1_macro"),
                    r6("mean_logloss", "mean_logloss"))


@register("v11_task_table", "WITH " + SKIP_FILTER_SQL + f""",
tt AS (SELECT *, 'pending' AS task_status FROM runnable UNION ALL SELECT *, 'skipped' FROM skipped)
SELECT tt.benchmark, tt.dataset_id, tt.dataset_dir, tt.dataset_name, tt.single_csv, tt.train_csv, tt.test_csv,
       coalesce(r.status, tt.task_status) AS task_status, r.n_train, round(r.accuracy, 6) AS accuracy
FROM tt LEFT JOIN runres r ON tt.benchmark = r.benchmark AND tt.dataset_id = r.dataset_id
     AND tt.dataset_dir = r.dataset_dir AND tt.dataset_name = r.dataset_name""")
def v11_task_table(spark, sf_dir):
    _, runnable, skipped, run_res, _ = _suite(spark, sf_dir)
    t = suite.task_table(runnable, skipped, run_res)
    return t.select(*TASK_KEYS, "single_csv", "train_csv", "test_csv", "task_status", "n_train",
                    r6("accuracy", "accuracy"))


@register("v12_missing_results", "WITH " + SKIP_FILTER_SQL + "\nSELECT * FROM missing")
def v12_missing_results(spark, sf_dir):
    tasks = tables.suite_tasks(spark, sf_dir)
    results = tables.suite_results(spark, sf_dir)
    runnable, _ = suite.skip_filter(tasks, suite.skip_tokens(tables.skip_text(spark, sf_dir)))
    return suite.missing_results(runnable, results, EXITCODES)


@register("v13_skip_filter", "WITH " + SKIP_FILTER_SQL + f"\nSELECT {KEYS_SQL} FROM skipped")
def v13_skip_filter(spark, sf_dir):
    _, _, skipped, _, _ = _suite(spark, sf_dir)
    return skipped.select(*TASK_KEYS)


@register("v14_rerun_failed", "WITH " + SKIP_FILTER_SQL + f"""
SELECT {KEYS_SQL}, single_csv, train_csv, test_csv FROM tasks t WHERE EXISTS (
  SELECT 1 FROM allres r WHERE r.status = 'fail' AND t.benchmark = r.benchmark AND t.dataset_id = r.dataset_id
  AND t.dataset_dir = r.dataset_dir AND t.dataset_name = r.dataset_name)""")
def v14_rerun_failed(spark, sf_dir):
    tasks, _, _, _, all_res = _suite(spark, sf_dir)
    return suite.rerun_failed(tasks, all_res)


def _majority_model(pdf):
    """Per-dataset job: the single most frequent train class scored on the test side; a tie is an error."""
    counts = pdf.loc[pdf["split"] == "train", "y"].value_counts()
    top = sorted(counts[counts == counts.max()].index) if len(counts) else []
    if len(top) != 1:
        raise ValueError(f"no single most frequent class: {len(top)} of {int(counts.max()) if top else 0} rows")
    te = pdf[pdf["split"] == "test"]
    return {"n_train": int(counts.sum()), "accuracy": float((te["y"] == top[0]).mean()) if len(te) else None}


@register("v15_result_status", f"""
WITH s AS (SELECT CAST(c_nationkey AS BIGINT) AS dataset_id, c_mktsegment AS y, {SUITE_SPLIT_SQL} AS split
           FROM customer WHERE c_mktsegment IS NOT NULL),
c AS (SELECT dataset_id, y, count(*) AS k FROM s WHERE split = 'train' GROUP BY 1, 2),
h AS (SELECT dataset_id, sum(k) AS n_train, max(k) AS most FROM c GROUP BY 1),
m AS (SELECT c.dataset_id, any_value(h.n_train) AS n_train, any_value(h.most) AS most, count(*) AS n_top, min(y) AS top
      FROM c JOIN h ON c.dataset_id = h.dataset_id AND c.k = h.most GROUP BY 1),
a AS (SELECT s.dataset_id, avg(CASE WHEN s.y = m.top THEN 1.0 ELSE 0.0 END) AS acc
      FROM s JOIN m ON s.dataset_id = m.dataset_id WHERE s.split = 'test' GROUP BY 1),
d AS (SELECT DISTINCT dataset_id FROM s)
SELECT d.dataset_id, CASE WHEN n_top = 1 THEN CAST(n_train AS DOUBLE) END AS n_train,
       CASE WHEN n_top = 1 THEN round(a.acc, 6) END AS accuracy,
       CASE WHEN n_top = 1 THEN 'ok' ELSE 'fail' END AS status,
       CASE WHEN n_top = 1 THEN NULL ELSE 'ValueError: no single most frequent class: ' || coalesce(n_top, 0) || ' of ' || coalesce(most, 0) || ' rows' END AS error
FROM d LEFT JOIN m ON d.dataset_id = m.dataset_id LEFT JOIN a ON d.dataset_id = a.dataset_id""")
def v15_result_status(spark, sf_dir):
    d = cust_suite_split(spark, sf_dir).select("dataset_id", "y", "split")
    r = suite.run_per_dataset(d, ["dataset_id"], _majority_model, ["n_train", "accuracy"])
    return r.select("dataset_id", "n_train", r6("accuracy", "accuracy"), "status", "error")


# Retrieval sweep on the vec table: lengths, and two thresholded (min-combined) trials
SWEEP = [{"param_id": 0, "k": 5}, {"param_id": 1, "k": 10}, {"param_id": 2, "k": 15},
         {"param_id": 3, "k": 20}, {"param_id": 4, "k": 30},
         {"param_id": 5, "k": 15, "threshold": 0.5}, {"param_id": 6, "k": 30, "threshold": 0.8}]
DEFAULT_PARAM = 2

SWEEP_SQL = VEC_CTX_SQL + """,
params(pid, k, thr) AS (VALUES """ + ", ".join(
    f"({p['param_id']}, {p['k']}, {p['threshold'] if p.get('threshold') is not None else 'NULL'})" for p in SWEEP) + f"""),
rkb AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY test_id ORDER BY rank
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rk
        WHERE rank <= {max(p['k'] for p in SWEEP)}),
sc AS (SELECT p.pid, r.* FROM rkb r JOIN params p ON r.rank <= p.k AND (p.thr IS NULL OR r.before < p.thr)),
lg AS (SELECT pid, test_id, ty AS class, ln(sum(weight)) AS logit FROM sc GROUP BY 1, 2, 3),
sm AS (SELECT *, exp(logit / {TEMP} - max(logit / {TEMP}) OVER (PARTITION BY pid, test_id)) AS e FROM lg),
pr AS (SELECT pid, test_id, class, e / sum(e) OVER (PARTITION BY pid, test_id) AS p FROM sm),
am AS (SELECT pid, test_id, arg_min(class, (-p, class)) AS pred FROM pr GROUP BY 1, 2),
acc AS (SELECT am.pid AS param_id, avg(CASE WHEN am.pred = v.y THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM am JOIN vec v ON am.test_id = v.row_id GROUP BY 1)"""


def _sweep(spark, sf_dir):
    test, train = _vec_sides(spark, sf_dir)
    ctx = retrieve.top_k_context(test, train, "emb", max(p["k"] for p in SWEEP))
    truth = test.select(F.col("row_id").alias("test_id"), "y")
    return suite.sweep_scores(ctx, SWEEP, train, truth, TEMP)


@register("v16_sweep", "WITH " + SWEEP_SQL + "\nSELECT param_id, round(accuracy, 6) AS accuracy FROM acc")
def v16_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).select("param_id", r6("accuracy", "accuracy"))


@register("v16_best_trial", "WITH " + SWEEP_SQL + """
SELECT arg_min(param_id, (-accuracy, param_id)) AS best_param_id, round(max(accuracy), 6) AS best_accuracy FROM acc""")
def v16_best_trial(spark, sf_dir):
    return suite.best_trial(_sweep(spark, sf_dir)).select("best_param_id", r6("best_accuracy", "best_accuracy"))


@register("v17_sweep_summary", "WITH " + SWEEP_SQL + f"""
SELECT round(max(CASE WHEN param_id = {DEFAULT_PARAM} THEN accuracy END), 6) AS default_accuracy,
       round(max(accuracy), 6) AS max_accuracy, round(avg(accuracy), 6) AS mean_accuracy,
       round(min(accuracy), 6) AS min_accuracy FROM acc""")
def v17_sweep_summary(spark, sf_dir):
    s = suite.sweep_summary(_sweep(spark, sf_dir), default_param=DEFAULT_PARAM)
    return s.select(*[r6(c, c) for c in ["default_accuracy", "max_accuracy", "mean_accuracy", "min_accuracy"]])
