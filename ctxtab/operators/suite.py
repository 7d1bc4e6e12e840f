"""Suite reporting (V10-V17): task tables, result bookkeeping and parameter sweeps.

Tasks and results are DataFrames keyed by the four identity columns
``(benchmark, dataset_id, dataset_dir, dataset_name)``; every report is one
aggregation or join over them, so a suite of any size is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.operators import predict

TASK_KEYS = ["benchmark", "dataset_id", "dataset_dir", "dataset_name"]

RESULT_SCHEMA = T.StructType([
    T.StructField("benchmark", T.StringType()), T.StructField("dataset_id", T.StringType()),
    T.StructField("dataset_dir", T.StringType()), T.StructField("dataset_name", T.StringType()),
    T.StructField("n_train", T.LongType()), T.StructField("n_test", T.LongType()),
    T.StructField("n_features", T.LongType()), T.StructField("n_classes", T.LongType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("f1_macro", T.DoubleType()),
    T.StructField("logloss", T.DoubleType()), T.StructField("predict_seconds", T.DoubleType()),
    T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])

# Fixed value: error text of a task that no worker reported on
MISSING_RESULT_ERROR = ("Missing worker result: task was discovered but no worker wrote a result row. "
                        "worker_exitcodes=")


def suite_summary(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Discovered / skipped / processed / ok / fail counts and ok-row means, one row.

    ``tasks`` carries ``task_status`` (``skipped`` or anything else)."""
    t = tasks.agg(F.count(F.lit(1)).alias("discovered_datasets"),
                  F.count_if(F.col("task_status") == "skipped").alias("skipped_datasets"))
    ok = F.col("status") == "ok"
    r = results.agg(
        F.count(F.lit(1)).alias("processed_datasets"),
        F.count_if(ok).alias("ok_count"),
        F.count_if(F.col("status") == "fail").alias("fail_count"),
        F.avg(F.when(ok, F.col("accuracy"))).alias("mean_accuracy"),
        F.avg(F.when(ok, F.col("f1_macro"))).alias("mean_f1_macro"),
        F.avg(F.when(ok, F.col("logloss"))).alias("mean_logloss"))
    # two single-row aggregates side by side (a one-row join, not a data cross join)
    return t.withColumn("_k", F.lit(1)).join(r.withColumn("_k", F.lit(1)), "_k").drop("_k")


def task_table(runnable: DataFrame, skipped: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Runnable (``pending``) and skipped tasks; a result row's status overrides."""
    t = (runnable.withColumn("task_status", F.lit("pending"))
         .unionByName(skipped.withColumn("task_status", F.lit("skipped"))))
    if results is None:
        return t
    m = t.join(results, TASK_KEYS, "left")
    return m.withColumn("task_status", F.coalesce(F.col("status"), F.col("task_status")))


def missing_results(tasks: DataFrame, results: DataFrame, worker_exitcodes: list[int]) -> DataFrame:
    """One ``fail`` row for every task without a result row (anti join on the 4 keys)."""
    err = MISSING_RESULT_ERROR + ",".join(str(c) for c in worker_exitcodes)
    miss = tasks.select(*TASK_KEYS).join(results.select(*TASK_KEYS), TASK_KEYS, "left_anti")
    fill = {"n_train": F.lit(0).cast("long"), "n_test": F.lit(0).cast("long"),
            "n_features": F.lit(0).cast("long"), "n_classes": F.lit(None).cast("long"),
            "accuracy": F.lit(None).cast("double"), "f1_macro": F.lit(None).cast("double"),
            "logloss": F.lit(None).cast("double"), "predict_seconds": F.lit(0.0),
            "status": F.lit("fail"), "error": F.lit(err)}
    return miss.withColumns(fill)


def plain_name(c: Column) -> Column:
    """Basename (either slash), drop ``.csv``, then a ``_train``/``_test`` suffix, trim, lower."""
    base = F.regexp_extract(F.regexp_replace(F.trim(c), r"\\", "/"), r"([^/]*)$", 1)
    base = F.regexp_replace(base, r"(?i)\.csv$", "")
    base = F.regexp_replace(base, r"(?i)(_train|_test)$", "")
    return F.lower(F.trim(base))


def skip_tokens(raw: DataFrame, col: str = "value") -> DataFrame:
    """Split raw skip text (commas or newlines) into normalised names."""
    tok = raw.select(F.explode(F.split(F.col(col), r"[\r\n,]+")).alias("t"))
    return (tok.select(plain_name(F.col("t")).alias("skip_name"))
            .filter(F.length("skip_name") > 0).distinct())


def skip_filter(tasks: DataFrame, skip_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split tasks into (runnable, skipped): a task is skipped when any of its
    five name candidates matches a skip name.  The skip list joins as a table
    (Catalyst broadcasts it only under the size threshold)."""
    cands = F.array(*[plain_name(F.coalesce(F.col(c), F.lit("")))
                      for c in ["dataset_name", "dataset_id", "single_csv", "train_csv", "test_csv"]])
    ex = tasks.select(*TASK_KEYS, F.explode(cands).alias("skip_name")).filter(F.length("skip_name") > 0)
    hit = ex.join(skip_names, "skip_name", "left_semi").select(*TASK_KEYS).distinct()
    skipped = tasks.join(hit, TASK_KEYS, "left_semi")
    runnable = tasks.join(hit, TASK_KEYS, "left_anti")
    return runnable, skipped


def rerun_failed(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """The tasks whose previous result has ``status = 'fail'``."""
    return tasks.join(results.filter(F.col("status") == "fail").select(*TASK_KEYS), TASK_KEYS, "left_semi")


def run_per_dataset(df: DataFrame, keys: list[str], fn, out_cols: list[str]) -> DataFrame:
    """Run ``fn(pandas_frame) -> dict`` once per dataset; an exception becomes a
    ``fail`` row carrying the error text and the job continues.

    Each dataset is one group (the suite's eligibility filter bounds its size).
    Output: keys, ``out_cols`` (double), ``status``, ``error``.
    """
    import pandas as pd

    schema = T.StructType([df.schema[k] for k in keys]
                          + [T.StructField(c, T.DoubleType()) for c in out_cols]
                          + [T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: pdf[k].iloc[0] for k in keys}
        try:
            res = fn(pdf)
            row.update({c: float(res[c]) if res.get(c) is not None else None for c in out_cols})
            row.update(status="ok", error=None)
        except Exception as exc:  # noqa: BLE001 - the failure is the result row
            row.update({c: None for c in out_cols})
            row.update(status="fail", error=f"{type(exc).__name__}: {exc}")
        return pd.DataFrame([row], columns=[f.name for f in schema.fields])

    return df.groupBy(*keys).applyInPandas(run, schema)


def sweep_contexts(ctx: DataFrame, params: list[dict], keys: list[str] | None = None) -> DataFrame:
    """The context of every trial from one ranked candidate list.

    ``ctx`` is ranked once at the largest trial length (with ``weight``); each
    trial ``{param_id, k, threshold}`` keeps rank <= k and, with a threshold,
    only the prefix whose preceding weight mass is below it (``min`` combine).
    Every candidate row expands to the ids of the trials that keep it (an
    array filter + explode, no join), so the work is the sum of trial
    context sizes.
    """
    keys = list(keys or [])
    w = Window.partitionBy(*keys, "test_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    c = ctx.withColumn("_before", F.coalesce(F.sum("weight").over(w), F.lit(0.0)))
    grid = F.array(*[F.struct(F.lit(int(p["param_id"])).alias("pid"), F.lit(int(p["k"])).alias("k"),
                              F.lit(p.get("threshold")).cast("double").alias("thr")) for p in params])
    keep = F.filter(grid, lambda p: (F.col("rank") <= p["k"])
                    & (p["thr"].isNull() | (F.col("_before") < p["thr"])))
    return (c.withColumn("param_id", F.explode(F.transform(keep, lambda p: p["pid"])))
            .drop("_before"))


def sweep_scores(ctx: DataFrame, params: list[dict], train: DataFrame, truth: DataFrame,
                 temperature: float = 0.9, keys: list[str] | None = None) -> DataFrame:
    """Accuracy of every trial, ``(keys, param_id, accuracy)``."""
    keys = list(keys or [])
    sc = sweep_contexts(ctx, params, keys)
    lab = train.select(*keys, F.col("row_id").alias("train_id"), F.col("y").alias("class"))
    best = F.max("score").over(Window.partitionBy(*keys, "param_id", "test_id", "class"))  # so that no far weight vanishes
    logits = (sc.join(lab, [*keys, "train_id"]).withColumn("_best", best)
              .groupBy(*keys, "param_id", "test_id", "class")
              .agg((F.max("_best") - F.max("lse") + F.log(F.sum(F.exp(F.col("score") - F.col("_best"))))).alias("logit")))
    probs = predict.temperature_softmax(logits, temperature, keys=[*keys, "param_id"])
    pred = probs.groupBy(*keys, "param_id", "test_id").agg(
        F.min_by("class", F.struct(-F.col("p"), F.col("class"))).alias("pred"))
    pt = pred.join(truth, [*keys, "test_id"])
    return pt.groupBy(*keys, "param_id").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))


def best_trial(scores: DataFrame, metric: str = "accuracy", keys: list[str] | None = None) -> DataFrame:
    """Best trial per dataset (ties to the lowest param id)."""
    keys = list(keys or [])
    g = scores.groupBy(*keys) if keys else scores.groupBy()
    return g.agg(F.min_by("param_id", F.struct(-F.col(metric), F.col("param_id"))).alias("best_param_id"),
                 F.max(metric).alias(f"best_{metric}"))


def sweep_summary(scores: DataFrame, metric: str = "accuracy", default_param: int = 0,
                  keys: list[str] | None = None) -> DataFrame:
    """Default-trial metric, max, mean and min over the trials, per dataset."""
    keys = list(keys or [])
    g = scores.groupBy(*keys) if keys else scores.groupBy()
    return g.agg(F.max(F.when(F.col("param_id") == default_param, F.col(metric))).alias(f"default_{metric}"),
                 F.max(metric).alias(f"max_{metric}"), F.avg(metric).alias(f"mean_{metric}"),
                 F.min(metric).alias(f"min_{metric}"))
