"""Projections, filters and validation.

Fitting operators gather every statistic they need for all columns in one
aggregation pass; the driver only sees one row of statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.functions.exprs import nonfinite_to_null

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType, T.BooleanType)


def to_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Coerce to double; unparsable values become NULL (``try_cast``)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols})


def coerce_types(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """numeric/bool columns to double; string columns whose every
    non-null value parses as a number become double, the rest stay strings
    (categorical).  Binary columns are rejected.  One aggregation pass."""
    kinds: dict[str, str] = {}
    checks = []
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, T.BinaryType):
            raise TypeError(f"column {c}: byte arrays are not accepted")
        if isinstance(dt, T.StringType):
            checks.append(c)
    stats = {}
    if checks:
        row = df.agg(*[F.count(F.when(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull(),
                                      F.lit(1))).alias(c) for c in checks]).first()
        stats = row.asDict()
    out = {}
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, NUMERIC) or (c in stats and stats[c] == 0):
            out[c] = F.expr(f"try_cast(`{c}` AS DOUBLE)")
            kinds[c] = "numeric"
        else:
            kinds[c] = "categorical"
    return df.withColumns(out), kinds


def inf_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """+/-Inf and NaN become NULL."""
    return df.withColumns({c: nonfinite_to_null(c) for c in cols})


def non_null_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}


def drop_all_null_columns(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """C4: drop feature columns with no value; error when none remain."""
    cnt = non_null_counts(df, cols)
    keep = [c for c in cols if cnt[c] > 0]
    if not keep:
        raise ValueError("no feature column holds any value")
    return df.drop(*[c for c in cols if c not in keep]), keep


def _canon(df: DataFrame, c: str) -> str:
    """Canonical text of a cell for distinct counting; NaN/Inf count as missing."""
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return f"CASE WHEN isnan(`{c}`) OR abs(`{c}`) = double('inf') THEN NULL ELSE CAST(`{c}` AS STRING) END"
    return f"CAST(`{c}` AS STRING)"


def long_cells(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Unpivot features to ``(keep..., feature, value STRING)``; statistics over
    thousands of features then run as one grouped aggregation."""
    stack = ", ".join(f"'{c}', {_canon(df, c)}" for c in cols)
    return df.select(*(keep or []), F.expr(f"stack({len(cols)}, {stack}) AS (feature, value)"))


def feature_validity(df: DataFrame, cols: list[str], split: str = "split") -> DataFrame:
    """C5 statistics: one row per feature with the keep decision.

    Dropped iff (no nulls and a single value), or all-null on the train side,
    or all-null on the test side.  A constant column *with* nulls is kept
    (missing never equals a value).  One grouped pass over the long form.
    """
    long = long_cells(df, cols, [split])
    st = long.groupBy("feature").agg(
        F.count_distinct("value").alias("n_distinct"),
        (F.count(F.lit(1)) - F.count("value")).alias("n_missing"),
        F.count(F.when(F.col(split) == "train", F.col("value"))).alias("_tr"),
        F.count(F.when(F.col(split) == "test", F.col("value"))).alias("_te"),
        F.count(F.when(F.col(split) == "test", F.lit(1))).alias("_test_rows"))
    invalid = (((F.col("n_missing") == 0) & (F.col("n_distinct") <= 1)) | (F.col("_tr") == 0)
               | ((F.col("_test_rows") > 0) & (F.col("_te") == 0)))
    return st.select("feature", "n_distinct", "n_missing", (~invalid).alias("valid"))


def filter_valid_features(df: DataFrame, cols: list[str], split: str = "split"):
    """Keep valid features; returns (df, kept, removed) -- removed columns stay
    available in the input for a later restore (R17)."""
    v = {r["feature"]: r["valid"] for r in feature_validity(df, cols, split).collect()}
    kept = [c for c in cols if v[c]]
    if not kept:
        raise ValueError("no feature varies and has values on both sides")
    return df.drop(*[c for c in cols if not v[c]]), kept, [c for c in cols if not v[c]]


def detect_categorical(df: DataFrame, cols: list[str], min_rows: int = 100, max_distinct: int = 4) -> DataFrame:
    """Categorical iff rows >= ``min_rows`` and distinct values (missing counted once)
    < ``max_distinct``.  Exact distinct counts, one grouped pass over the long form."""
    st = long_cells(df, cols).groupBy("feature").agg(
        (F.count_distinct("value") + F.max(F.col("value").isNull().cast("long"))).alias("n_distinct"),
        F.count(F.lit(1)).alias("_rows"))
    return st.select("feature", "n_distinct",
                     ((F.col("_rows") >= min_rows) & (F.col("n_distinct") < max_distinct)).alias("is_categorical"))


def fill_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric missing to 0, other missing to ``'missing'``."""
    out = {}
    for c in cols:
        if isinstance(df.schema[c].dataType, NUMERIC):
            out[c] = F.coalesce(nonfinite_to_null(c) if isinstance(df.schema[c].dataType,
                                (T.FloatType, T.DoubleType)) else F.col(c), F.lit(0).cast(df.schema[c].dataType))
        else:
            out[c] = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
    return df.withColumns(out)


def unseen_counts(df: DataFrame, cols: list[str], split: str = "split") -> DataFrame:
    """C10 statistics: per string column, distinct test values absent from train.

    Long form ``(feature, value)`` so one shuffle serves every column."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.select(split, F.expr(f"stack({len(cols)}, {stack}) AS (feature, value)")).filter(
        F.col("value").isNotNull())
    tr = long.filter(F.col(split) == "train").select("feature", "value").distinct()
    te = long.filter(F.col(split) == "test").select("feature", "value").distinct()
    unseen = te.join(tr, ["feature", "value"], "left_anti").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_unseen"))
    feats = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return (feats.join(unseen, "feature", "left").fillna(0, ["n_unseen"])
            .withColumn("kept", F.col("n_unseen") == 0))


def encode_or_drop(df: DataFrame, cols: list[str], split: str = "split"):
    """Drop string columns with unseen test values; label-encode the rest on train."""
    from ctxtab.operators.encode import ordinal_encode_train
    st = {r["feature"]: r["kept"] for r in unseen_counts(df, cols, split).collect()}
    kept = [c for c in cols if st[c]]
    d = df.drop(*[c for c in cols if not st[c]])
    return (ordinal_encode_train(d, kept, split=split, missing_token=None) if kept else d), kept


def eligible_datasets(df: DataFrame, keys: list[str], y: str = "y", split: str = "split",
                      min_classes: int = 2, max_classes: int = 10, max_train_rows: int = 50_000,
                      min_train_rows: int = 2) -> DataFrame:
    """Datasets with a usable class count and train size (one grouped pass)."""
    st = df.groupBy(*keys).agg(
        F.count_distinct(y).alias("n_classes"),
        F.count(F.when(F.col(split) == "train", F.lit(1))).alias("n_train"))
    return st.filter((F.col("n_classes") >= min_classes) & (F.col("n_classes") <= max_classes)
                     & (F.col("n_train") >= min_train_rows) & (F.col("n_train") < max_train_rows))
