"""Splits and sampling.

Randomness comes from an integer hash of the row id, so a split is a pure
function of the data and does not depend on partitioning.  Ranking inside
a class never sorts a whole class in one task: rows are first counted per
(class, hash bucket), the bucket offsets come from that small table and only
the rows of one bucket are ordered together (see :func:`group_rank`).  A
class holding a third of all rows is therefore spread over ``buckets`` tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxtab.functions.exprs import HASH_MOD, id_hash


BUCKET_ROWS = 8192


def group_rank(df: DataFrame, keys: list[str], hash_col: str, id_col: str,
               name: str = "grp_rank", total: str | None = None,
               buckets: int | None = None) -> DataFrame:
    """Exact 1-based rank by ``(hash_col, id_col)`` within each ``keys`` group.

    ``hash_col`` must lie in ``[0, 2^32)``.  The optional ``total`` column
    receives the group size.  Work per task is bounded by a bucket, not by
    the largest group; ``buckets`` follows the row count (``BUCKET_ROWS`` each).
    """
    buckets = buckets or max(1, -(-df.count() // BUCKET_ROWS))
    width = -(-HASH_MOD // buckets)
    d = df.withColumn("_gb", F.floor(F.col(hash_col) / F.lit(width)).cast("int"))
    counts = d.groupBy(*keys, "_gb").agg(F.count(F.lit(1)).alias("_gn"))
    wk = Window.partitionBy(*keys).orderBy("_gb")
    counts = counts.withColumn("_gbefore", F.sum("_gn").over(wk) - F.col("_gn"))
    if total:
        counts = counts.withColumn(total, F.sum("_gn").over(Window.partitionBy(*keys)))
    cols = [*keys, "_gb", "_gbefore"] + ([total] if total else [])
    d = d.join(counts.select(*cols), on=[*keys, "_gb"])
    wb = Window.partitionBy(*keys, "_gb").orderBy(hash_col, id_col)
    return d.withColumn(name, F.col("_gbefore") + F.row_number().over(wb)).drop("_gb", "_gbefore")


def stratified_split(df: DataFrame, y: str = "y", id_col: str = "row_id",
                     test_frac: float = 0.2, salt: int = 0, out: str = "split") -> DataFrame:
    """Per class, the first ``ceil(frac * n_class)`` rows by id hash are test.

    If the smallest class has fewer than 2 rows a stratified split is not
    defined and the plain split (P2) is used, as the reference does.
    """
    min_class, n = df.groupBy(y).count().agg(F.min("count"), F.sum("count")).first()  # decides the form of the plan
    if min_class is None or min_class < 2:
        return plain_split(df, id_col=id_col, test_frac=test_frac, salt=salt, out=out)
    d = df.withColumn("_h", id_hash(id_col, salt))
    d = group_rank(d, [y], "_h", id_col, name="_r", total="_n", buckets=-(-n // BUCKET_ROWS))
    test = F.col("_r") <= F.ceil(F.lit(test_frac) * F.col("_n"))
    return d.withColumn(out, F.when(test, "test").otherwise("train")).drop("_h", "_r", "_n")


def plain_split(df: DataFrame, id_col: str = "row_id", test_frac: float = 0.2,
                salt: int = 0, out: str = "split") -> DataFrame:
    """First ``ceil(frac * n)`` rows by id hash are test."""
    d = df.withColumn("_h", id_hash(id_col, salt)).withColumn("_k", F.lit(0))
    d = group_rank(d, ["_k"], "_h", id_col, name="_r", total="_n")
    test = F.col("_r") <= F.ceil(F.lit(test_frac) * F.col("_n"))
    return d.withColumn(out, F.when(test, "test").otherwise("train")).drop("_h", "_r", "_n", "_k")


def apply_fold(df: DataFrame, folds: DataFrame, id_col: str = "row_id",
               repeat: int = 0, fold: int = 0, out: str = "split") -> DataFrame:
    """Externally supplied ``(row_id, repeat, fold)`` rows mark the test side."""
    f = (folds.filter((F.col("repeat") == repeat) & (F.col("fold") == fold))
         .select(id_col).distinct().withColumn("_is_test", F.lit(True)))
    return (df.join(f, id_col, "left")
            .withColumn(out, F.when(F.col("_is_test"), "test").otherwise("train"))
            .drop("_is_test"))


def stratified_shards(df: DataFrame, shard_rows: int, y: str = "y", id_col: str = "row_id",
                      salt: int = 0, out: str = "shard") -> DataFrame:
    """Deal each class round-robin (after a hash shuffle) into ceil(n/size) shards.

    A shard with a single class joins the largest shard that has several (ties: lowest number); if
    none has, all rows are shard 0.  The rule is a join with the shard table; the driver sees the one
    target only.
    """
    n = df.count()
    if shard_rows <= 0 or n <= shard_rows:
        return df.withColumn(out, F.lit(0))
    n_shards = max(1, math.ceil(n / shard_rows))
    d = df.withColumn("_h", id_hash(id_col, salt))
    d = group_rank(d, [y], "_h", id_col, name="_r")
    d = d.withColumn(out, F.pmod(F.col("_r") - 1, F.lit(n_shards)).cast("int")).drop("_h", "_r")
    stats = d.groupBy(out).agg(F.count(F.lit(1)).alias("_n"), (F.min(y) != F.max(y)).alias("_mixed"))
    home = stats.filter("_mixed").agg(F.max_by(out, F.struct("_n", -F.col(out))).alias("s")).first()["s"]
    moved = F.coalesce(F.when(F.col("_mixed"), F.col(out)), F.lit(0 if home is None else home)).cast("int")
    return d.join(stats.select(out, "_mixed"), out).withColumn(out, moved).drop("_mixed").select(*df.columns, out)


def mask_cells(df: DataFrame, feature_cols: list[str], frac: float = 0.3,
               id_col: str = "row_id", salt: int = 7) -> tuple[DataFrame, DataFrame]:
    """P5: hide ``floor(frac * n_observed)`` observed cells, chosen by cell hash.

    Returns ``(masked_wide, truth_long)`` where ``truth_long`` holds
    ``(row_id, feature, value)`` for every hidden cell.
    """
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in feature_cols)
    cells = (df.select(id_col, F.expr(f"stack({len(feature_cols)}, {stack}) AS (feature, value)"))
             .filter(F.col("value").isNotNull()))
    fidx = F.array_position(F.array(*[F.lit(c) for c in feature_cols]), F.col("feature"))
    cells = cells.withColumn("_cid", F.col(id_col) * F.lit(len(feature_cols)) + fidx - 1)
    cells = cells.withColumn("_h", id_hash("_cid", salt)).withColumn("_k", F.lit(0))
    cells = group_rank(cells, ["_k"], "_h", "_cid", name="_r", total="_n")
    truth = (cells.filter(F.col("_r") <= F.floor(F.lit(frac) * F.col("_n")))
             .select(id_col, "feature", "value"))
    hidden = truth.groupBy(id_col).agg(F.collect_set("feature").alias("_hidden"))
    masked = df.join(hidden, id_col, "left").select(
        *[c for c in df.columns if c not in feature_cols],
        *[F.when(F.array_contains(F.coalesce(F.col("_hidden"), F.array().cast("array<string>")), c),
                 F.lit(None).cast("double")).otherwise(F.col(c).cast("double")).alias(c)
          for c in feature_cols])
    return masked, truth
