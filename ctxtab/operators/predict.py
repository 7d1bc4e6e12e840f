"""Prediction and ensembling.

The reference calls a pretrained network here; its weights are not part of
the reference tree, so the engine predicts with a documented non-learned
context predictor: class score = sum of the softmax attention weights of the
context rows of that class, and ``log(score)`` acts as the logit.  Output
contracts (long ``(test_id, class, p)`` tables, wide ``pred_*`` at the sink)
follow the reference.  :func:`score_with_model` is the hook for a real model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.functions.exprs import class_list
from ctxtab.operators.retrieve import SHARD_ROWS, LongContexts, ShardContexts, long_votes, summed_votes, top_k_context


def class_logits(ctx: DataFrame, train: DataFrame, label_col: str = "y", id_col: str = "row_id",
                 keys: list[str] | None = None) -> DataFrame:
    """M1 (kernel form): ``(test_id, class, logit)`` with logit = log(sum of weights).

    Classes absent from a row's context are absent here (logit -inf).  Sums are
    taken relative to the best score of the class, so no weight underflows.
    """
    keys = list(keys or [])
    t = train.select(*keys, F.col(id_col).alias("train_id"), F.col(label_col).alias("class"))
    best = F.max("score").over(Window.partitionBy(*keys, "test_id", "class"))
    return (ctx.join(t, [*keys, "train_id"]).withColumn("_best", best)
            .groupBy(*keys, "test_id", "class")
            .agg((F.max("_best") - F.max("lse") + F.log(F.sum(F.exp(F.col("score") - F.col("_best"))))).alias("logit")))


def _relative(ctx: DataFrame, by: list[str]) -> DataFrame:
    """``ctx`` with ``_w``: weights relative to the best context row of each ``by`` group (never all zero)."""
    return ctx.withColumn("_w", F.exp(F.col("score") - F.max("score").over(Window.partitionBy(*by))))


def temperature_softmax(logits: DataFrame, temperature: float = 0.9,
                        keys: list[str] | None = None, logit: str = "logit") -> DataFrame:
    """M4: ``exp(l/T - max) / sum`` per test row (window on test_id)."""
    keys = list(keys or [])
    w = Window.partitionBy(*keys, "test_id")
    s = F.col(logit) / F.lit(float(temperature))
    e = logits.withColumn("_e", F.exp(s - F.max(s).over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e", logit)


def predict_classes(ctx: DataFrame, train: DataFrame, temperature: float = 0.9,
                    label_col: str = "y", id_col: str = "row_id",
                    keys: list[str] | None = None) -> DataFrame:
    """M1 + M4: class probabilities ``(test_id, class, p)``.

    Contexts of shards (``top_k_context`` with ``shard``) are voted on where they are found, when M6 sums them;
    long ones (with ``votes``) are too.
    """
    if isinstance(ctx, ShardContexts):
        return ctx.voted(label_col, temperature)
    if isinstance(ctx, LongContexts):
        return temperature_softmax(long_votes(ctx, train, label_col), temperature)
    return temperature_softmax(class_logits(ctx, train, label_col, id_col, keys), temperature, keys)


def predict_values(ctx: DataFrame, train: DataFrame, label_col: str = "y", id_col: str = "row_id",
                   keys: list[str] | None = None) -> DataFrame:
    """M2: weighted mean of the context targets ``(test_id, pred)``."""
    keys = list(keys or [])
    t = train.select(*keys, F.col(id_col).alias("train_id"), F.col(label_col).cast("double").alias("_y"))
    return (_relative(ctx.join(t, [*keys, "train_id"]).filter(F.col("_y").isNotNull()), [*keys, "test_id"])
            .groupBy(*keys, "test_id").agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("pred")))


def impute_cells(ctx: DataFrame, train: DataFrame, feature_cols: list[str], id_col: str = "row_id",
                 categorical: list[str] | None = None) -> DataFrame:
    """M3: per test row and feature, context-weighted mean (numeric) or weighted mode.

    Long output ``(test_id, feature, imputed)``; only non-null context cells vote.
    """
    categorical = list(categorical or [])
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in feature_cols)
    wide = train.select(F.col(id_col).alias("train_id"), *feature_cols)
    cells = (ctx.select("test_id", "train_id", "score").join(wide, "train_id")
             .select("test_id", "score", F.expr(f"stack({len(feature_cols)}, {stack}) AS (feature, v)"))
             .filter(F.col("v").isNotNull()))
    # one pass for means and modes: a second branch would score all contexts once more
    votes = (_relative(cells, ["test_id", "feature"]).groupBy("test_id", "feature", "v").agg(F.sum("_w").alias("_votes")))
    mean = F.sum(F.col("_votes") * F.col("v")) / F.sum("_votes")
    mode = F.max_by("v", F.struct(F.col("_votes"), -F.col("v")))
    return votes.groupBy("test_id", "feature").agg(
        (F.when(F.col("feature").isin(categorical), mode).otherwise(mean) if categorical else mean).alias("imputed"))


def fill_gaps(masked: DataFrame, imputed: DataFrame, feature_cols: list[str], id_col: str = "test_id") -> DataFrame:
    """M3: null cells of ``masked`` from the long imputed table; observed cells stay."""
    wide = imputed.groupBy(id_col).agg(*[F.max(F.when(F.col("feature") == c, F.col("imputed"))).alias(f"_{c}") for c in feature_cols])
    return masked.join(wide, id_col, "left").select(
        *[c for c in masked.columns if c not in feature_cols], *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in feature_cols])


def ensemble_average(members: DataFrame, keys: list[str] | None = None, value: str = "p", n_members: int | None = None) -> DataFrame:
    """M5: mean over members then renormalise per test row.

    ``members`` is the long union ``(member, test_id, class, p)``; a class
    missing from a member counts as 0 in that member's average.  Give
    ``n_members`` where it is known: counting them runs every member once more.
    """
    keys = list(keys or [])
    if n_members is None:
        n_members = members.select("member").distinct().count()
    avg = (members.groupBy(*keys, "test_id", "class")
           .agg((F.sum(value) / F.lit(n_members)).alias("_a")))
    w = Window.partitionBy(*keys, "test_id")
    return avg.withColumn(value, F.try_divide(F.col("_a"), F.sum("_a").over(w))).drop("_a")


def ensemble_mean_values(members: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """M5 (regression): plain mean over members."""
    keys = list(keys or [])
    return members.groupBy(*keys, "test_id").agg(F.avg("pred").alias("pred"))


def sharded_average(shard_probs: DataFrame, shard_sizes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """M6: weight each shard's probabilities by its share of train rows, divide by the weight sum.

    ``shard_sizes`` has one row per (keys, shard).
    """
    keys = list(keys or [])
    if isinstance(shard_probs, ShardContexts):
        return _summed(shard_probs, shard_sizes)
    if keys:
        total = shard_sizes.groupBy(*keys).agg(F.sum("n").alias("_ws"))
        j = shard_probs.join(shard_sizes.select(*keys, "shard", "n"), [*keys, "shard"]).join(total, keys)
    else:
        total = shard_sizes.agg(F.sum("n")).first()[0]
        j = shard_probs.join(shard_sizes.select("shard", "n"), "shard").withColumn("_ws", F.lit(total))
    return (j.groupBy(*keys, "test_id", "class")
            .agg((F.sum(F.col("p") * F.col("n") / F.col("_ws"))).alias("p")))


def _summed(ctx: ShardContexts, shard_sizes: DataFrame) -> DataFrame:
    """M6 of contexts that were not met yet; shards too long for one row go through tables of contexts (they are few)."""
    total = shard_sizes.agg(F.sum("n")).first()[0]
    weights = shard_sizes.select("shard", "n", (F.col("n") / F.lit(total)).alias("w"))
    labels = ctx.train.select(ctx.label_col).where(F.col(ctx.label_col).isNotNull()).distinct()
    classes = sorted(r[0] for r in labels.collect())  # a value for each class
    out = summed_votes(ctx, weights.where(F.col("n") <= SHARD_ROWS), classes)
    long = [r[0] for r in weights.where(F.col("n") > SHARD_ROWS).select("shard").collect()]
    if not long:
        return out
    asked = ctx.test.withColumn(ctx.shard, F.explode(F.array(*[F.lit(x) for x in long])))
    known = ctx.train.where(F.col(ctx.shard).isin(long))
    near = top_k_context(asked, known, ctx.vec_col, ctx.k, [ctx.shard], id_col=ctx.id_col, scale=ctx.scale)
    probs = predict_classes(near, known, ctx.temperature, ctx.label_col, ctx.id_col, [ctx.shard])
    parts = probs.join(weights.select(F.col("shard").alias(ctx.shard), "w"), ctx.shard).select("test_id", "class", (F.col("p") * F.col("w")).alias("p"))
    return out.unionByName(parts).groupBy("test_id", "class").agg(F.sum("p").alias("p"))


def align_classes(probs: DataFrame, classes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """M7: scatter to the global class list, renormalise; all-zero rows become uniform.

    ``classes`` has one row per (keys, class).  Each dataset's class list (at
    most K values) is packed into an array -- joined on the keys, or a literal
    when there is one dataset -- and exploded: a bounded fan-out of K per row.
    """
    keys = list(keys or [])
    rows = probs.select(*keys, "test_id").distinct()
    if keys:
        rows = rows.join(classes.groupBy(*keys).agg(F.collect_set("class").alias("_cls")), keys)
    else:
        rows = rows.withColumn("_cls", class_list(classes, "class"))
    grid = rows.select(*keys, "test_id", F.explode("_cls").alias("class"))
    full = grid.join(probs, [*keys, "test_id", "class"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    w = Window.partitionBy(*keys, "test_id")
    tot = F.sum("p").over(w)
    n_cls = F.count(F.lit(1)).over(w)
    return full.withColumn("p", F.when(tot == 0, F.lit(1.0) / n_cls).otherwise(F.col("p") / tot))


def argmax_class(probs: DataFrame, keys: list[str] | None = None, value: str = "p") -> DataFrame:
    """M8: the most probable class per test row; the lowest class wins ties."""
    keys = list(keys or [])
    return probs.groupBy(*keys, "test_id").agg(
        F.min_by("class", F.struct(-F.col(value), F.col("class"))).alias("pred"),
        F.max(value).alias("p_max"))


def snap_to_category(df: DataFrame, col: str, values: list[float], out: str | None = None) -> DataFrame:
    """M9: replace a value with the nearest known category value (lower wins ties)."""
    vals = sorted(set(float(v) for v in values))
    arr = F.array(*[F.lit(v) for v in vals])
    x = F.col(col).cast("double")
    best = F.array_min(F.transform(arr, lambda v: F.struct(F.abs(v - x).alias("d"), v.alias("v"))))
    return df.withColumn(out or col, F.when(x.isNull(), F.lit(None).cast("double")).otherwise(best["v"]))


def score_with_model(train: DataFrame, test: DataFrame, group_col: str, model_fn,
                     feature_cols: list[str], label_col: str = "y", id_col: str = "row_id",
                     n_classes: int | None = None) -> DataFrame:
    """Run a user model ``fn(X_train, y_train, X_test) -> scores`` per context group.

    Uses a co-grouped ``applyInPandas`` so each group's train and test rows
    meet in one Python worker; output is long ``(group, test_id, class, score)``.
    Groups are bounded by the context length times the cluster size.
    """
    import numpy as np
    import pandas as pd

    schema = T.StructType([T.StructField(group_col, train.schema[group_col].dataType),
                           T.StructField("test_id", T.LongType()), T.StructField("class", T.LongType()),
                           T.StructField("score", T.DoubleType())])

    def run(tr: pd.DataFrame, te: pd.DataFrame) -> pd.DataFrame:
        if te.empty:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        s = np.asarray(model_fn(tr[feature_cols].to_numpy(float), tr[label_col].to_numpy(),
                                te[feature_cols].to_numpy(float)), dtype=float)
        if s.ndim == 1:
            s = s[:, None]
        g = te[group_col].iloc[0]
        k = s.shape[1]
        return pd.DataFrame({group_col: np.repeat(g, len(te) * k),
                             "test_id": np.repeat(te[id_col].to_numpy(np.int64), k),
                             "class": np.tile(np.arange(k, dtype=np.int64), len(te)),
                             "score": s.ravel()})

    # fresh aliases: both sides may descend from one assignment table, and the
    # co-group needs distinct grouping attributes on each side
    def fresh(df, names):
        return df.select(*[F.col(c).alias(c) for c in names])

    cols = [group_col, id_col, label_col, *feature_cols]
    return (fresh(train, cols).groupBy(group_col)
            .cogroup(fresh(test, [group_col, id_col, *feature_cols]).groupBy(group_col))
            .applyInPandas(run, schema))


def undo_class_permutation(probs: DataFrame, perm: list[int]) -> DataFrame:
    """E10 inverse on outputs: permuted class ``perm[c]`` maps back to ``c``."""
    inv = {int(p): c for c, p in enumerate(perm)}
    arr = F.array(*[F.lit(inv[i]) for i in range(len(perm))])
    return probs.withColumn("class", F.element_at(arr, F.col("class").cast("int") + 1))
