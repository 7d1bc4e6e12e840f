"""Evaluation metrics (V1-V9) as aggregations.

Inputs are long tables: predictions ``(test_id, y, pred)`` and probabilities
``(test_id, class, p)``; optional ``keys`` (e.g. ``dataset_id``) compute one
metric row per dataset in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxtab.functions.exprs import class_list
from ctxtab.functions.ranking import prefix_sum


def accuracy(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V1."""
    keys = list(keys or [])
    return pred.groupBy(*keys).agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))


def confusion(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return pred.groupBy(*keys or [], "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def f1(pred: DataFrame, average: str = "macro", pos_label=1, keys: list[str] | None = None) -> DataFrame:
    """V2: binary (``pos_label``) or macro F1 over the union of true and predicted labels.

    Empty denominators count as 0 (sklearn's zero_division=0 behaviour).
    """
    keys = list(keys or [])
    # one scan: every cell of the confusion table counts for its true and for its predicted class
    hit = F.col("y") == F.col("pred")
    sides = F.array(
        F.struct(F.col("y").alias("c"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"),
                 F.lit(0).cast("long").alias("fn")))
    t = (confusion(pred.withColumn("pred", F.col("pred").cast(pred.schema["y"].dataType)), keys)
         .select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
         .groupBy(*keys, "c").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    t = t.withColumn("_f1", F.when(den == 0, F.lit(0.0)).otherwise(2 * F.col("tp") / den))
    if average == "binary":
        return t.filter(F.col("c") == F.lit(pos_label)).groupBy(*keys).agg(F.max("_f1").alias("f1"))
    return t.groupBy(*keys).agg(F.avg("_f1").alias("f1"))


def log_loss(probs: DataFrame, truth: DataFrame, eps: float = 1e-15, keys: list[str] | None = None) -> DataFrame:
    """V3: rows renormalised, probabilities clipped to [eps, 1-eps]."""
    keys = list(keys or [])
    w = Window.partitionBy(*keys, "test_id")
    p = probs.withColumn("_p", F.try_divide(F.col("p"), F.sum("p").over(w)))  # an all-zero row counts as probability 0
    # a true class missing from a row's probabilities counts as probability 0
    j = truth.select(*keys, "test_id", F.col("y").alias("class")).join(
        p.select(*keys, "test_id", "class", "_p"), [*keys, "test_id", "class"], "left") \
        .withColumn("_p", F.coalesce(F.col("_p"), F.lit(0.0)))
    clipped = F.greatest(F.least(F.col("_p"), F.lit(1 - eps)), F.lit(eps))
    return j.groupBy(*keys).agg(F.avg(-F.log(clipped)).alias("logloss"))


def ece(pred: DataFrame, n_bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """V4: bins ``(i/B, (i+1)/B]`` on confidence ``p_max``; sum share x |acc - conf|."""
    keys = list(keys or [])
    edges = [i / n_bins for i in range(n_bins + 1)]  # fixed bin edges, as np.linspace(0, 1, B + 1)
    b = F.lit(None).cast("int")
    for i in range(n_bins - 1, -1, -1):
        b = F.when((F.col("p_max") > F.lit(edges[i])) & (F.col("p_max") <= F.lit(edges[i + 1])), F.lit(i)).otherwise(b)
    d = pred.withColumn("_bin", b)
    per = d.groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.avg((F.col("pred") == F.col("y")).cast("double")).alias("_acc"),
        F.avg("p_max").alias("_conf"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    per = per.withColumn("_n", F.sum("_c").over(w)).filter(F.col("_bin").isNotNull())
    return per.groupBy(*keys).agg(F.sum(F.col("_c") / F.col("_n") * F.abs(F.col("_acc") - F.col("_conf")))
                                  .alias("ece"))


def auc_binary(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V5: ROC AUC of ``score`` for ``label`` 1 vs 0 by the mid-rank (Mann-Whitney) formula.

    Distributed: rows are counted per distinct score (map-side combine),
    then a distributed prefix sum over the distinct scores (range sort by
    keys and score) gives mid-ranks.  NULL when only one label is present.
    """
    keys = list(keys or [])
    g = scores.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col("label").cast("long")).alias("_pos"))
    g = prefix_sum(g, [*keys, "score"], "_c")
    mid = F.col("_before") + (F.col("_c") + 1) / 2.0
    a = g.groupBy(*keys).agg(F.sum(mid * F.col("_pos")).alias("_rs"), F.min("_before").alias("_base"),
                             F.sum("_pos").alias("_np"), F.sum("_c").alias("_n"))
    a = a.withColumn("_rs", F.col("_rs") - F.col("_base") * F.col("_np"))  # ranks start anew for each key
    nn = F.col("_n") - F.col("_np")
    auc = F.try_divide(F.col("_rs") - F.col("_np") * (F.col("_np") + 1) / 2.0, F.col("_np") * nn)
    return a.select(*keys, F.when((F.col("_np") == 0) | (nn == 0), F.lit(None).cast("double"))
                    .otherwise(auc).alias("auc"))


def auc_ovo(probs: DataFrame, truth: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V6: Hand & Till one-vs-one macro AUC over the classes present in ``truth``.

    Mean over ordered class pairs (a, b) of AUC(a vs b scored by p_a) on the
    rows labelled a or b.  Each row fans out to the other K-1 classes of its
    dataset (class list packed per dataset, exploded), twice -- once as the
    positive of (y, o), once as the negative of (o, y).
    """
    keys = list(keys or [])
    t = truth.select(*keys, "test_id", F.col("y").alias("ty"))
    if keys:
        t = t.join(t.groupBy(*keys).agg(F.collect_set("ty").alias("_cls")), keys)
    else:  # one class list: a literal, so that no join on a constant is needed
        t = t.withColumn("_cls", class_list(t, "ty"))
    r = t.select(*keys, "test_id", "ty", F.explode("_cls").alias("o")).filter(F.col("o") != F.col("ty"))
    pos = r.select(*keys, "test_id", F.col("ty").alias("a"), F.col("o").alias("b"), F.lit(1).alias("label"))
    neg = r.select(*keys, "test_id", F.col("o").alias("a"), F.col("ty").alias("b"), F.lit(0).alias("label"))
    rows = pos.unionByName(neg)
    p = probs.select(*keys, "test_id", F.col("class").alias("a"), F.col("p").alias("score"))
    rows = rows.join(p, [*keys, "test_id", "a"], "left").fillna(0.0, ["score"])
    per = auc_binary(rows, [*keys, "a", "b"])
    return per.groupBy(*keys).agg(F.avg("auc").alias("auc_ovo"))


def rmse(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V7."""
    keys = list(keys or [])
    return pred.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("y"), 2))).alias("rmse"))


def r2(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V8: ``1 - SS_res / SS_tot`` in one pass; NULL for a constant target."""
    keys = list(keys or [])
    a = pred.groupBy(*keys).agg(F.sum(F.pow(F.col("pred") - F.col("y"), 2)).alias("_res"),
                                F.var_pop("y").alias("_v"), F.count(F.lit(1)).alias("_n"))
    return a.select(*keys, (F.lit(1.0) - F.try_divide(F.col("_res"), F.col("_v") * F.col("_n"))).alias("r2"))


def imputation_error(truth: DataFrame, imputed: DataFrame, categorical: list[str] | None = None,
                     keys: list[str] | None = None) -> DataFrame:
    """V9: masked cells only; categorical mismatch rate and pooled numeric RMSE."""
    keys = list(keys or [])
    cat = list(categorical or [])
    j = truth.join(imputed, [*keys, "test_id", "feature"], "left")
    is_cat = F.col("feature").isin(cat) if cat else F.lit(False)
    return j.groupBy(*keys).agg(
        F.avg(F.when(is_cat, (F.col("imputed") != F.col("value")).cast("double"))).alias("cat_error"),
        F.sqrt(F.avg(F.when(~is_cat, F.pow(F.col("imputed") - F.col("value"), 2)))).alias("num_rmse"),
        F.count(F.lit(1)).alias("n_cells"))
