"""The ensemble executor: member settings -> ordered steps -> context -> class probabilities -> average.

A member is a dict: ``scale`` (``standard``, ``minmax`` or none), ``polynomial`` (number of
interaction columns, 0 for none), ``order`` (feature order: ``shuffle``, ``rotate`` or none),
``permute`` (class permutation or not) and ``k`` (context length).  Each member is a chain of
DataFrame operators of this package; its output comes back in the original classes before the
average.  Members with rebalancing steps in JSON form go through ``rebalanced_ensemble``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxtab.operators import clean, encode, predict, rebalance, retrieve
from ctxtab.operators.meta import PipelineSpec, shuffle_features
from ctxtab.operators.scale import mean_impute, min_max_scale, standard_scale
from ctxtab.session import cut_lineage

CONTEXT = 200
SCALERS = {"standard": standard_scale, "minmax": min_max_scale, None: lambda df, cols: df}


def member_table(df: DataFrame, features: Sequence[str], member: dict, seed: int) -> tuple[DataFrame, list[str]]:
    """Model table of one member: valid features, mean fill, interactions, scaling, feature order."""
    df, cols, _ = clean.filter_valid_features(df, list(features))
    df = mean_impute(df, cols)
    if member.get("polynomial"):
        pairs = encode.interaction_pairs(len(cols))[:member["polynomial"]]
        extra = {f"x_{cols[a]}_{cols[b]}": F.col(cols[a]) * F.col(cols[b]) for a, b in pairs}
        df, cols = df.withColumns(extra), cols + list(extra)
    df = SCALERS[member.get("scale")](df, cols)
    order, _ = shuffle_features(cols, [], member.get("order"), member.get("offset", 0), seed)
    return df, order


def member_probs(df: DataFrame, features: Sequence[str], member: dict, perm: list[int] | None, temperature: float, seed: int) -> DataFrame:
    """(test_id, class code, p) of one member, class permutation undone."""
    return table_probs(*member_table(df, features, member, seed), member["k"], perm, temperature)


def table_probs(table: DataFrame, order: Sequence[str], k: int, perm: list[int] | None, temperature: float) -> DataFrame:
    """(test_id, class code, p) from the ``k`` best train rows over the features ``order``, class permutation undone.

    A missing feature counts as 0.
    """
    table = table.withColumn("v", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in order]))
    label = "y_code"
    if perm is not None:
        table, label = encode.apply_class_permutation(table, perm), "y_perm"
    test, train = table.where("split = 'test'"), table.where("split = 'train'")
    ctx = retrieve.top_k_context(test, train, "v", k, votes=True)
    probs = predict.predict_classes(ctx, train, temperature, label_col=label)
    return predict.undo_class_permutation(probs, perm) if perm is not None else probs


def ensemble(df: DataFrame, features: Sequence[str], spec: PipelineSpec) -> DataFrame:
    """(test_id, class code, p): the members' mean for a table with row_id, y_code, split and ``features``."""
    n_classes = df.where("split = 'train'").agg(F.max("y_code")).first()[0] + 1
    perms = encode.class_permutations(n_classes, len(spec.members), spec.seed)
    parts = [member_probs(df, features, m, perms[i] if m.get("permute") else None, spec.softmax_temperature, spec.seed + i)
             .select("test_id", F.col("class").cast("int").alias("class"), "p").withColumn("member", F.lit(i)) for i, m in enumerate(spec.members)]
    return _averaged(parts)


def _averaged(parts: list[DataFrame]) -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return predict.ensemble_average(both, n_members=len(parts))


def rebalanced_ensemble(df: DataFrame, features: Sequence[str], categorical: Sequence[str], spec: PipelineSpec) -> DataFrame:
    """(test_id, class code, p): the mean of members with rebalancing steps (see ``rebalance``).

    Contexts are as long as each member's ``retrieval_config.retrieval_len`` says (a count, a fraction of
    the train rows, or "dynamic"); a member that does not say so takes the ``CONTEXT`` best train rows.
    """
    stats = df.where("split = 'train'").agg(F.max("y_code"), F.count(F.lit(1))).first()
    n_classes, n_train = stats[0] + 1, stats[1]
    perms = encode.class_permutations(n_classes, len(spec.members), spec.seed)
    tables = rebalance.member_tables(df, list(features), list(categorical), spec.members, spec.seed)
    parts = []
    for i, (m, (table, order)) in enumerate(zip(spec.members, tables)):
        rc = m.get("retrieval_config") or {}
        k = retrieve.context_length(n_train, n_classes, rc["retrieval_len"], rc.get("dynamic_ratio")) if "retrieval_len" in rc else CONTEXT
        parts.append(table_probs(table, order, k, perms[i], spec.softmax_temperature)
                     .select("test_id", F.col("class").cast("int").alias("class"), "p").withColumn("member", F.lit(i)))
    return _averaged(parts)


def score_by_group(test: DataFrame, train: DataFrame, assignment: DataFrame, ctx: DataFrame, vec_col: str, k: int, max_classes: int,
                   temperature: float = 0.9, classes: list | None = None, label_col: str = "y", id_col: str = "row_id") -> DataFrame:
    """Q10: class probabilities of test rows scored cluster by cluster, in one job for all clusters.

    ``assignment`` is (test_id, cluster_id) and ``ctx`` the test rows' contexts (test_id, train_id): a
    cluster's train rows are the union of its members' contexts, cut to its ``max_classes`` most
    frequent classes and relabelled 0..n-1 inside the cluster.  Scores come back in the original
    classes: as (cluster_id, test_id, class, p) of the classes that a row's context holds, or, with
    the global list ``classes``, of every class (p = 0 where the cluster does not know it).
    """
    known_ids, asked_ids = retrieve.cluster_contexts(ctx, assignment)
    # kept: counts, packing, votes and names read them, and each would find all contexts once more
    known_ids = cut_lineage(known_ids)
    known = (known_ids.join(train.select(F.col(id_col).alias("train_id"), F.col(label_col).alias("ctx_y"), vec_col), "train_id")
             .withColumnRenamed("train_id", "row_id"))
    known = encode.limit_classes(known, max_classes, "ctx_y", keys=["cluster_id"])
    known = cut_lineage(encode.local_relabel(known, group="cluster_id"))
    asked = cut_lineage(asked_ids.join(test.select(F.col(id_col).alias("test_id"), vec_col), "test_id").withColumnRenamed("test_id", "row_id"))
    near = retrieve.top_k_context(asked, known, vec_col, k, keys=["cluster_id"])
    local = predict.predict_classes(near, known, temperature, label_col="local_y", keys=["cluster_id"])
    if classes is None:
        names = known.groupBy("cluster_id", F.col("local_y").alias("class")).agg(F.first("ctx_y").alias("_y"))
        return local.join(names, ["cluster_id", "class"]).select("cluster_id", "test_id", F.col("_y").alias("class"), "p")
    scores = local.select("cluster_id", "test_id", F.col("class").alias("local_y"), F.log("p").alias("score"))
    spread = encode.local_relabel_inverse(scores, known, classes, "cluster_id", rows=["test_id"])
    return spread.select("cluster_id", "test_id", "class", F.exp("score").alias("p"))
