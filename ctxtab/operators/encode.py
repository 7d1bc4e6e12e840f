"""Encoders and generated features.

Dictionaries are DataFrames ``(value, code)`` built from one distinct pass
and joined back per column (up to ``BROADCAST_VALUES`` values by broadcast, as
rows shuffled on a column of few values would meet in as many tasks; longer
ones shuffle-join).  Nothing row-level reaches the driver.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.functions.exprs import id_hash
from ctxtab.functions.ranking import global_index, prefix_sum

MISSING = "__MISSING__"
BROADCAST_VALUES = 100_000


def _is_num(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                                              T.FloatType, T.DoubleType, T.DecimalType))


def _sort_key(df: DataFrame, c: str):
    return F.col(c).cast("double") if _is_num(df, c) else F.col(c).cast("string")


def dictionary(df: DataFrame, c: str, order: str = "sorted", id_col: str = "row_id",
               missing_token: str | None = None) -> DataFrame:
    """Dictionary ``(value, code)`` for one column over the given rows.

    ``order='sorted'`` numbers values in sort order; ``'first'`` by first
    appearance (smallest row id).  ``missing_token`` makes NULL a value.
    """
    v = F.col(c)
    if missing_token is not None:
        v = F.coalesce(v.cast("string"), F.lit(missing_token))
    d = df.select(v.alias("value"), F.col(id_col).alias("_id")).filter(F.col("value").isNotNull())
    if order == "first":
        d = d.groupBy("value").agg(F.min("_id").alias("_first"))
        keys = ["_first"]
    else:
        d = d.select("value").distinct()
        key = F.col("value").cast("double") if (_is_num(df, c) and missing_token is None) else F.col("value")
        d = d.withColumn("_k", key)
        keys = ["_k", "value"]
    return global_index(d, keys, "code").select("value", F.col("code").cast("int").alias("code"))


def _apply_dict(df: DataFrame, c: str, dic: DataFrame, unseen, missing_token: str | None,
                out: str | None = None) -> DataFrame:
    out = out or c
    key = F.coalesce(F.col(c).cast("string"), F.lit(missing_token)) if missing_token is not None \
        else F.col(c).cast(dic.schema["value"].dataType)
    dic = dic.withColumnRenamed("value", "_key").withColumnRenamed("code", "_code")
    if dic.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:  # its values are written already
        dic = F.broadcast(dic)
    j = df.withColumn("_key", key).join(dic, "_key", "left")
    res = F.col("_code")
    if unseen is not None:
        res = F.when(F.col("_key").isNotNull() & F.col("_code").isNull(), F.lit(unseen)).otherwise(res)
    return j.withColumn(out, res.cast("int")).drop("_key", "_code")


def ordinal_encode(df: DataFrame, cols: list[str], split: str = "split", fit_on: str = "all",
                   id_col: str = "row_id") -> DataFrame:
    """Codes by sorted distinct value; unseen and missing stay missing.

    Encoded columns move to the front, the remaining columns follow.
    """
    fit = df if fit_on == "all" else df.filter(F.col(split) == "train")
    out = df
    for c in cols:
        out = _apply_dict(out, c, dictionary(fit, c, id_col=id_col), None, None)
    return out.select(*cols, *[x for x in df.columns if x not in cols])


def ordinal_encode_train(df: DataFrame, cols: list[str], split: str = "split", id_col: str = "row_id",
                         missing_token: str | None = MISSING) -> DataFrame:
    """Dictionary from train rows, NULL is a value (``__MISSING__``), unseen test = -1."""
    fit = df.filter(F.col(split) == "train")
    out = df
    for c in cols:
        out = _apply_dict(out, c, dictionary(fit, c, id_col=id_col, missing_token=missing_token), -1,
                          missing_token)
    return out


def codes_by_first_appearance(df: DataFrame, cols: list[str], split: str = "split",
                              id_col: str = "row_id") -> DataFrame:
    """code = order of first appearance in train (by row id); unseen/missing = -1."""
    fit = df.filter(F.col(split) == "train")
    out = df
    for c in cols:
        out = _apply_dict(out, c, dictionary(fit, c, order="first", id_col=id_col), -1, None)
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(-1)))
    return out


def codes_full(df: DataFrame, cols: list[str], id_col: str = "row_id") -> DataFrame:
    """Sorted codes over all rows; missing or empty string = -1."""
    out = df
    for c in cols:
        clean = df.withColumn(c, F.when(F.col(c).cast("string") == "", None).otherwise(F.col(c)))
        dic = dictionary(clean, c, id_col=id_col)
        out = _apply_dict(out.withColumn(c, F.when(F.col(c).cast("string") == "", None).otherwise(F.col(c))),
                          c, dic, -1, None)
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(-1)))
    return out


def label_encode(df: DataFrame, y: str = "y", split: str = "split", id_col: str = "row_id",
                 fit_on: str = "train") -> tuple[DataFrame, DataFrame]:
    """E5: sorted class codes from train; returns ``(df + y_code, classes(value, code))``.

    The inverse is a join of ``classes`` on ``code``."""
    fit = df.filter(F.col(split) == "train") if fit_on == "train" else df
    classes = dictionary(fit, y, id_col=id_col)
    return _apply_dict(df, y, classes, -1, None, out="y_code"), classes


def category_gate(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, rarest value count, distinct count and both gate decisions.

    ``gate``: rarest count >= 10; ``gate_strict``: also distinct < rows // 10.
    Counts per (feature, value) in long form; missing counts as one value.
    """
    from ctxtab.operators.clean import long_cells
    long = long_cells(df, cols).withColumn("value", F.coalesce("value", F.lit("\u0000null")))
    per = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_c"))
    st = per.groupBy("feature").agg(F.min("_c").alias("min_count"), F.count(F.lit(1)).alias("n_distinct"),
                                    F.sum("_c").alias("n_rows"))
    return st.select("feature", "min_count", "n_distinct",
                     (F.col("min_count") >= 10).alias("gate"),
                     ((F.col("min_count") >= 10)
                      & (F.col("n_distinct") < F.floor(F.col("n_rows") / 10))).alias("gate_strict"))


def shuffle_codes(df: DataFrame, cols: list[str], seed: int = 0, id_col: str = "row_id") -> DataFrame:
    """Seeded permutation of each column's codes (E1 then permute).

    The permutation orders codes by a salted hash of the code, computed on
    the dictionary (K rows per column)."""
    out = df
    for i, c in enumerate(cols):
        dic = dictionary(df, c, id_col=id_col)
        perm = global_index(dic.withColumn("_h", id_hash("code", 1000 + 17 * seed + i)), ["_h", "code"], "_pc")
        perm = perm.select("value", F.col("_pc").cast("int").alias("code"))
        out = _apply_dict(out, c, perm, None, None)
    return out


def one_hot(df: DataFrame, cols: list[str]) -> DataFrame:
    """One indicator per level; binary columns keep only the second level;
    NULL is its own level; unseen values give all zeros.

    The level lists are metadata from a distinct pass: they become column names.
    """
    levels = {}
    for c in cols:
        vals = [r[0] for r in df.select(F.col(c).cast("string")).distinct().collect()]
        nn = sorted(v for v in vals if v is not None)
        lv = nn + ([None] if None in vals else [])
        levels[c] = lv[1:] if len(lv) == 2 else lv
    out = []
    for c in cols:
        for v in levels[c]:
            cond = F.col(c).isNull() if v is None else (F.col(c).cast("string") == F.lit(v))
            name = f"{c}__{'nan' if v is None else v}"
            out.append(F.when(cond, 1.0).otherwise(0.0).alias(name))
    return df.select(*out, *[x for x in df.columns if x not in cols])


def class_permutations(n_classes: int, n_members: int, seed: int = 0, factor: int = 3) -> list[list[int]]:
    """E10 (driver metadata): one class order for each member.

    The pool is what remains of ``factor`` draws a member once repeated orders are dropped; every
    order of the pool serves equally often and seeded extra picks fill up.
    """
    rnd = random.Random(seed)
    pool = sorted({tuple(rnd.sample(range(n_classes), n_classes)) for _ in range(factor * n_members)})
    each, spare = divmod(n_members, len(pool))
    return [list(order) for order in pool * each + rnd.choices(pool, k=spare)]


def apply_class_permutation(df: DataFrame, perm: list[int], y: str = "y_code", out: str = "y_perm") -> DataFrame:
    arr = F.array(*[F.lit(int(p)) for p in perm])
    return df.withColumn(out, F.element_at(arr, F.col(y).cast("int") + 1))


def limit_classes(df: DataFrame, n: int, y: str = "y", keys: list[str] | None = None) -> DataFrame:
    """Keep rows of the ``n`` most frequent classes (ties: lowest label)."""
    keys = list(keys or [])
    cnt = df.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.col("_c").desc(), F.col(y))
    top = cnt.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select(*keys, y)
    return df.join(top, [*keys, y], "left_semi")


def local_relabel(ctx: DataFrame, group: str = "test_id", y: str = "ctx_y") -> DataFrame:
    """Compress labels inside each context group to ``0..k-1`` (sorted)."""
    w = Window.partitionBy(group).orderBy(y)
    return ctx.withColumn("local_y", (F.dense_rank().over(w) - 1).cast("int"))


def local_relabel_inverse(scores: DataFrame, mapping: DataFrame, classes: list, group: str = "test_id",
                          y: str = "ctx_y", rows: list[str] | None = None) -> DataFrame:
    """E12 inverse: scatter local scores to the global class list (driver metadata, K values).

    ``scores`` has ``group``, the columns ``rows`` that name a scored row inside its group (none if the
    group is the row), ``local_y`` and ``score``; ``mapping`` is what :func:`local_relabel` returned.
    Classes that a group does not know get -inf.  Scores are evaluated once: a row's few scores
    become a map, which is read for every class.
    """
    names = mapping.groupBy(group, "local_y").agg(F.first(y).alias("class"))
    held = (scores.join(names, [group, "local_y"]).groupBy(group, *(rows or []))
            .agg(F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("_known")))
    every = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    return (held.select(group, *(rows or []), "_known", every)
            .withColumn("score", F.coalesce(F.element_at("_known", F.col("class")), F.lit(float("-inf")))).drop("_known"))


def target_rank(df: DataFrame, c: str, split: str = "split", out: str | None = None,
                id_col: str = "row_id") -> DataFrame:
    """Value -> number of distinct train values strictly below it.

    Only distinct values are sorted (one range shuffle and a distributed prefix
    sum of train marks); rows get their value's rank by an equi-join.
    """
    out = out or f"{c}_rank"
    rows = df.withColumn("_v", F.col(c).cast("double"))
    values = (rows.filter(F.col("_v").isNotNull()).groupBy("_v")
              .agg(F.max((F.col(split) == "train").cast("long")).alias("_seen")))
    ranked = prefix_sum(values, ["_v"], "_seen", "_r").select("_v", F.col("_r").alias(out))
    return rows.drop(*[x for x in [out] if x in df.columns]).join(ranked, "_v", "left").drop("_v")


def _mod_1e12_of_hex(h: F.Column) -> F.Column:
    """``int(hex, 16) % 10**12`` by Horner's rule over 16-bit chunks (stays in BIGINT)."""
    acc = F.lit(0).cast("long")
    for i in range(16):
        chunk = F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("long")
        acc = F.pmod(acc * F.lit(65536) + chunk, F.lit(10 ** 12))
    return acc


def row_fingerprint(df: DataFrame, cols: list[str], salt: int = 0, id_col: str = "row_id",
                    out: str = "fingerprint", code_col: str | None = None) -> DataFrame:
    """Salted SHA-256 of the row's canonical text, mod 1e12, / 1e12.

    Duplicate rows get an increment ``k = 0, 1, ...`` (by row id) that is
    added to the salt, so copies receive distinct fingerprints.  The window
    partitions by the row digest, so only true duplicates share a task.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])
    d = df.withColumn("_txt", text).withColumn("_dig", F.sha2(F.col("_txt"), 256))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("_dig").orderBy(id_col)) - 1)
    h = F.sha2(F.concat(F.col("_txt"), F.lit("|"), (F.lit(salt) + F.col("_k")).cast("string")), 256)
    d = d.withColumn("_code", _mod_1e12_of_hex(h)).withColumn(out, F.col("_code") / F.lit(1e12))
    if code_col:
        d = d.withColumnRenamed("_code", code_col)
    return d.drop("_txt", "_dig", "_k", "_code")


def interaction_pairs(n_features: int, max_pairs: int = 100, seed: int = 0) -> list[tuple[int, int]]:
    """E15 (driver metadata): up to ``max_pairs`` distinct random pairs a <= b (squares included)."""
    allp = [(a, b) for a in range(n_features) for b in range(a, n_features)]
    if len(allp) <= max_pairs:
        return allp
    rng = np.random.default_rng(seed)
    idx = sorted(rng.choice(len(allp), size=max_pairs, replace=False).tolist())
    return [allp[i] for i in idx]


def polynomial_interactions(df: DataFrame, cols: list[str], max_pairs: int = 100, seed: int = 0,
                            split: str = "split") -> DataFrame:
    """Divide by population std (no centering; 0 -> 1), append pair products."""
    st = df.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first()
    sd = {c: (st[c] if st[c] else 1.0) for c in cols}
    scaled = {c: F.col(c) / F.lit(float(sd[c])) for c in cols}
    prods = [(scaled[cols[a]] * scaled[cols[b]]).alias(f"{cols[a]}_x_{cols[b]}")
             for a, b in interaction_pairs(len(cols), max_pairs, seed)]
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, *[scaled[c].alias(c) for c in cols], *prods)


def rbf_basis(df: DataFrame, c: str, n_centers: int = 11, lo: float = 0.0, hi: float = 10.0,
              sigma: float = 1.05) -> DataFrame:
    """Sign, decimal exponent, mantissa and Gaussian kernels of the mantissa
    at evenly spaced centres on ``[lo, hi]``."""
    x = F.col(c).cast("double")
    ax = F.abs(x)
    expo = F.when(ax > 0, F.floor(F.log10(ax))).otherwise(F.lit(0)).cast("long")
    mant = F.when(ax > 0, ax / F.pow(F.lit(10.0), expo)).otherwise(F.lit(0.0))
    centers = [lo + (hi - lo) * i / (n_centers - 1) for i in range(n_centers)]
    d = df.withColumn(f"{c}_sign", F.signum(x)).withColumn(f"{c}_exp", expo).withColumn(f"{c}_mant", mant)
    return d.withColumns({f"{c}_rbf{i}": F.exp(-F.pow(F.col(f"{c}_mant") - F.lit(ct), 2) / F.lit(2 * sigma * sigma))
                          for i, ct in enumerate(centers)})


def missing_indicator(df: DataFrame, cols: list[str], split: str = "split") -> DataFrame:
    """Fill with the train mean of finite values; indicator -2 missing,
    2 for +Inf, 4 for -Inf, 0 otherwise."""
    from ctxtab.functions.exprs import nonfinite_to_null
    means = df.filter(F.col(split) == "train").agg(*[F.avg(nonfinite_to_null(c)).alias(c) for c in cols]).first()
    out = {}
    for c in cols:
        x = F.col(c).cast("double")
        m = F.lit(float(means[c]) if means[c] is not None else 0.0)
        out[f"{c}_ind"] = (F.when(x.isNull() | F.isnan(x), F.lit(-2.0)).when(x == F.lit(float("inf")), F.lit(2.0))
                           .when(x == F.lit(float("-inf")), F.lit(4.0)).otherwise(F.lit(0.0)))
        out[c] = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), m).otherwise(x)
    return df.withColumns(out)
