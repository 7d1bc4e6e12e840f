"""Queries for projections, filters and validation (C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxtab.functions.exprs import id_hash_sql, r6
from ctxtab.operators import clean, encode
from ctxtab.plans.registry import register
from ctxtab.sources import tables


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@register("c1_to_numeric", """
SELECT p_partkey, try_cast(substr(p_brand, 7) AS DOUBLE) AS brand_num, try_cast(p_type AS DOUBLE) AS type_num
FROM part""")
def c1_to_numeric(spark, sf_dir):
    p = tables.load(spark, sf_dir, "part").select(
        "p_partkey", F.substring("p_brand", 7, 1 << 20).alias("brand_num"), F.col("p_type").alias("type_num"))
    return clean.to_numeric(p, ["brand_num", "type_num"])


@register("c2_coerce_types", """
SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_brand,
       CAST(substr(p_brand, 7) AS DOUBLE) AS brand_no
FROM part""")
def c2_coerce_types(spark, sf_dir):
    p = tables.load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), "p_size", "p_retailprice", "p_brand",
        F.substring("p_brand", 7, 1 << 20).alias("brand_no"))
    out, _ = clean.coerce_types(p, ["p_size", "p_retailprice", "p_brand", "brand_no"])
    return out


@register("c3_inf_to_null", "WITH " + tables.EVX_SQL + """
SELECT row_id, CASE WHEN isnan(xv) OR isinf(xv) THEN NULL ELSE xv END AS xv FROM evx""")
def c3_inf_to_null(spark, sf_dir):
    return clean.inf_to_null(tables.evx(spark, sf_dir).select("row_id", "xv"), ["xv"])


C4_COLS = ["value", "xv", "const", "empty"]


@register("c4_drop_all_null_columns", "WITH " + tables.EVX_SQL + """
SELECT row_id, value, CASE WHEN isnan(xv) OR isinf(xv) THEN NULL ELSE xv END AS xv, const FROM evx""")
def c4_drop_all_null_columns(spark, sf_dir):
    d = clean.inf_to_null(tables.evx(spark, sf_dir).withColumn("empty", F.lit(None).cast("double")), ["xv"])
    out, kept = clean.drop_all_null_columns(d.select("row_id", *C4_COLS), C4_COLS)
    return out.select("row_id", *kept)


C5_COLS = ["value", "user_id", "props_len", "xv", "const", "const_null", "test_null"]


def _c5_sql():
    parts = []
    for c in C5_COLS:
        x = "CASE WHEN isnan(xv) OR isinf(xv) THEN NULL ELSE xv END" if c == "xv" else c
        parts.append(f"""SELECT '{c}' AS feature, count(DISTINCT {x}) AS n_distinct,
  count(*) - count({x}) AS n_missing,
  NOT ((count(*) = count({x}) AND count(DISTINCT {x}) <= 1)
       OR count(CASE WHEN split = 'train' THEN {x} END) = 0
       OR (count(CASE WHEN split = 'test' THEN 1 END) > 0 AND count(CASE WHEN split = 'test' THEN {x} END) = 0))
  AS valid FROM evx""")
    return "WITH " + tables.EVX_SQL + "\n" + _union(parts)


@register("c5_filter_valid_features", _c5_sql())
def c5_filter_valid_features(spark, sf_dir):
    return clean.feature_validity(tables.evx(spark, sf_dir), C5_COLS)


C6_COLS = ["l_quantity", "l_discount", "l_tax", "l_linestatus"]


@register("c6_detect_categorical", "WITH " + tables.LINE_SQL + "\n" + _union(
    [f"SELECT '{c}' AS feature, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct, "
     f"count(*) >= 100 AND count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) < 4 AS is_categorical "
     f"FROM line" for c in C6_COLS]))
def c6_detect_categorical(spark, sf_dir):
    return clean.detect_categorical(tables.line(spark, sf_dir), C6_COLS)


def line_relevance(spark, sf_dir):
    """Q2 stand-in: |corr(feature, class code)| on train rows, softmax-normalised."""
    from ctxtab.operators.scale import feature_relevance
    d, _ = encode.label_encode(tables.line(spark, sf_dir))
    return feature_relevance(d.filter("split = 'train'"), tables.LINE_FEATURES, "y_code")


RELEVANCE_SQL = tables.LINE_SQL + """,
codes AS (SELECT y, CAST(row_number() OVER (ORDER BY y) - 1 AS INTEGER) AS y_code
          FROM (SELECT DISTINCT y FROM line WHERE split = 'train')),
tr AS (SELECT l.*, c.y_code FROM line l JOIN codes c ON l.y = c.y WHERE l.split = 'train'),
cr AS (""" + _union([f"SELECT '{c}' AS feature, abs(coalesce(corr({c}, y_code), 0)) AS r FROM tr"
                      for c in tables.LINE_FEATURES]) + """),
rel0 AS (SELECT feature, exp(r - max(r) OVER ()) AS e FROM cr),
rel AS (SELECT feature, e / sum(e) OVER () AS relevance FROM rel0)"""


@register("c8_select_features_by_relevance", "WITH " + RELEVANCE_SQL + """
SELECT feature, round(relevance, 6) AS relevance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY relevance DESC, feature) AS rank FROM rel) WHERE rank <= 2""")
def c8_select_features_by_relevance(spark, sf_dir):
    from ctxtab.operators.scale import select_by_relevance
    return select_by_relevance(line_relevance(spark, sf_dir), 2).select(
        "feature", r6("relevance", "relevance"), "rank")


@register("c9_fill_missing", "WITH " + tables.EVX_SQL + """
SELECT row_id, coalesce(value, 0) AS value,
       coalesce(CASE WHEN isnan(xv) OR isinf(xv) THEN NULL ELSE xv END, 0) AS xv,
       coalesce(y, 'missing') AS y FROM evx""")
def c9_fill_missing(spark, sf_dir):
    return clean.fill_missing(tables.evx(spark, sf_dir).select("row_id", "value", "xv", "y"), ["value", "xv", "y"])


C10_SQL = tables.DOC_SQL + """,
d2 AS (SELECT *, CAST(CAST(n_chars AS BIGINT) AS VARCHAR) AS nchar_s FROM doc),
lg AS (SELECT split, 'lang' AS feature, lang AS value FROM d2 UNION ALL
       SELECT split, 'source', source FROM d2 UNION ALL SELECT split, 'nchar_s', nchar_s FROM d2),
un AS (SELECT feature, count(*) AS n_unseen FROM (
         SELECT DISTINCT feature, value FROM lg WHERE split = 'test'
         EXCEPT SELECT DISTINCT feature, value FROM lg WHERE split = 'train') GROUP BY feature),
kept AS (SELECT f.feature FROM (SELECT DISTINCT feature FROM lg) f LEFT JOIN un ON f.feature = un.feature
         WHERE coalesce(n_unseen, 0) = 0),
codes AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code
          FROM (SELECT DISTINCT feature, value FROM lg WHERE split = 'train' AND value IS NOT NULL)),
cells AS (SELECT row_id, 'lang' AS feature, lang AS value FROM d2 UNION ALL
          SELECT row_id, 'source', source FROM d2 UNION ALL SELECT row_id, 'nchar_s', nchar_s FROM d2)
SELECT c.row_id, c.feature, CAST(codes.code AS INTEGER) AS code
FROM cells c JOIN kept k ON c.feature = k.feature LEFT JOIN codes ON c.feature = codes.feature AND c.value = codes.value"""


@register("c10_encode_or_drop", "WITH " + C10_SQL)
def c10_encode_or_drop(spark, sf_dir):
    """Codes of the columns that are kept, in long form (which ones are kept depends on the data)."""
    cols = ["lang", "source", "nchar_s"]
    d = tables.doc(spark, sf_dir).withColumn("nchar_s", F.col("n_chars").cast("long").cast("string"))
    out, kept = clean.encode_or_drop(d.select("row_id", "split", *cols), cols)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("code")) for c in kept])
    return out.select("row_id", F.explode(cells).alias("c")).select("row_id", "c.feature", "c.code")


SUITE_SPLIT_SQL = f"CASE WHEN {id_hash_sql('c_custkey')} % 5 = 0 THEN 'test' ELSE 'train' END"


def cust_suite_split(spark, sf_dir):
    from ctxtab.functions.exprs import id_hash
    s = tables.cust_suite(spark, sf_dir)
    return s.withColumn("split", F.when(F.pmod(id_hash("row_id"), F.lit(5)) == 0, "test").otherwise("train"))


@register("c12_eligible_datasets", f"""
SELECT CAST(c_nationkey AS BIGINT) AS dataset_id, count(DISTINCT c_mktsegment) AS n_classes,
       count(CASE WHEN {SUITE_SPLIT_SQL} = 'train' THEN 1 END) AS n_train
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1
HAVING count(DISTINCT c_mktsegment) BETWEEN 2 AND 10
   AND count(CASE WHEN {SUITE_SPLIT_SQL} = 'train' THEN 1 END) >= 2
   AND count(CASE WHEN {SUITE_SPLIT_SQL} = 'train' THEN 1 END) < 48""")
def c12_eligible_datasets(spark, sf_dir):
    return clean.eligible_datasets(cust_suite_split(spark, sf_dir), ["dataset_id"], max_train_rows=48)
