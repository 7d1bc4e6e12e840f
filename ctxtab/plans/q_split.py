"""Queries for splits and sampling (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxtab.functions.exprs import id_hash, id_hash_sql
from ctxtab.operators import split
from ctxtab.plans.registry import register
from ctxtab.sources import tables


@register("p1_stratified_split", "WITH " + tables.CUST_SQL + "\nSELECT row_id, y, split FROM cust")
def p1_stratified_split(spark, sf_dir):
    return tables.cust(spark, sf_dir).select("row_id", "y", "split")


@register("p2_plain_split", f"""
SELECT o_orderkey AS row_id,
       CASE WHEN row_number() OVER (ORDER BY {id_hash_sql('o_orderkey')}, o_orderkey) <= ceil(0.2 * count(*) OVER ())
            THEN 'test' ELSE 'train' END AS split
FROM orders""")
def p2_plain_split(spark, sf_dir):
    o = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return split.plain_split(o)


@register("p3_apply_fold", f"""
SELECT c_custkey AS row_id, CASE WHEN {id_hash_sql('c_custkey', 9)} % 5 = 2 THEN 'test' ELSE 'train' END AS split
FROM customer""")
def p3_apply_fold(spark, sf_dir):
    c = tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"))
    folds = c.select("row_id", F.lit(0).alias("repeat"), F.pmod(id_hash("row_id", 9), F.lit(5)).alias("fold"))
    return split.apply_fold(c, folds, repeat=0, fold=2)


@register("p4_stratified_shards", "WITH " + tables.CUST_SQL + f""",
tr AS (SELECT * FROM cust WHERE split = 'train'),
ns AS (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS s FROM tr)
SELECT row_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {id_hash_sql('row_id')}, row_id) - 1) % s AS INTEGER)
       AS shard
FROM tr, ns""")
def p4_stratified_shards(spark, sf_dir):
    tr = tables.cust(spark, sf_dir).filter("split = 'train'").select("row_id", "y")
    return split.stratified_shards(tr, 100)


P5_COLS = ["value", "user_id", "props_len"]


@register("p5_mask_cells", "WITH " + tables.EV_SQL + """,
cells AS (SELECT row_id, 'value' AS feature, value FROM ev UNION ALL
          SELECT row_id, 'user_id', user_id FROM ev UNION ALL
          SELECT row_id, 'props_len', props_len FROM ev),
c2 AS (SELECT *, row_id * 3 + CASE feature WHEN 'value' THEN 0 WHEN 'user_id' THEN 1 ELSE 2 END AS cid
       FROM cells WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY """ + id_hash_sql("cid", 7) + """, cid) AS rk, count(*) OVER () AS n FROM c2),
h AS (SELECT row_id, feature, value, rk <= floor(0.3 * n) AS hidden FROM r)
SELECT ev.row_id, """ + ", ".join(
    f"max(CASE WHEN feature = '{c}' AND NOT hidden THEN h.value END) AS {c}, "
    f"max(CASE WHEN feature = '{c}' AND hidden THEN h.value END) AS true_{c}" for c in P5_COLS) + """
FROM ev LEFT JOIN h ON ev.row_id = h.row_id GROUP BY ev.row_id""")
def p5_mask_cells(spark, sf_dir):
    """The masked table, and beside it the values that were hidden."""
    d = tables.ev(spark, sf_dir).select("row_id", *P5_COLS)
    masked, truth = split.mask_cells(d, P5_COLS, 0.3)
    hidden = truth.groupBy("row_id").agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"true_{c}") for c in P5_COLS])
    return masked.join(hidden, "row_id", "left").select("row_id", *[x for c in P5_COLS for x in (c, f"true_{c}")])
