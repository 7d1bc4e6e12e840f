"""Driver tables and the labelled task tables derived from them.

A task table is ``(row_id BIGINT, split STRING, <features>, y)``; every
operator is keyed by ``row_id`` (plus ``dataset_id`` for suites).  Each
builder has an SQL twin used by the independent oracle check.

A task table is scanned many times by one query (test side, train side,
truth, fit statistics), so the split table is kept once (memory and disk,
recomputed from lineage if a block is lost) instead of re-deriving the
split from the source scan every time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxtab.functions.exprs import id_hash, id_hash_sql
from ctxtab.functions.ranking import global_index
from ctxtab.operators.split import stratified_split
from ctxtab.session import reuse

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _split_sql(y: str, rid: str, frac: float = 0.2) -> str:
    return (f"CASE WHEN row_number() OVER (PARTITION BY {y} ORDER BY {id_hash_sql(rid)}, {rid}) "
            f"<= ceil({frac} * count(*) OVER (PARTITION BY {y})) THEN 'test' ELSE 'train' END")


# ---------------------------------------------------------------- vec
def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors (64 floats) labelled with one of 10 classes."""
    df = (load(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull())
          .select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("emb"),
                  F.col("label").alias("y")))
    return reuse(stratified_split(df))


VEC_SQL = f"""vec AS (
  SELECT vec_id AS row_id, embedding AS emb, label AS y, {_split_sql('label', 'vec_id')} AS split
  FROM embeddings WHERE label IS NOT NULL)"""


# ---------------------------------------------------------------- line
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: four numeric features, line status; target return flag."""
    li = load(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isNotNull())
    # (l_orderkey, l_linenumber) is not unique in the driver tables: the row id is
    # the position in the order of all key and value columns (distributed index)
    li = global_index(li, LINE_ORDER, "row_id", keep=[*LINE_FEATURES, "l_linestatus", "l_returnflag"])
    df = li.select("row_id", *LINE_FEATURES, "l_linestatus", F.col("l_returnflag").alias("y"))
    return reuse(stratified_split(df))


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

LINE_SQL = f"""li AS (
  SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS row_id, *
  FROM lineitem WHERE l_returnflag IS NOT NULL),
line AS (
  SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_returnflag AS y,
         {_split_sql('l_returnflag', 'row_id')} AS split
  FROM li)"""


# ---------------------------------------------------------------- cust
def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation region; target market segment (5 classes)."""
    c = load(spark, sf_dir, "customer")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    df = (c.filter(F.col("c_mktsegment").isNotNull())
          .join(n, c.c_nationkey == n.n_nationkey, "left")
          .select(F.col("c_custkey").alias("row_id"), "c_acctbal",
                  F.col("c_nationkey").cast("double").alias("c_nationkey"),
                  F.col("n_regionkey").cast("double").alias("n_regionkey"),
                  F.col("c_mktsegment").alias("y")))
    return reuse(stratified_split(df))


CUST_SQL = f"""cust AS (
  SELECT c_custkey AS row_id, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
         CAST(n_regionkey AS DOUBLE) AS n_regionkey, c_mktsegment AS y,
         {_split_sql('c_mktsegment', 'c_custkey')} AS split
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  WHERE c_mktsegment IS NOT NULL)"""


# ---------------------------------------------------------------- ev
def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events; every tenth value (by id hash) is treated as missing."""
    e = load(spark, sf_dir, "events").filter(F.col("event_type").isNotNull())
    df = e.select(F.col("event_id").alias("row_id"),
                  F.when(F.pmod(id_hash("event_id", 3), F.lit(10)) == 0, F.lit(None).cast("double"))
                  .otherwise(F.col("value")).alias("value"),
                  F.col("user_id").cast("double").alias("user_id"),
                  F.length("props").cast("double").alias("props_len"),
                  F.col("event_type").alias("y"))
    return reuse(stratified_split(df))


EV_SQL = f"""ev AS (
  SELECT event_id AS row_id,
         CASE WHEN {id_hash_sql('event_id', 3)} % 10 = 0 THEN NULL ELSE value END AS value,
         CAST(user_id AS DOUBLE) AS user_id, CAST(length(props) AS DOUBLE) AS props_len,
         event_type AS y, {_split_sql('event_type', 'event_id')} AS split
  FROM events WHERE event_type IS NOT NULL)"""


# ---------------------------------------------------------------- ord
def ord_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: priority and status categories; regression target total price."""
    o = load(spark, sf_dir, "orders").filter(F.col("o_totalprice").isNotNull())
    df = o.select(F.col("o_orderkey").alias("row_id"), "o_orderpriority", "o_orderstatus",
                  F.col("o_custkey").cast("double").alias("o_custkey"),
                  F.col("o_totalprice").alias("y"))
    return reuse(stratified_split(df.withColumn("_s", F.col("o_orderstatus")), y="_s").drop("_s"))


ORD_SQL = f"""ord AS (
  SELECT o_orderkey AS row_id, o_orderpriority, o_orderstatus, CAST(o_custkey AS DOUBLE) AS o_custkey,
         o_totalprice AS y, {_split_sql('o_orderstatus', 'o_orderkey')} AS split
  FROM orders WHERE o_totalprice IS NOT NULL)"""


# ---------------------------------------------------------------- doc
def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with quality labels (imbalanced 0/1)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    df = (d.join(lab, "doc_id").filter(F.col("quality").isNotNull())
          .select(F.col("doc_id").alias("row_id"), F.col("n_chars").cast("double").alias("n_chars"),
                  "lang", "source", F.col("quality").alias("y")))
    return reuse(stratified_split(df))


DOC_SQL = f"""doc AS (
  SELECT d.doc_id AS row_id, CAST(n_chars AS DOUBLE) AS n_chars, lang, source, quality AS y,
         {_split_sql('quality', 'd.doc_id')} AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL)"""


# ---------------------------------------------------------------- evx
def evx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ev`` plus ``xv``: value with +Inf, -Inf, NaN and NULL cells injected by id hash,
    a constant column, a constant column with nulls and a column missing on the test side."""
    d = ev(spark, sf_dir)
    h = F.pmod(id_hash("row_id", 5), F.lit(20))
    xv = (F.when(h == 0, F.lit(float("inf"))).when(h == 1, F.lit(float("-inf")))
          .when(h == 2, F.lit(float("nan"))).when(h == 3, F.lit(None).cast("double"))
          .otherwise(F.col("value")))
    return d.select("*", xv.alias("xv"), F.lit(1.0).alias("const"),
                    F.when(h == 4, F.lit(None).cast("double")).otherwise(F.lit(2.0)).alias("const_null"),
                    F.when(F.col("split") == "test", F.lit(None).cast("double"))
                    .otherwise(F.col("user_id")).alias("test_null"))


EVX_SQL = EV_SQL + f""",
evx AS (
  SELECT *, CASE {id_hash_sql('row_id', 5)} % 20 WHEN 0 THEN CAST('Infinity' AS DOUBLE)
              WHEN 1 THEN CAST('-Infinity' AS DOUBLE) WHEN 2 THEN CAST('NaN' AS DOUBLE)
              WHEN 3 THEN NULL ELSE value END AS xv,
         CAST(1 AS DOUBLE) AS const,
         CASE WHEN {id_hash_sql('row_id', 5)} % 20 = 4 THEN NULL ELSE CAST(2 AS DOUBLE) END AS const_null,
         CASE WHEN split = 'test' THEN NULL ELSE user_id END AS test_null
  FROM ev)"""


# ---------------------------------------------------------------- suite (per nation datasets)
def cust_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as 25 datasets (one per nation): dataset_id, row_id, split, c_acctbal, y."""
    c = load(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isNotNull())
    df = c.select(F.col("c_nationkey").cast("long").alias("dataset_id"), F.col("c_custkey").alias("row_id"),
                  "c_acctbal", F.col("c_mktsegment").alias("y"))
    return df


# ---------------------------------------------------------------- prt (regression)
def prt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: size and brand number as features, retail price as regression target."""
    from ctxtab.operators.split import plain_split
    p = load(spark, sf_dir, "part").filter(F.col("p_retailprice").isNotNull())
    df = p.select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("p_size"),
                  F.expr("try_cast(substr(p_brand, 7) AS DOUBLE)").alias("brand_no"),
                  F.col("p_retailprice").alias("y"))
    return reuse(plain_split(df))


PRT_SQL = f"""prt AS (
  SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS p_size, try_cast(substr(p_brand, 7) AS DOUBLE) AS brand_no,
         p_retailprice AS y,
         CASE WHEN row_number() OVER (ORDER BY {id_hash_sql('p_partkey')}, p_partkey) <= ceil(0.2 * count(*) OVER ())
              THEN 'test' ELSE 'train' END AS split
  FROM part WHERE p_retailprice IS NOT NULL)"""


# ---------------------------------------------------------------- suite bookkeeping (from part / supplier)
SUITE_BENCHMARKS = ["cc18", "tabarena", "tabzilla", "talent"]


def suite_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset task per part: benchmark by key, paired files unless p_size % 3 = 0,
    a test file only for even sizes; cc18 ids carry an OpenML id."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    bench = F.element_at(F.array(*[F.lit(b) for b in SUITE_BENCHMARKS]),
                         (F.pmod(F.col("p_partkey"), F.lit(4)) + 1).cast("int"))
    name = F.concat(F.lit("ds_"), F.col("p_partkey").cast("string"))
    d = p.select("p_partkey", "p_size", bench.alias("benchmark"), name.alias("dataset_name"))
    d = d.withColumn("dataset_dir", F.concat(F.lit("/suite/"), "benchmark", F.lit("/"), "dataset_name"))
    stem = F.concat(F.col("dataset_dir"), F.lit("/"), F.col("dataset_name"))
    paired = F.pmod(F.col("p_size"), F.lit(3)) != 0
    return d.select(
        "benchmark",
        F.when(F.col("benchmark") == "cc18", F.concat(F.lit("OpenML-ID-"), F.col("p_partkey").cast("string")))
        .otherwise(F.col("dataset_name")).alias("dataset_id"),
        "dataset_name", "dataset_dir",
        F.when(~paired, F.concat(stem, F.lit(".csv"))).alias("single_csv"),
        F.when(paired, F.concat(stem, F.lit("_train.csv"))).alias("train_csv"),
        F.when(paired & (F.pmod(F.col("p_size"), F.lit(2)) == 0), F.concat(stem, F.lit("_test.csv"))).alias("test_csv"))


SUITE_TASKS_SQL = """tasks AS (
  SELECT b AS benchmark, CASE WHEN b = 'cc18' THEN 'OpenML-ID-' || p_partkey ELSE 'ds_' || p_partkey END AS dataset_id,
         'ds_' || p_partkey AS dataset_name, '/suite/' || b || '/ds_' || p_partkey AS dataset_dir,
         CASE WHEN p_size % 3 = 0 THEN '/suite/' || b || '/ds_' || p_partkey || '/ds_' || p_partkey || '.csv' END AS single_csv,
         CASE WHEN p_size % 3 <> 0 THEN '/suite/' || b || '/ds_' || p_partkey || '/ds_' || p_partkey || '_train.csv' END AS train_csv,
         CASE WHEN p_size % 3 <> 0 AND p_size % 2 = 0
              THEN '/suite/' || b || '/ds_' || p_partkey || '/ds_' || p_partkey || '_test.csv' END AS test_csv
  FROM (SELECT p_partkey, p_size, ['cc18', 'tabarena', 'tabzilla', 'talent'][p_partkey % 4 + 1] AS b FROM part))"""


def suite_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of an earlier run: none for keys divisible by 7, ``fail`` when p_size % 10 = 0."""
    from ctxtab.operators.suite import TASK_KEYS
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    t = suite_tasks(spark, sf_dir).withColumn("p_partkey", F.expr("CAST(substr(dataset_name, 4) AS BIGINT)"))
    d = t.select(*TASK_KEYS, "p_partkey").join(p, "p_partkey").filter(F.pmod(F.col("p_partkey"), F.lit(7)) != 0)
    fail = F.pmod(F.col("p_size"), F.lit(10)) == 0
    acc = (F.col("p_retailprice") - F.lit(900.0)) / F.lit(100.0)
    return d.select(
        *TASK_KEYS,
        F.when(fail, 0).otherwise(F.col("p_size") * 40).cast("long").alias("n_train"),
        F.when(fail, 0).otherwise(F.col("p_size") * 10).cast("long").alias("n_test"),
        F.when(fail, 0).otherwise(F.pmod(F.col("p_partkey"), F.lit(30)) + 1).cast("long").alias("n_features"),
        F.when(fail, None).otherwise(F.pmod(F.col("p_size"), F.lit(9)) + 2).cast("long").alias("n_classes"),
        F.when(fail, None).otherwise(acc).alias("accuracy"),
        F.when(fail, None).otherwise(acc * 0.9).alias("f1_macro"),
        F.when(fail, None).otherwise(F.lit(1.0) - acc).alias("logloss"),
        (F.col("p_retailprice") / 100.0).alias("predict_seconds"),
        F.when(fail, "fail").otherwise("ok").alias("status"),
        F.when(fail, F.lit("ValueError: fewer than two rows have a target")).alias("error"))


SUITE_RESULTS_SQL = SUITE_TASKS_SQL + """,
results AS (
  SELECT t.benchmark, t.dataset_id, t.dataset_dir, t.dataset_name,
         CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size * 40 END AS BIGINT) AS n_train,
         CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size * 10 END AS BIGINT) AS n_test,
         CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_partkey % 30 + 1 END AS BIGINT) AS n_features,
         CAST(CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size % 9 + 2 END AS BIGINT) AS n_classes,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE (p_retailprice - 900.0) / 100.0 END AS accuracy,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE (p_retailprice - 900.0) / 100.0 * 0.9 END AS f1_macro,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE 1.0 - (p_retailprice - 900.0) / 100.0 END AS logloss,
         p_retailprice / 100.0 AS predict_seconds,
         CASE WHEN p_size % 10 = 0 THEN 'fail' ELSE 'ok' END AS status,
         CASE WHEN p_size % 10 = 0 THEN 'ValueError: fewer than two rows have a target' END AS error
  FROM tasks t JOIN part ON t.dataset_name = 'ds_' || p_partkey
  WHERE p_partkey % 7 <> 0)"""


def skip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw skip-list text, one line per fifth supplier, names written in several forms."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey").filter(F.pmod("s_suppkey", F.lit(5)) == 0)
    k = (F.col("s_suppkey") * 7).cast("string")
    form = F.pmod(F.col("s_suppkey"), F.lit(3))
    v = (F.when(form == 0, F.concat(F.lit("/x/DS_"), k, F.lit("_TRAIN.csv")))
         .when(form == 1, F.concat(F.lit("ds_"), k, F.lit(".csv")))
         .otherwise(F.concat(F.lit(" ds_"), k, F.lit(" ,OpenML-ID-"), (F.col("s_suppkey") * 11).cast("string"))))
    return s.select(v.alias("value"))


SKIP_SQL = """skipraw AS (
  SELECT CASE s_suppkey % 3 WHEN 0 THEN '/x/DS_' || (s_suppkey * 7) || '_TRAIN.csv'
                            WHEN 1 THEN 'ds_' || (s_suppkey * 7) || '.csv'
                            ELSE ' ds_' || (s_suppkey * 7) || ' ,OpenML-ID-' || (s_suppkey * 11) END AS value
  FROM supplier WHERE s_suppkey % 5 = 0)"""
