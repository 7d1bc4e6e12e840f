"""Queries for encoders and generated features (E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxtab.functions.exprs import id_hash, id_hash_sql, r6
from ctxtab.operators import encode
from ctxtab.plans.registry import register
from ctxtab.sources import tables


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _sorted_dict_sql(name, src, col, where="TRUE"):
    return (f"{name} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM "
            f"(SELECT DISTINCT {col} AS v FROM {src} WHERE {col} IS NOT NULL AND {where}))")


@register("e1_ordinal_encode", "WITH " + tables.DOC_SQL + ",\n" + _sorted_dict_sql("dl", "doc", "lang") + ",\n"
          + _sorted_dict_sql("ds", "doc", "source") + """
SELECT d.row_id, dl.code AS lang, ds.code AS source
FROM doc d LEFT JOIN dl ON d.lang = dl.v LEFT JOIN ds ON d.source = ds.v""")
def e1_ordinal_encode(spark, sf_dir):
    d = tables.doc(spark, sf_dir).select("row_id", "lang", "source", "split")
    return encode.ordinal_encode(d, ["lang", "source"]).select("row_id", "lang", "source")


D2_SQL = tables.DOC_SQL + ",\nd2 AS (SELECT *, CAST(CAST(n_chars AS BIGINT) AS VARCHAR) AS nchar_s FROM doc)"


def _doc2(spark, sf_dir):
    return tables.doc(spark, sf_dir).withColumn("nchar_s", F.col("n_chars").cast("long").cast("string"))


@register("e2_ordinal_encode_train", "WITH " + D2_SQL + ",\n"
          + _sorted_dict_sql("dn", "(SELECT coalesce(nchar_s, '__MISSING__') AS nchar_s, split FROM d2)", "nchar_s",
                             "split = 'train'") + ",\n"
          + _sorted_dict_sql("ds", "(SELECT coalesce(source, '__MISSING__') AS source, split FROM d2)", "source",
                             "split = 'train'") + """
SELECT d.row_id, coalesce(dn.code, -1) AS nchar_s, coalesce(ds.code, -1) AS source
FROM d2 d LEFT JOIN dn ON coalesce(d.nchar_s, '__MISSING__') = dn.v
          LEFT JOIN ds ON coalesce(d.source, '__MISSING__') = ds.v""")
def e2_ordinal_encode_train(spark, sf_dir):
    return encode.ordinal_encode_train(_doc2(spark, sf_dir), ["nchar_s", "source"]).select(
        "row_id", "nchar_s", "source")


def _first_dict_sql(name, col):
    return (f"{name} AS (SELECT {col} AS v, CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS INTEGER) AS code "
            f"FROM d2 WHERE split = 'train' AND {col} IS NOT NULL GROUP BY {col})")


@register("e3_codes_by_first_appearance", "WITH " + D2_SQL + ",\n" + _first_dict_sql("fl", "lang") + ",\n"
          + _first_dict_sql("fn", "nchar_s") + """
SELECT d.row_id, coalesce(fl.code, -1) AS lang, coalesce(fn.code, -1) AS nchar_s
FROM d2 d LEFT JOIN fl ON d.lang = fl.v LEFT JOIN fn ON d.nchar_s = fn.v""")
def e3_codes_by_first_appearance(spark, sf_dir):
    return encode.codes_by_first_appearance(_doc2(spark, sf_dir), ["lang", "nchar_s"]).select(
        "row_id", "lang", "nchar_s")


@register("e4_codes_full", "WITH " + tables.EV_SQL + """,
e2 AS (SELECT row_id, CASE WHEN row_id % 9 = 0 THEN '' ELSE y END AS et FROM ev),
dd AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT et AS v FROM e2 WHERE et IS NOT NULL AND et <> ''))
SELECT e2.row_id, coalesce(dd.code, -1) AS et FROM e2 LEFT JOIN dd ON e2.et = dd.v""")
def e4_codes_full(spark, sf_dir):
    e = tables.ev(spark, sf_dir).select(
        "row_id", F.when(F.col("row_id") % 9 == 0, F.lit("")).otherwise(F.col("y")).alias("et"))
    return encode.codes_full(e, ["et"]).select("row_id", "et")


@register("e5_label_encode", "WITH " + tables.CUST_SQL + ",\n" + _sorted_dict_sql("dy", "cust", "y", "split = 'train'") + """
SELECT c.row_id, c.y, coalesce(dy.code, -1) AS y_code FROM cust c LEFT JOIN dy ON c.y = dy.v""")
def e5_label_encode(spark, sf_dir):
    d, _ = encode.label_encode(tables.cust(spark, sf_dir))
    return d.select("row_id", "y", "y_code")


E6_COLS = ["l_linestatus", "l_discount", "l_tax", "l_quantity"]


@register("e6_common_category_gate", "WITH " + tables.LINE_SQL + "\n" + _union([f"""SELECT '{c}' AS feature,
  min(n) AS min_count, count(*) AS n_distinct, min(n) >= 10 AS gate,
  min(n) >= 10 AND count(*) < sum(n) // 10 AS gate_strict
FROM (SELECT {c}, count(*) AS n FROM line GROUP BY {c})""" for c in E6_COLS]))
def e6_common_category_gate(spark, sf_dir):
    return encode.category_gate(tables.line(spark, sf_dir), E6_COLS)


def _perm_dict_sql(name, col, salt):
    return (f"{name}0 AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c0 FROM "
            f"(SELECT DISTINCT {col} AS v FROM doc WHERE {col} IS NOT NULL)),\n"
            f"{name} AS (SELECT v, CAST(row_number() OVER (ORDER BY {id_hash_sql('c0', salt)}, c0) - 1 AS INTEGER)"
            f" AS code FROM {name}0)")


@register("e7_shuffle_codes", "WITH " + tables.DOC_SQL + ",\n" + _perm_dict_sql("pl", "lang", 1000) + ",\n"
          + _perm_dict_sql("ps", "source", 1017) + """
SELECT d.row_id, pl.code AS lang, ps.code AS source
FROM doc d LEFT JOIN pl ON d.lang = pl.v LEFT JOIN ps ON d.source = ps.v""")
def e7_shuffle_codes(spark, sf_dir):
    d = tables.doc(spark, sf_dir).select("row_id", "lang", "source")
    return encode.shuffle_codes(d, ["lang", "source"], seed=0)


@register("e8_one_hot", "WITH " + tables.LINE_SQL + """
SELECT row_id, CAST(l_linestatus = 'O' AS DOUBLE) AS l_linestatus__O,
       CAST(y = 'A' AS DOUBLE) AS y__A, CAST(y = 'N' AS DOUBLE) AS y__N, CAST(y = 'R' AS DOUBLE) AS y__R
FROM line""")
def e8_one_hot(spark, sf_dir):
    d = tables.line(spark, sf_dir).select("row_id", "l_linestatus", "y")
    return encode.one_hot(d, ["l_linestatus", "y"])


N_MEMBERS = 4


@register("e10_class_permutations", "WITH " + tables.CUST_SQL + ",\n" + _sorted_dict_sql("dy", "cust", "y", "split = 'train'")
          + f"""
SELECT c.row_id, m.member, dy.code AS y_code, dy.code AS y_back, 5 AS n_codes
FROM cust c JOIN dy ON c.y = dy.v, (SELECT unnest(range({N_MEMBERS}))::INTEGER AS member) m""")
def e10_class_permutations(spark, sf_dir):
    """Every member's permutation is applied to the codes and undone; a permutation uses all codes."""
    from ctxtab.operators.predict import undo_class_permutation
    d, _ = encode.label_encode(tables.cust(spark, sf_dir))
    d = d.filter("y_code >= 0").select("row_id", "y_code")
    parts = []
    for k, perm in enumerate(encode.class_permutations(5, N_MEMBERS, seed=0)):
        p = encode.apply_class_permutation(d, perm)
        back = undo_class_permutation(p.withColumn("class", F.col("y_perm")), perm)
        parts.append(back.select("row_id", F.lit(k).alias("member"), "y_code", F.col("class").cast("int").alias("y_back"),
                                 F.lit(len(set(perm))).alias("n_codes")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("e11_limit_classes", "WITH " + tables.VEC_SQL + """,
tr AS (SELECT * FROM vec WHERE split = 'train'),
top AS (SELECT y FROM (SELECT y, row_number() OVER (ORDER BY count(*) DESC, y) AS r FROM tr GROUP BY y) WHERE r <= 5)
SELECT row_id, y FROM tr WHERE y IN (SELECT y FROM top)""")
def e11_limit_classes(spark, sf_dir):
    tr = tables.vec(spark, sf_dir).filter("split = 'train'")
    return encode.limit_classes(tr, 5).select("row_id", "y")


def _vec_ctx_sql():
    from ctxtab.plans.q_retrieve import K_CTX, VEC_CTX_SQL
    return VEC_CTX_SQL, K_CTX


@register("e12_local_relabel", "WITH " + _vec_ctx_sql()[0] + f"""
SELECT test_id, train_id, ty AS ctx_y, CAST(dense_rank() OVER (PARTITION BY test_id ORDER BY ty) - 1 AS INTEGER) AS local_y
FROM rk WHERE rank <= {_vec_ctx_sql()[1]}""")
def e12_local_relabel(spark, sf_dir):
    from ctxtab.operators.retrieve import row_context_table
    from ctxtab.plans.q_retrieve import vec_context
    _, train, ctx = vec_context(spark, sf_dir)
    t = row_context_table(ctx, train)
    return encode.local_relabel(t).select("test_id", "train_id", "ctx_y", "local_y")


@register("e13_target_rank", "WITH " + tables.LINE_SQL + """,
tv AS (SELECT DISTINCT l_quantity AS v FROM line WHERE split = 'train' AND l_quantity IS NOT NULL)
SELECT row_id, CASE WHEN l_quantity IS NULL THEN NULL ELSE
       (SELECT count(*) FROM tv WHERE tv.v < l.l_quantity) END AS l_quantity_rank
FROM line l""")
def e13_target_rank(spark, sf_dir):
    d = tables.line(spark, sf_dir).select("row_id", "l_quantity", "split")
    return encode.target_rank(d, "l_quantity", id_col="row_id").select("row_id", "l_quantity_rank")


FP_COLS = ["q100", "e100", "d100", "t100"]


def _horner_sql(h):
    acc = "0"
    for i in range(16):
        acc = f"(({acc}) * 65536 + CAST(('0x' || substr({h}, {4 * i + 1}, 4)) AS BIGINT)) % 1000000000000"
    return acc


@register("e14_row_fingerprint", "WITH " + tables.LINE_SQL + """,
c AS (SELECT row_id, concat_ws('|', CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
          CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT)) AS txt FROM line),
k AS (SELECT row_id, txt, row_number() OVER (PARTITION BY sha256(txt) ORDER BY row_id) - 1 AS k FROM c),
h AS (SELECT row_id, sha256(txt || '|' || CAST(k AS VARCHAR)) AS h FROM k)
SELECT row_id, """ + _horner_sql("h") + " AS fp_code FROM h")
def e14_row_fingerprint(spark, sf_dir):
    d = tables.line(spark, sf_dir).select(
        "row_id", *[F.round(F.col(src) * 100).cast("long").alias(dst)
                    for src, dst in zip(tables.LINE_FEATURES, FP_COLS)])
    return encode.row_fingerprint(d, FP_COLS, salt=0, code_col="fp_code").select("row_id", "fp_code")


LF = tables.LINE_FEATURES


def _poly_sql():
    pairs = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]  # all of four features
    sc = ", ".join(f"round({c} / sd_{c}, 6) AS {c}" for c in LF)
    pr = ", ".join(f"round(({LF[a]} / sd_{LF[a]}) * ({LF[b]} / sd_{LF[b]}), 6) AS {LF[a]}_x_{LF[b]}" for a, b in pairs)
    sds = ", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1) AS sd_{c}" for c in LF)
    return ("WITH " + tables.LINE_SQL + f",\nsd AS (SELECT {sds} FROM line)\n"
            f"SELECT row_id, {sc}, {pr} FROM line, sd")


@register("e15_polynomial_interactions", _poly_sql())
def e15_polynomial_interactions(spark, sf_dir):
    d = tables.line(spark, sf_dir).select("row_id", *LF)
    out = encode.polynomial_interactions(d, LF)
    return out.select("row_id", *[r6(c, c) for c in out.columns if c != "row_id"])


def _rbf_sql():
    cs = [10.0 * i / 10 for i in range(11)]
    ks = ", ".join(f"round(exp(-pow(m - {c}, 2) / {2 * 1.05 * 1.05}), 6) AS x_rbf{i}" for i, c in enumerate(cs))
    return ("WITH " + tables.LINE_SQL + """,
b AS (SELECT row_id, l_extendedprice AS x FROM line),
e AS (SELECT row_id, x, CAST(sign(x) AS DOUBLE) AS x_sign,
             CASE WHEN abs(x) > 0 THEN CAST(floor(log10(abs(x))) AS BIGINT) ELSE 0 END AS x_exp FROM b),
m AS (SELECT *, CASE WHEN abs(x) > 0 THEN abs(x) / pow(10.0, x_exp) ELSE 0.0 END AS m FROM e)
SELECT row_id, x_sign, x_exp, m AS x_mant, """ + ks + " FROM m")


@register("e16_rbf_basis", _rbf_sql())
def e16_rbf_basis(spark, sf_dir):
    d = tables.line(spark, sf_dir).select("row_id", F.col("l_extendedprice").alias("x"))
    out = encode.rbf_basis(d, "x")
    return out.select("row_id", "x_sign", "x_exp", "x_mant",
                      *[r6(f"x_rbf{i}", f"x_rbf{i}") for i in range(11)])


@register("e17_missing_indicator", "WITH " + tables.EVX_SQL + """,
m AS (SELECT avg(CASE WHEN isnan(xv) OR isinf(xv) THEN NULL ELSE xv END) AS mu FROM evx WHERE split = 'train')
SELECT row_id, round(CASE WHEN xv IS NULL OR isnan(xv) OR isinf(xv) THEN mu ELSE xv END, 6) AS xv,
       CAST(CASE WHEN xv IS NULL OR isnan(xv) THEN -2 WHEN xv = CAST('Infinity' AS DOUBLE) THEN 2
            WHEN xv = CAST('-Infinity' AS DOUBLE) THEN 4 ELSE 0 END AS DOUBLE) AS xv_ind
FROM evx, m""")
def e17_missing_indicator(spark, sf_dir):
    d = tables.evx(spark, sf_dir).select("row_id", "xv", "split")
    return encode.missing_indicator(d, ["xv"]).select("row_id", r6("xv", "xv"), "xv_ind")
