"""Queries for retrieval variants, prediction, ensembling and metrics (Q*, M*, V1-V9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxtab.functions.exprs import id_hash_sql, r6
from ctxtab.functions.ranking import global_index
from ctxtab.operators import encode, metrics, pipeline, predict, retrieve, split
from ctxtab.operators.scale import StandardScaler
from ctxtab.plans.q_clean import RELEVANCE_SQL, line_relevance
from ctxtab.plans.q_retrieve import K_CTX, PROBS_SQL, TEMP, VEC_CTX_SQL, vec_context, vec_pred, vec_probs
from ctxtab.plans.registry import register
from ctxtab.session import reuse
from ctxtab.sources import tables


def ctx_chain(p: str, pairs_select: str, part: str = "") -> str:
    """SQL twin of the blocked score job: pairs -> per-row lse -> ranked contexts.

    ``part`` adds extra partition keys (e.g. ``shard,``)."""
    return f""",
{p}pairs AS ({pairs_select}),
{p}mx AS (SELECT *, max(score) OVER (PARTITION BY {part} test_id) AS m FROM {p}pairs),
{p}st AS (SELECT {part} test_id, count(*) AS n_ctx, max(m) AS max_score, max(m) + ln(sum(exp(score - m))) AS lse
          FROM {p}mx GROUP BY {part} test_id),
{p}rk AS (SELECT p.*, s.lse, s.n_ctx, exp(p.score - s.lse) AS weight,
                 row_number() OVER (PARTITION BY {' '.join('p.' + x.strip() for x in part.split(',') if x.strip())
                                                   + (',' if part else '')} p.test_id
                                    ORDER BY p.score DESC, p.train_id) AS rank
          FROM {p}pairs p JOIN {p}st s ON p.test_id = s.test_id {''.join(
              f" AND p.{x.strip()} = s.{x.strip()}" for x in part.split(',') if x.strip())})"""


# ------------------------------------------------------------------ Q2 / Q3
@register("q2_feature_relevance", "WITH " + RELEVANCE_SQL + "\nSELECT feature, round(relevance, 6) AS relevance FROM rel")
def q2_feature_relevance(spark, sf_dir):
    return line_relevance(spark, sf_dir).select("feature", r6("relevance", "relevance"))


CF = ["c_acctbal", "c_nationkey", "n_regionkey"]


def _cust_z(spark, sf_dir):
    d, _ = encode.label_encode(tables.cust(spark, sf_dir))
    sc = StandardScaler(CF).fit(d)
    return sc.transform(d)


CUST_Z_SQL = tables.CUST_SQL + ",\n" + """codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS y_code
          FROM (SELECT DISTINCT y AS v FROM cust WHERE split = 'train')),
custst AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in CF) + """
        FROM cust WHERE split = 'train'),
cz AS (SELECT row_id, split, y, coalesce(codes.y_code, -1) AS y_code, """ + ", ".join(
    f"({c} - m_{c}) / s_{c} AS {c}" for c in CF) + """ FROM cust LEFT JOIN codes ON cust.y = codes.v, custst),
cr AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, abs(coalesce(corr({c}, y_code), 0)) AS r FROM cz WHERE split = 'train'" for c in CF) + """),
rel0 AS (SELECT feature, exp(r - max(r) OVER ()) AS e FROM cr),
rel AS (SELECT feature, e / sum(e) OVER () AS w FROM rel0),
wv AS (SELECT """ + ", ".join(f"max(CASE WHEN feature = '{c}' THEN w END) AS w_{c}" for c in CF) + " FROM rel)"


def _q3_sql(weights: dict[str, str]) -> str:
    return ("WITH " + CUST_Z_SQL + ctx_chain("c", "SELECT t.row_id AS test_id, r.row_id AS train_id, ("
            + " + ".join(f"t.{c} * {w} * r.{c}" for c, w in weights.items()) + f") / {len(CF)} AS score "
            "FROM cz t JOIN cz r ON t.split = 'test' AND r.split = 'train', wv") + """
SELECT test_id, train_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM crk WHERE rank <= 5""")


def _q3(spark, sf_dir, use_relevance):
    from ctxtab.operators.scale import feature_relevance
    z = _cust_z(spark, sf_dir)
    test, train = z.filter("split = 'test'"), z.filter("split = 'train'")
    ctx = retrieve.mixed_context(test, train, CF, 5, feature_relevance(train, CF) if use_relevance else None)
    return ctx.select("test_id", "train_id", "rank", r6("score", "score"))


@register("q3_mixed_scores", _q3_sql({c: f"w_{c}" for c in CF}))
def q3_mixed_scores(spark, sf_dir):
    return _q3(spark, sf_dir, True)


@register("q3_only_sample", _q3_sql({c: "1.0" for c in CF}))
def q3_only_sample(spark, sf_dir):
    return _q3(spark, sf_dir, False)


# ------------------------------------------------------------------ Q5 mass selection
def _mass_sql(method: str, L: int, thr: float) -> str:
    need = (f"greatest(coalesce(need, n_ctx), {L})" if method == "max" else f"least(coalesce(need, {L}), {L})")
    return "WITH " + VEC_CTX_SQL + f""",
cu AS (SELECT *, sum(weight) OVER (PARTITION BY test_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS cum FROM rk),
nd AS (SELECT test_id, min(CASE WHEN cum >= {thr} THEN rank END) AS need, max(n_ctx) AS n_ctx FROM cu GROUP BY test_id),
ln_ AS (SELECT test_id, least({need}, n_ctx) AS ctx_len FROM nd)
SELECT r.test_id, r.train_id, CAST(r.rank AS INTEGER) AS rank, CAST(l.ctx_len AS BIGINT) AS ctx_len
FROM rk r JOIN ln_ l ON r.test_id = l.test_id WHERE r.rank <= l.ctx_len"""


def _mass(spark, sf_dir, method, L, thr):
    test, train = tables.vec(spark, sf_dir).filter("split = 'test'"), tables.vec(spark, sf_dir).filter(
        "split = 'train'")
    m = retrieve.mass_context(test, train, "emb", threshold=thr, retrieval_len=L, mixed_method=method)
    return m.select("test_id", "train_id", "rank", F.col("ctx_len").cast("long").alias("ctx_len"))


@register("q5_mass_context", _mass_sql("max", 10, 0.5))
def q5_mass_context(spark, sf_dir):
    return _mass(spark, sf_dir, "max", 10, 0.5)


@register("q5_mass_context_min", _mass_sql("min", 10, 0.1))
def q5_mass_context_min(spark, sf_dir):
    return _mass(spark, sf_dir, "min", 10, 0.1)


# ------------------------------------------------------------------ Q7 / Q9 / Q10 / Q11 / Q12
N_CLUSTERS, ROUNDS = 4, 3


def _round_sql(r: int) -> str:
    """One Lloyd round of the SQL twin: centres ``z{r}`` -> assignment ``a{r + 1}`` -> centres ``z{r + 1}``."""
    return f""",
zn{r} AS (SELECT cluster_id, sum(w * w) AS q FROM z{r} GROUP BY 1),
d{r} AS (SELECT t.test_id, n.cluster_id, round(n.q - 2 * coalesce(sum(z.w), 0), 9) AS d
         FROM (SELECT DISTINCT test_id FROM mem) t CROSS JOIN zn{r} n
         LEFT JOIN mem m ON m.test_id = t.test_id LEFT JOIN z{r} z ON z.cluster_id = n.cluster_id AND z.train_id = m.train_id
         GROUP BY t.test_id, n.cluster_id, n.q),
a{r + 1} AS (SELECT test_id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM d{r} GROUP BY 1),
s{r + 1} AS (SELECT cluster_id, count(*) AS n FROM a{r + 1} GROUP BY 1),
z{r + 1} AS (SELECT a.cluster_id, m.train_id, count(*) / any_value(s.n) AS w
             FROM a{r + 1} a JOIN mem m USING (test_id) JOIN s{r + 1} s ON s.cluster_id = a.cluster_id GROUP BY 1, 2
             UNION ALL SELECT * FROM z{r} WHERE cluster_id NOT IN (SELECT cluster_id FROM s{r + 1}))"""


ASSIGN_SQL = f"""mem AS (SELECT DISTINCT test_id, train_id FROM rk WHERE rank <= {K_CTX}),
sd AS (SELECT test_id, row_number() OVER (ORDER BY {id_hash_sql('test_id', 17)}, test_id) - 1 AS c FROM (SELECT DISTINCT test_id FROM mem)),
z0 AS (SELECT CAST(c AS INTEGER) AS cluster_id, train_id, CAST(1 AS DOUBLE) AS w FROM mem JOIN sd USING (test_id) WHERE c < {N_CLUSTERS})""" + "".join(
    map(_round_sql, range(ROUNDS))) + f""",
asg AS (SELECT test_id, cluster_id FROM a{ROUNDS})"""


def _assign(ctx):
    return retrieve.cluster_by_context(ctx, N_CLUSTERS, ROUNDS)


@register("q7_cluster_by_context", "WITH " + VEC_CTX_SQL + ",\n" + ASSIGN_SQL + "\nSELECT test_id, cluster_id FROM asg")
def q7_cluster_by_context(spark, sf_dir):
    _, _, ctx = vec_context(spark, sf_dir)
    return _assign(ctx)


@register("q8_context_overlap", "WITH " + VEC_CTX_SQL + f""",
ctx AS (SELECT DISTINCT test_id, train_id FROM rk WHERE rank <= {K_CTX}),
pr AS (SELECT a.test_id AS test_a, b.test_id AS test_b, count(*) AS n_shared
       FROM ctx a JOIN ctx b ON a.train_id = b.train_id AND a.test_id < b.test_id GROUP BY 1, 2)
SELECT * FROM pr UNION ALL SELECT test_id, test_id, count(*) FROM ctx GROUP BY test_id""")
def q8_context_overlap(spark, sf_dir):
    _, _, ctx = vec_context(spark, sf_dir)
    return retrieve.context_overlap(ctx, diagonal=True)


@register("q9_cluster_contexts", "WITH " + VEC_CTX_SQL + ",\n" + ASSIGN_SQL + f"""
SELECT DISTINCT a.cluster_id, 'train' AS side, r.train_id AS row_id FROM rk r JOIN asg a ON r.test_id = a.test_id WHERE r.rank <= {K_CTX}
UNION ALL SELECT cluster_id, 'test', test_id FROM asg""")
def q9_cluster_contexts(spark, sf_dir):
    _, _, ctx = vec_context(spark, sf_dir)
    tr, te = retrieve.cluster_contexts(ctx, _assign(ctx))
    side = lambda df, name, c: df.select("cluster_id", F.lit(name).alias("side"), F.col(c).alias("row_id"))
    return side(tr, "train", "train_id").unionByName(side(te, "test", "test_id"))


Q10_SQL = "WITH " + VEC_CTX_SQL + ",\n" + ASSIGN_SQL + f""",
cc AS (SELECT DISTINCT a.cluster_id, r.train_id FROM rk r JOIN asg a ON r.test_id = a.test_id WHERE r.rank <= {K_CTX}),
ctr AS (SELECT cc.cluster_id, v.row_id, v.y, v.emb FROM cc JOIN vec v ON cc.train_id = v.row_id),
topc AS (SELECT cluster_id, y FROM (SELECT cluster_id, y, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, y)
                 AS r FROM ctr GROUP BY cluster_id, y) WHERE r <= 5),
ctr5 AS (SELECT c.* FROM ctr c JOIN topc t ON c.cluster_id = t.cluster_id AND c.y = t.y),
cte AS (SELECT a.cluster_id, v.row_id, v.emb FROM asg a JOIN vec v ON a.test_id = v.row_id)""" + ctx_chain(
    "g", "SELECT t.cluster_id, t.row_id AS test_id, r.row_id AS train_id, r.y AS ty, "
         "list_dot_product(CAST(t.emb AS DOUBLE[]), CAST(r.emb AS DOUBLE[])) / sqrt(len(t.emb)) AS score "
         "FROM cte t JOIN ctr5 r ON t.cluster_id = r.cluster_id", "cluster_id,") + f""",
gcls AS (SELECT test_id, ty AS class, ln(sum(weight)) AS logit FROM grk WHERE rank <= 5 GROUP BY 1, 2),
gsm AS (SELECT test_id, class, exp(logit / {TEMP} - max(logit / {TEMP}) OVER (PARTITION BY test_id)) AS e FROM gcls)
SELECT test_id, class, round(e / sum(e) OVER (PARTITION BY test_id), 6) AS p FROM gsm"""


@register("q10_score_by_group", Q10_SQL)
def q10_score_by_group(spark, sf_dir):
    test, train, ctx = vec_context(spark, sf_dir)
    probs = pipeline.score_by_group(test, train, _assign(ctx), ctx, "emb", 5, 5, TEMP)
    return probs.select("test_id", "class", r6("p", "p"))


@register("e12_relabel_inverse", Q10_SQL[:Q10_SQL.rindex("SELECT")] + """,
gp AS (SELECT test_id, class, e / sum(e) OVER (PARTITION BY test_id) AS p FROM gsm)
SELECT t.test_id, c.y AS class, round(coalesce(gp.p, 0), 6) AS p
FROM (SELECT DISTINCT test_id FROM gsm) t CROSS JOIN (SELECT DISTINCT y FROM vec WHERE split = 'train') c
LEFT JOIN gp ON gp.test_id = t.test_id AND gp.class = c.y""")
def e12_relabel_inverse(spark, sf_dir):
    """Scores in each cluster's own labels, scattered to the classes of all train rows."""
    test, train, ctx = vec_context(spark, sf_dir)
    classes = sorted(r[0] for r in train.select("y").distinct().collect())  # the fitted list
    probs = pipeline.score_by_group(test, train, _assign(ctx), ctx, "emb", 5, 5, TEMP, classes)
    return probs.select("test_id", "class", r6("p", "p"))


@register("q11_row_context_table", "WITH " + VEC_CTX_SQL + f"""
SELECT test_id, train_id, CAST(rank AS INTEGER) AS rank, ty AS ctx_y FROM rk WHERE rank <= {K_CTX}""")
def q11_row_context_table(spark, sf_dir):
    _, train, ctx = vec_context(spark, sf_dir)
    return retrieve.row_context_table(ctx, train).select("test_id", "train_id", "rank", "ctx_y")


@register("q12_restore_order", "WITH " + PROBS_SQL + """
SELECT row_number() OVER (ORDER BY test_id) - 1 AS pos, test_id, pred FROM predtab""")
def q12_restore_order(spark, sf_dir):
    _, _, pt = vec_pred(spark, sf_dir)
    return global_index(pt.select("test_id", "pred"), ["test_id"], "pos").select("pos", "test_id", "pred")


# ------------------------------------------------------------------ M1 member pipelines
MEMBERS = [{"scale": "standard", "order": "shuffle", "permute": True, "k": 15},
           {"scale": "minmax", "polynomial": 1, "order": "rotate", "offset": 1, "permute": True, "k": 10}]


def _member_sql(name: str, k: int, cols: dict[str, str], stats: str) -> str:
    """One member in SQL: features as expressions over ``cust`` and a row of statistics."""
    feats = ", ".join(f"{e} AS {c}" for c, e in cols.items())
    dot = " + ".join(f"t.{c} * r.{c}" for c in cols)
    return (f"{name}stat AS (SELECT {stats} FROM cx WHERE split = 'train'),\n{name}z AS (SELECT row_id, split, y_code, {feats} FROM cx, {name}stat)"
            + ctx_chain(name, f"SELECT t.row_id AS test_id, r.row_id AS train_id, r.y_code AS ty, ({dot}) / sqrt({len(cols)}) AS score "
                        f"FROM {name}z t JOIN {name}z r ON t.split = 'test' AND r.split = 'train'") + f""",
{name}lg AS (SELECT test_id, ty AS class, ln(sum(weight)) AS logit FROM {name}rk WHERE rank <= {k} GROUP BY 1, 2),
{name}e AS (SELECT test_id, class, exp((logit - max(logit) OVER (PARTITION BY test_id)) / {TEMP}) AS e FROM {name}lg),
{name}p AS (SELECT test_id, class, e / sum(e) OVER (PARTITION BY test_id) AS p FROM {name}e)""")


_FIRST = {c: f"({c} - m_{c}) / s_{c}" for c in CF}
_SECOND = {c: f"CASE WHEN h_{c} = l_{c} THEN 0 ELSE ({c} - l_{c}) / (h_{c} - l_{c}) END" for c in [*CF, "x01"]}
MEMBER_SQL = tables.CUST_SQL + """,
codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS y_code
          FROM (SELECT DISTINCT y AS v FROM cust WHERE split = 'train')),
cx AS (SELECT cust.*, codes.y_code, c_acctbal * c_acctbal AS x01 FROM cust JOIN codes ON cust.y = codes.v),
""" + _member_sql("ma", 15, _FIRST, ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in CF)) + ",\n" + _member_sql(
    "mb", 10, _SECOND, ", ".join(f"min({c}) AS l_{c}, max({c}) AS h_{c}" for c in [*CF, "x01"])) + """,
av AS (SELECT test_id, class, sum(p) / 2 AS a FROM (SELECT * FROM map UNION ALL SELECT * FROM mbp) GROUP BY 1, 2)"""


@register("m1_member_pipeline", "WITH " + MEMBER_SQL + """
SELECT test_id, class, round(a / sum(a) OVER (PARTITION BY test_id), 6) AS p FROM av""")
def m1_member_pipeline(spark, sf_dir):
    """Two members that differ in scaling, interactions, feature and class order and context length."""
    from ctxtab.operators.meta import PipelineSpec
    from ctxtab.operators.pipeline import ensemble
    d, _ = encode.label_encode(tables.cust(spark, sf_dir))
    spec = PipelineSpec.load(MEMBERS, softmax_temperature=TEMP, seed=11)
    return ensemble(d.where("y_code >= 0"), CF, spec).select("test_id", "class", r6("p", "p"))


REBALANCED = [
    {"RebalanceFeatureDistribution": {"worker_tags": ["quantile_uniform_10"], "discrete_flag": False, "original_flag": False, "svd_tag": None},
     "CategoricalFeatureEncoder": {"encoding_strategy": "ordinal"}, "FeatureShuffler": {"mode": "shuffle"},
     "retrieval_config": {"use_retrieval": True, "retrieval_len": 15}},
    {"RebalanceFeatureDistribution": {"worker_tags": ["robust", "logNormal"], "discrete_flag": True, "original_flag": False, "svd_tag": None},
     "CategoricalFeatureEncoder": {"encoding_strategy": "none"}, "FeatureShuffler": {"mode": "rotate"},
     "retrieval_config": {"use_retrieval": True, "retrieval_len": 0.01}}]


def _voted_sql(name: str, table: str, cols: list[str], k: str) -> str:
    """Context, votes and probabilities of a member table in SQL."""
    dot = " + ".join(f"t.{c} * r.{c}" for c in cols)
    return ctx_chain(name, f"SELECT t.row_id AS test_id, r.row_id AS train_id, r.y_code AS ty, ({dot}) / sqrt({len(cols)}) AS score "
                           f"FROM {table} t JOIN {table} r ON t.split = 'test' AND r.split = 'train'") + f""",
{name}lg AS (SELECT test_id, ty AS class, ln(sum(exp(score - m))) + max(m) AS logit FROM (
    SELECT *, max(score) OVER (PARTITION BY test_id, ty) AS m FROM {name}rk WHERE rank <= {k}) GROUP BY 1, 2),
{name}e AS (SELECT test_id, class, exp((logit - max(logit) OVER (PARTITION BY test_id)) / {TEMP}) AS e FROM {name}lg),
{name}p AS (SELECT test_id, class, e / sum(e) OVER (PARTITION BY test_id) AS p FROM {name}e)"""


def _rebalanced_sql() -> str:
    from ctxtab.plans.q_scale import _quantile_sql
    maps = ",".join(_quantile_sql(c, 10).replace("FROM line", "FROM cx") for c in CF[:2])
    log = {c: f"ln(CASE WHEN {c} + abs(l_{c}) + 1e-10 > 0 THEN {c} + abs(l_{c}) + 1e-10 END)" for c in CF}
    return tables.CUST_SQL + """,
codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS y_code
          FROM (SELECT DISTINCT y AS v FROM cust WHERE split = 'train')),
cx AS (SELECT cust.*, codes.y_code FROM cust JOIN codes ON cust.y = codes.v),""" + maps + """,
ra AS (SELECT cx.row_id, split, y_code, qa.v AS a, qb.v AS b, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS c
       FROM cx JOIN r_c_acctbal qa ON qa.row_id = cx.row_id JOIN r_c_nationkey qb ON qb.row_id = cx.row_id),
bs AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}, min({c}) AS l_{c}" for c in CF) + """
       FROM cx WHERE split = 'train'),
bl AS (SELECT row_id, split, y_code, """ + ", ".join(
        f"({c} - m_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE (b_{c} - a_{c}) / 1.3489795003921634 END AS r_{i}, {log[c]} AS g_{i}" for i, c in enumerate(CF)) + """ FROM cx, bs),
bm AS (SELECT """ + ", ".join(f"avg(g_{i}) AS mg_{i}" for i in range(3)) + """ FROM bl WHERE split = 'train'),
rb AS (SELECT row_id, split, y_code, r_0, r_1, r_2, """ + ", ".join(f"coalesce(g_{i}, mg_{i}) AS g_{i}" for i in range(3)) + """ FROM bl, bm),
kb AS (SELECT CAST(floor(0.01 * count(*)) AS BIGINT) AS k FROM cx WHERE split = 'train')""" + _voted_sql("qa_", "ra", ["a", "b", "c"], "15") + _voted_sql(
        "qb_", "rb", ["r_0", "r_1", "r_2", "g_0", "g_1", "g_2"], "(SELECT k FROM kb)") + """,
av AS (SELECT test_id, class, sum(p) / 2 AS a FROM (SELECT * FROM qa_p UNION ALL SELECT * FROM qb_p) GROUP BY 1, 2)"""


@register("m1_rebalanced_ensemble", "WITH " + _rebalanced_sql() + """
SELECT test_id, class, round(a / sum(a) OVER (PARTITION BY test_id), 6) AS p FROM av""")
def m1_rebalanced_ensemble(spark, sf_dir):
    """Two members in JSON form: quantile maps beside ordinal codes, and two rebalancings of all features side by side."""
    from ctxtab.operators.meta import PipelineSpec
    from ctxtab.operators.pipeline import rebalanced_ensemble
    d, _ = encode.label_encode(tables.cust(spark, sf_dir))
    spec = PipelineSpec.load(REBALANCED, softmax_temperature=TEMP, seed=11)
    return rebalanced_ensemble(d.where("y_code >= 0"), CF, ["n_regionkey"], spec).select("test_id", "class", r6("p", "p"))


# ------------------------------------------------------------------ M2 / M3 / M9 (regression + imputation)
PF = ["p_size", "brand_no"]
PRT_Z_SQL = tables.PRT_SQL + """,
prtst AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in PF) + """
        FROM prt WHERE split = 'train'),
pz AS (SELECT row_id, split, y, p_size AS raw_size, brand_no AS raw_brand, """ + ", ".join(
    f"({c} - m_{c}) / s_{c} AS {c}" for c in PF) + " FROM prt, prtst)" + ctx_chain(
    "p", "SELECT t.row_id AS test_id, r.row_id AS train_id, r.y AS ty, (t.p_size * r.p_size + t.brand_no * r.brand_no)"
         " / sqrt(2) AS score FROM pz t JOIN pz r ON t.split = 'test' AND r.split = 'train'") + """,
preds AS (SELECT k.test_id, sum(k.weight * k.ty) / sum(k.weight) AS pred FROM prk k WHERE k.rank <= 10 GROUP BY k.test_id),
rtab AS (SELECT preds.test_id, preds.pred, z.y FROM preds JOIN pz z ON preds.test_id = z.row_id)"""


def prt_context(spark, sf_dir, k=10):
    d = tables.prt(spark, sf_dir)
    z = StandardScaler(PF).fit(d).transform(d).withColumn("v", F.array(*PF))
    test, train = z.filter("split = 'test'"), z.filter("split = 'train'")
    return d, test, train, retrieve.top_k_context(test, train, "v", k)


def prt_preds(spark, sf_dir):
    d, test, train, ctx = prt_context(spark, sf_dir)
    pr = predict.predict_values(ctx, d)
    return d, ctx, pr.join(d.select(F.col("row_id").alias("test_id"), "y"), "test_id")


@register("m2_predict_values", "WITH " + PRT_Z_SQL + "\nSELECT test_id, round(pred, 6) AS pred FROM preds")
def m2_predict_values(spark, sf_dir):
    _, _, pr = prt_preds(spark, sf_dir)
    return pr.select("test_id", r6("pred", "pred"))


CAT = ["brand_no"]
IMP_SQL = tables.PRT_SQL + """,
tcells AS (SELECT row_id, 'p_size' AS feature, p_size AS value FROM prt WHERE split = 'test' AND p_size IS NOT NULL
           UNION ALL SELECT row_id, 'brand_no', brand_no FROM prt WHERE split = 'test' AND brand_no IS NOT NULL),
c2 AS (SELECT *, row_id * 2 + CASE feature WHEN 'p_size' THEN 0 ELSE 1 END AS cid FROM tcells),
rr AS (SELECT *, row_number() OVER (ORDER BY """ + id_hash_sql("cid", 7) + """, cid) AS rk, count(*) OVER () AS n FROM c2),
truth_ AS (SELECT row_id AS test_id, feature, value FROM rr WHERE rk <= floor(0.3 * n)),
mk AS (SELECT row_id, split, """ + ", ".join(
    f"CASE WHEN NOT EXISTS (SELECT 1 FROM truth_ h WHERE h.test_id = prt.row_id AND h.feature = '{c}') THEN {c} END AS {c}" for c in PF) + """
       FROM prt),
prtst AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in PF) + """
          FROM prt WHERE split = 'train'),
mz AS (SELECT row_id, split, """ + ", ".join(f"coalesce(({c} - m_{c}) / s_{c}, 0) AS {c}" for c in PF) + " FROM mk, prtst)" + ctx_chain(
    "i", "SELECT t.row_id AS test_id, r.row_id AS train_id, (t.p_size * r.p_size + t.brand_no * r.brand_no) / sqrt(2) AS score"
         " FROM mz t JOIN mz r ON t.split = 'test' AND r.split = 'train'") + """,
near AS (SELECT k.test_id, k.weight, t.p_size, t.brand_no FROM irk k JOIN prt t ON k.train_id = t.row_id WHERE k.rank <= 10),
votes AS (SELECT test_id, brand_no AS v, sum(weight) AS w FROM near WHERE brand_no IS NOT NULL GROUP BY 1, 2),
imp AS (SELECT test_id, 'p_size' AS feature, sum(weight * p_size) / sum(weight) AS imputed FROM near WHERE p_size IS NOT NULL GROUP BY 1
        UNION ALL
        SELECT test_id, 'brand_no', v FROM (
          SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(w, 12) DESC, v) AS r FROM votes) WHERE r = 1)"""


def prt_masked(spark, sf_dir, k=10):
    """Test cells hidden, contexts and imputed values found from what is left: (test table, truth, imputed cells)."""
    d = tables.prt(spark, sf_dir)
    train = d.filter("split = 'train'")
    masked, truth = split.mask_cells(d.filter("split = 'test'").select("row_id", *PF), PF, 0.3)
    masked = reuse(masked)  # counted, packed and filled
    sc = StandardScaler(PF).fit(d)
    vec = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in PF])  # a missing cell is at the train mean
    ctx = retrieve.top_k_context(sc.transform(masked).withColumn("v", vec), sc.transform(train).withColumn("v", vec), "v", k)
    return masked, truth.withColumnRenamed("row_id", "test_id"), predict.impute_cells(ctx, train, PF, categorical=CAT)


@register("m3_impute_cells", "WITH " + IMP_SQL + """
SELECT k.row_id AS test_id, """ + ", ".join(
    f"round(coalesce(k.{c}, max(CASE WHEN i.feature = '{c}' THEN imputed END)), 6) AS {c}" for c in PF) + """
FROM mk k LEFT JOIN imp i ON k.row_id = i.test_id WHERE k.split = 'test' GROUP BY k.row_id, k.p_size, k.brand_no""")
def m3_impute_cells(spark, sf_dir):
    """The masked test table with its gaps filled; observed cells are kept."""
    masked, _, imp = prt_masked(spark, sf_dir)
    return predict.fill_gaps(masked.withColumnRenamed("row_id", "test_id"), imp, PF).select("test_id", *[r6(c, c) for c in PF])


@register("m9_snap_to_category", "WITH " + IMP_SQL + """,
known AS (SELECT DISTINCT p_size AS kv FROM prt WHERE split = 'train' AND p_size IS NOT NULL),
sn AS (SELECT i.test_id, arg_min(kv, (abs(kv - i.imputed), kv)) AS snapped
       FROM imp i, known WHERE i.feature = 'p_size' GROUP BY i.test_id)
SELECT test_id, snapped AS p_size FROM sn""")
def m9_snap_to_category(spark, sf_dir):
    _, _, imp = prt_masked(spark, sf_dir)
    train = tables.prt(spark, sf_dir).filter("split = 'train' AND p_size IS NOT NULL")
    known = [r[0] for r in train.select("p_size").distinct().collect()]  # the category list of one column
    s = predict.snap_to_category(imp.filter("feature = 'p_size'"), "imputed", known, out="p_size")
    return s.select("test_id", "p_size")


# ------------------------------------------------------------------ M4 / M5 / M6 / M7
@register("m4_temperature_softmax", "WITH " + VEC_CTX_SQL + f""",
cls AS (SELECT test_id, ty AS class, ln(sum(weight)) AS logit FROM rk WHERE rank <= {K_CTX} GROUP BY 1, 2),
sm AS (SELECT test_id, class, exp(logit / 0.5 - max(logit / 0.5) OVER (PARTITION BY test_id)) AS e FROM cls)
SELECT test_id, class, round(e / sum(e) OVER (PARTITION BY test_id), 6) AS p FROM sm""")
def m4_temperature_softmax(spark, sf_dir):
    _, train, ctx = vec_context(spark, sf_dir)
    lg = predict.class_logits(ctx, train)
    return predict.temperature_softmax(lg, 0.5).select("test_id", "class", r6("p", "p"))


@register("m5_ensemble_average", "WITH " + VEC_CTX_SQL + f""",
m0c AS (SELECT test_id, ty AS class, ln(sum(weight)) AS logit FROM rk WHERE rank <= {K_CTX} GROUP BY 1, 2),
m0e AS (SELECT test_id, class, exp(logit / {TEMP} - max(logit / {TEMP}) OVER (PARTITION BY test_id)) AS e FROM m0c),
m1c AS (SELECT test_id, ty AS class, ln(sum(weight)) AS logit FROM rk WHERE rank <= 10 GROUP BY 1, 2),
m1e AS (SELECT test_id, class, exp(logit / 1.0 - max(logit / 1.0) OVER (PARTITION BY test_id)) AS e FROM m1c),
mem AS (SELECT test_id, class, e / sum(e) OVER (PARTITION BY test_id) AS p FROM m0e UNION ALL
        SELECT test_id, class, e / sum(e) OVER (PARTITION BY test_id) AS p FROM m1e),
av AS (SELECT test_id, class, sum(p) / 2 AS a FROM mem GROUP BY 1, 2)
SELECT test_id, class, round(a / sum(a) OVER (PARTITION BY test_id), 6) AS p FROM av""")
def m5_ensemble_average(spark, sf_dir):
    _, train, ctx = vec_context(spark, sf_dir)
    m0 = predict.predict_classes(ctx, train, TEMP).withColumn("member", F.lit(0))
    m1 = predict.predict_classes(ctx.filter("rank <= 10"), train, 1.0).withColumn("member", F.lit(1))
    return predict.ensemble_average(m0.unionByName(m1), n_members=2).select("test_id", "class", r6("p", "p"))


M6_SQL = "WITH " + tables.VEC_SQL + f""",
tr AS (SELECT * FROM vec WHERE split = 'train'),
ns AS (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS s FROM tr),
sh AS (SELECT tr.*, CAST((row_number() OVER (PARTITION BY y ORDER BY {id_hash_sql('row_id')}, row_id) - 1) % s AS INTEGER)
              AS shard FROM tr, ns),
sz AS (SELECT shard, count(*) AS n FROM sh GROUP BY shard),
wt AS (SELECT shard, n / sum(n) OVER () AS sw FROM sz),
te AS (SELECT * FROM vec WHERE split = 'test')""" + ctx_chain(
    "s", "SELECT r.shard, t.row_id AS test_id, r.row_id AS train_id, r.y AS ty, "
         "list_dot_product(CAST(t.emb AS DOUBLE[]), CAST(r.emb AS DOUBLE[])) / sqrt(len(t.emb)) AS score "
         "FROM te t JOIN sh r ON TRUE", "shard,") + f""",
scls AS (SELECT shard, test_id, ty AS class, ln(sum(weight)) AS logit FROM srk WHERE rank <= {K_CTX} GROUP BY 1, 2, 3),
sse AS (SELECT shard, test_id, class,
               exp(logit / {TEMP} - max(logit / {TEMP}) OVER (PARTITION BY shard, test_id)) AS e FROM scls),
sp AS (SELECT shard, test_id, class, e / sum(e) OVER (PARTITION BY shard, test_id) AS p FROM sse),
ws AS (SELECT sum(sw) AS tot FROM wt)
SELECT test_id, class, round(sum(p * sw) / max(tot), 6) AS p FROM sp JOIN wt ON sp.shard = wt.shard, ws GROUP BY 1, 2"""


@register("m6_sharded_predict", M6_SQL)
def m6_sharded_predict(spark, sf_dir):
    v = tables.vec(spark, sf_dir)
    test, train = v.filter("split = 'test'"), v.filter("split = 'train'")
    sh = split.stratified_shards(train, 100)
    sizes = sh.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    ctx = retrieve.top_k_context(test, sh, "emb", K_CTX, shard="shard")
    probs = predict.predict_classes(ctx, sh, TEMP, keys=["shard"])
    return predict.sharded_average(probs, sizes).select("test_id", "class", r6("p", "p"))


@register("m7_align_classes", "WITH " + PROBS_SQL + """,
gc AS (SELECT DISTINCT y AS class FROM vec WHERE split = 'train'),
rows_ AS (SELECT DISTINCT test_id FROM probs),
g AS (SELECT r.test_id, gc.class, coalesce(p.p, 0) AS p FROM rows_ r CROSS JOIN gc
      LEFT JOIN probs p ON p.test_id = r.test_id AND p.class = gc.class),
t AS (SELECT *, sum(p) OVER (PARTITION BY test_id) AS tot, count(*) OVER (PARTITION BY test_id) AS k FROM g)
SELECT test_id, class, round(CASE WHEN tot = 0 THEN 1.0 / k ELSE p / tot END, 6) AS p FROM t""")
def m7_align_classes(spark, sf_dir):
    _, probs = vec_probs(spark, sf_dir)
    classes = tables.vec(spark, sf_dir).filter("split = 'train'").select(F.col("y").alias("class")).distinct()
    return predict.align_classes(probs, classes).select("test_id", "class", r6("p", "p"))


@register("m8b_sharded_argmax", M6_SQL.replace(
    "SELECT test_id, class, round(sum(p * sw) / max(tot), 6) AS p FROM sp JOIN wt ON sp.shard = wt.shard, ws GROUP BY 1, 2",
    """, fin AS (SELECT test_id, class, sum(p * sw) / max(tot) AS p FROM sp JOIN wt ON sp.shard = wt.shard, ws GROUP BY 1, 2)
SELECT test_id, arg_min(class, (-p, class)) AS pred FROM fin GROUP BY test_id""").replace(
    "ws AS (SELECT sum(sw) AS tot FROM wt)\n", "ws AS (SELECT sum(sw) AS tot FROM wt)"))
def m8b_sharded_argmax(spark, sf_dir):
    p = m6_sharded_predict(spark, sf_dir)
    return predict.argmax_class(p).select("test_id", "pred")


M10_SQL = "WITH " + VEC_CTX_SQL + ",\n" + ASSIGN_SQL + f""",
trg AS (SELECT DISTINCT a.cluster_id, r.train_id FROM rk r JOIN asg a ON r.test_id = a.test_id WHERE r.rank <= {K_CTX}),
vx AS (SELECT row_id, y, generate_subscripts(emb, 1) AS i, CAST(unnest(emb) AS DOUBLE) AS x FROM vec),
cent AS (SELECT t.cluster_id, v.y AS class, v.i, avg(v.x) AS c FROM trg t JOIN vx v ON v.row_id = t.train_id GROUP BY 1, 2, 3),
dist AS (SELECT a.cluster_id, a.test_id, c.class, sum((v.x - c.c) * (v.x - c.c)) AS d
         FROM asg a JOIN vx v ON v.row_id = a.test_id JOIN cent c ON c.cluster_id = a.cluster_id AND c.i = v.i
         GROUP BY 1, 2, 3),
grid AS (SELECT a.cluster_id, a.test_id, CAST(g.cls AS BIGINT) AS class FROM asg a, range(10) g(cls))
SELECT g.cluster_id, g.test_id, g.class, round(coalesce(-d.d, -1e300), 6) AS score
FROM grid g LEFT JOIN dist d ON g.cluster_id = d.cluster_id AND g.test_id = d.test_id AND g.class = d.class"""


@register("m10_score_with_model", M10_SQL)
def m10_score_with_model(spark, sf_dir):
    """Nearest-centroid user model per cluster group (a stand-in user callable)."""
    import numpy as np
    test, train, ctx = vec_context(spark, sf_dir)
    asg = _assign(ctx)
    tr_ids, te_ids = retrieve.cluster_contexts(ctx, asg)
    trg = tr_ids.join(train.select(F.col("row_id").alias("train_id"), "y", "emb"), "train_id") \
        .withColumnRenamed("train_id", "row_id")
    teg = te_ids.join(test.select(F.col("row_id").alias("test_id"), "emb"), "test_id") \
        .withColumnRenamed("test_id", "row_id")
    cols = [f"e{i}" for i in range(64)]
    trg = trg.select("cluster_id", "row_id", "y", *[F.col("emb")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    teg = teg.select("cluster_id", "row_id", *[F.col("emb")[i].cast("double").alias(c) for i, c in enumerate(cols)])

    n_classes = train.agg(F.max("y")).first()[0] + 1

    def centroid_model(X, y, Xt):
        classes = np.arange(n_classes)
        cents = np.stack([X[y == c].mean(axis=0) if (y == c).any() else np.full(X.shape[1], np.inf)
                          for c in classes])
        d = ((Xt[:, None, :] - cents[None, :, :]) ** 2).sum(-1)
        return -np.where(np.isfinite(d), d, 1e300)

    out = predict.score_with_model(trg, teg, "cluster_id", centroid_model, cols)
    return out.select("cluster_id", "test_id", "class", r6("score", "score"))


# ------------------------------------------------------------------ metrics V2-V9
@register("v2_f1", "WITH " + PROBS_SQL + """,
cl AS (SELECT y AS c FROM predtab UNION SELECT pred FROM predtab),
f AS (SELECT c, sum(CASE WHEN y = c AND pred = c THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN y <> c AND pred = c THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN y = c AND pred <> c THEN 1 ELSE 0 END) AS fn FROM cl, predtab GROUP BY c)
SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS f1 FROM f""")
def v2_f1(spark, sf_dir):
    _, _, pt = vec_pred(spark, sf_dir)
    return metrics.f1(pt).select(r6("f1", "f1"))


@register("v2_f1_binary", "WITH " + PROBS_SQL + """
SELECT round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND pred = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND pred <> 1) AS fn FROM predtab)""")
def v2_f1_binary(spark, sf_dir):
    """Of class 1 against all others."""
    _, _, pt = vec_pred(spark, sf_dir)
    return metrics.f1(pt, average="binary", pos_label=1).select(r6("f1", "f1"))


@register("v3_log_loss", "WITH " + PROBS_SQL + """,
pn AS (SELECT test_id, class, p / sum(p) OVER (PARTITION BY test_id) AS p FROM probs)
SELECT round(avg(-ln(greatest(least(coalesce(pn.p, 0), 1 - 1e-15), 1e-15))), 6) AS logloss
FROM truth LEFT JOIN pn ON truth.test_id = pn.test_id AND truth.y = pn.class""")
def v3_log_loss(spark, sf_dir):
    test, probs = vec_probs(spark, sf_dir)
    truth = test.select(F.col("row_id").alias("test_id"), "y")
    return metrics.log_loss(probs, truth).select(r6("logloss", "logloss"))


@register("v4_ece", "WITH " + PROBS_SQL + """,
b AS (SELECT *, CASE """ + " ".join(f"WHEN p_max > {i / 10} AND p_max <= {(i + 1) / 10} THEN {i}" for i in range(10))
          + """ END AS bin FROM predtab),
per AS (SELECT bin, count(*) AS c, avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS acc, avg(p_max) AS conf
        FROM b GROUP BY bin),
tot AS (SELECT sum(c) AS n FROM per)
SELECT round(sum(c / n * abs(acc - conf)), 6) AS ece FROM per, tot WHERE bin IS NOT NULL""")
def v4_ece(spark, sf_dir):
    _, _, pt = vec_pred(spark, sf_dir)
    return metrics.ece(pt).select(r6("ece", "ece"))


AUC_SQL = """
g AS (SELECT score, count(*) AS c, sum(label) AS pos FROM sc GROUP BY score),
mr AS (SELECT *, sum(c) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c + (c + 1) / 2.0 AS mid
       FROM g),
a AS (SELECT sum(mid * pos) AS rs, sum(pos) AS np, sum(c) AS n FROM mr)
SELECT round(CASE WHEN np = 0 OR n - np = 0 THEN NULL ELSE (rs - np * (np + 1) / 2.0) / (np * (n - np)) END, 6) AS auc
FROM a"""


@register("v5_auc_binary", "WITH " + PROBS_SQL + """,
sc AS (SELECT t.test_id, CASE WHEN t.y = 1 THEN 1 ELSE 0 END AS label, coalesce(p.p, 0) AS score
       FROM truth t LEFT JOIN probs p ON t.test_id = p.test_id AND p.class = 1),""" + AUC_SQL)
def v5_auc_binary(spark, sf_dir):
    test, probs = vec_probs(spark, sf_dir)
    sc = (test.select(F.col("row_id").alias("test_id"), (F.col("y") == 1).cast("int").alias("label"))
          .join(probs.filter("class = 1").select("test_id", F.col("p").alias("score")), "test_id", "left")
          .fillna(0.0, ["score"]))
    return metrics.auc_binary(sc).select(r6("auc", "auc"))


@register("v6_auc_ovo", "WITH " + PROBS_SQL + """,
ycls AS (SELECT DISTINCT y AS c FROM truth),
pr AS (SELECT a.c AS a, b.c AS b FROM ycls a, ycls b WHERE a.c <> b.c),
sc AS (SELECT pr.a, pr.b, t.test_id, CASE WHEN t.y = pr.a THEN 1 ELSE 0 END AS label, coalesce(p.p, 0) AS score
       FROM pr JOIN truth t ON t.y = pr.a OR t.y = pr.b LEFT JOIN probs p ON p.test_id = t.test_id AND p.class = pr.a),
g AS (SELECT a, b, score, count(*) AS c, sum(label) AS pos FROM sc GROUP BY a, b, score),
mr AS (SELECT *, sum(c) OVER (PARTITION BY a, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 - c + (c + 1) / 2.0 AS mid FROM g),
au AS (SELECT a, b, (sum(mid * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(c) - sum(pos))) AS auc
       FROM mr GROUP BY a, b)
SELECT round(avg(auc), 6) AS auc_ovo FROM au""")
def v6_auc_ovo(spark, sf_dir):
    test, probs = vec_probs(spark, sf_dir)
    truth = test.select(F.col("row_id").alias("test_id"), "y")
    return metrics.auc_ovo(probs, truth).select(r6("auc_ovo", "auc_ovo"))


@register("v7_rmse", "WITH " + PRT_Z_SQL + """,
ts AS (SELECT stddev_samp(y) AS s FROM prt WHERE split = 'train')
SELECT round(sqrt(avg(pow((pred - rtab.y) / s, 2))), 6) AS rmse FROM rtab, ts""")
def v7_rmse(spark, sf_dir):
    """On the standardised target, as predictions are scored before they are scaled back."""
    from ctxtab.operators.scale import TargetScaler
    d, _, pr = prt_preds(spark, sf_dir)
    ts = TargetScaler(ddof=1).fit(d)
    return metrics.rmse(ts.transform(ts.transform(pr, "pred", "pred"), "y", "y")).select(r6("rmse", "rmse"))


@register("v8_r2", "WITH " + PRT_Z_SQL + """
SELECT round(1 - sum(pow(pred - y, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM rtab""")
def v8_r2(spark, sf_dir):
    _, _, pr = prt_preds(spark, sf_dir)
    return metrics.r2(pr).select(r6("r2", "r2"))


@register("v9_imputation_error", "WITH " + IMP_SQL + """,
j AS (SELECT t.*, i.imputed FROM truth_ t LEFT JOIN imp i ON t.test_id = i.test_id AND t.feature = i.feature)
SELECT round(avg(CASE WHEN feature = 'brand_no' THEN CAST(imputed <> value AS DOUBLE) END), 6) AS cat_error,
       round(sqrt(avg(CASE WHEN feature = 'p_size' THEN pow(imputed - value, 2) END)), 6) AS num_rmse, count(*) AS n_cells
FROM j""")
def v9_imputation_error(spark, sf_dir):
    _, truth, imp = prt_masked(spark, sf_dir)
    e = metrics.imputation_error(truth, imp, categorical=CAT)
    return e.select(r6("cat_error", "cat_error"), r6("num_rmse", "num_rmse"), "n_cells")
