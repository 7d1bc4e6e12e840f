"""Queries over retrieval and prediction (Q*, M*) on the ``vec`` task table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxtab.functions.exprs import r6
from ctxtab.operators import metrics, predict, retrieve
from ctxtab.plans.registry import register
from ctxtab.sources import tables

K_CTX = 15
TEMP = 0.9


def _vec_sides(spark, sf_dir):
    v = tables.vec(spark, sf_dir)
    return v.filter("split = 'test'"), v.filter("split = 'train'")


# SQL twin of the pair scores and top-k context (the oracle may enumerate pairs)
VEC_CTX_SQL = tables.VEC_SQL + """,
pairs AS (
  SELECT t.row_id AS test_id, r.row_id AS train_id, r.y AS ty,
         list_dot_product(CAST(t.emb AS DOUBLE[]), CAST(r.emb AS DOUBLE[])) / sqrt(len(t.emb)) AS score
  FROM vec t JOIN vec r ON t.split = 'test' AND r.split = 'train'),
mx AS (SELECT *, max(score) OVER (PARTITION BY test_id) AS m FROM pairs),
st AS (SELECT test_id, count(*) AS n_ctx, max(m) AS max_score, max(m) + ln(sum(exp(score - m))) AS lse
       FROM mx GROUP BY test_id),
rk AS (
  SELECT p.test_id, p.train_id, p.ty, p.score, st.lse, st.n_ctx, exp(p.score - st.lse) AS weight,
         row_number() OVER (PARTITION BY p.test_id ORDER BY p.score DESC, p.train_id) AS rank
  FROM pairs p JOIN st ON p.test_id = st.test_id)"""


def vec_context(spark, sf_dir, k=K_CTX):
    test, train = _vec_sides(spark, sf_dir)
    return test, train, retrieve.top_k_context(test, train, "emb", k)


@register("q1_context_scores", "WITH " + VEC_CTX_SQL + """
SELECT test_id, n_ctx, round(max_score, 6) AS max_score, round(lse, 6) AS lse FROM st""")
def q1_context_scores(spark, sf_dir):
    test, train = _vec_sides(spark, sf_dir)
    s = retrieve.context_scores(test, train, "emb")
    return s.select("test_id", "n_ctx", r6("max_score", "max_score"), r6("lse", "lse"))


@register("q4_top_k_context", "WITH " + VEC_CTX_SQL + f"""
SELECT test_id, train_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, round(weight, 6) AS weight
FROM rk WHERE rank <= {K_CTX}""")
def q4_top_k_context(spark, sf_dir):
    _, _, ctx = vec_context(spark, sf_dir)
    return ctx.select("test_id", "train_id", "rank", r6("score", "score"), r6("weight", "weight"))


PROBS_SQL = VEC_CTX_SQL + f""",
cls AS (SELECT test_id, ty AS class, ln(sum(weight)) AS logit FROM rk WHERE rank <= {K_CTX} GROUP BY 1, 2),
sm AS (SELECT test_id, class, exp(logit / {TEMP} - max(logit / {TEMP}) OVER (PARTITION BY test_id)) AS e FROM cls),
probs AS (SELECT test_id, class, e / sum(e) OVER (PARTITION BY test_id) AS p FROM sm),
am AS (SELECT test_id, arg_min(class, (-p, class)) AS pred, max(p) AS p_max FROM probs GROUP BY test_id),
truth AS (SELECT row_id AS test_id, y FROM vec WHERE split = 'test'),
predtab AS (SELECT am.test_id, truth.y, am.pred, am.p_max FROM am JOIN truth ON am.test_id = truth.test_id)"""


def vec_probs(spark, sf_dir):
    test, train, ctx = vec_context(spark, sf_dir)
    return test, predict.predict_classes(ctx, train, TEMP)


def vec_pred(spark, sf_dir):
    test, probs = vec_probs(spark, sf_dir)
    am = predict.argmax_class(probs)
    return test, probs, am.join(test.select(F.col("row_id").alias("test_id"), "y"), "test_id")


@register("m1_predict_classes", "WITH " + PROBS_SQL + """
SELECT test_id, class, round(p, 6) AS p FROM probs""")
def m1_predict_classes(spark, sf_dir):
    _, probs = vec_probs(spark, sf_dir)
    return probs.select("test_id", "class", r6("p", "p"))


@register("m8_argmax_class", "WITH " + PROBS_SQL + """
SELECT test_id, y, pred, round(p_max, 6) AS p_max FROM predtab""")
def m8_argmax_class(spark, sf_dir):
    _, _, pt = vec_pred(spark, sf_dir)
    return pt.select("test_id", "y", "pred", r6("p_max", "p_max"))


@register("v1_accuracy", "WITH " + PROBS_SQL + """
SELECT round(avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM predtab""")
def v1_accuracy(spark, sf_dir):
    _, _, pt = vec_pred(spark, sf_dir)
    return metrics.accuracy(pt).select(r6("accuracy", "accuracy"))
