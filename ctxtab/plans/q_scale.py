"""Queries for distribution rebalancing and scaling (R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxtab.functions.exprs import r6
from ctxtab.operators import scale
from ctxtab.plans.registry import register
from ctxtab.sources import tables

LF = tables.LINE_FEATURES
W = "WITH " + tables.LINE_SQL


def _line(spark, sf_dir, cols=LF):
    return tables.line(spark, sf_dir).select("row_id", "split", *cols)


def _out(df, cols):
    return df.select("row_id", *[r6(c, c) for c in cols])


def _std_stats_sql(cols, ddof_pop=True, where="split = 'train'"):
    f = "stddev_pop" if ddof_pop else "stddev_samp"
    parts = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif({f}({c}), 0), 1) AS s_{c}" for c in cols)
    return f"st AS (SELECT {parts} FROM line WHERE {where})"


@register("r0_route_columns", W + ",\n" + _std_stats_sql(LF) + "\nSELECT row_id, "
          + ", ".join(f"round({c}, 6) AS {c}" for c in LF) + ", "
          + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}_t" for c in LF) + " FROM line, st")
def r0_route_columns(spark, sf_dir):
    d = _line(spark, sf_dir)
    out = scale.route_columns(d, LF, [], lambda df, cols: scale.standard_scale(df, cols),
                              original_flag=True, discrete_flag=False)
    return _out(out, LF + [c + "_t" for c in LF])


@register("r1_min_max_scale", W + ",\nst AS (SELECT " + ", ".join(
    f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LF) + " FROM line WHERE split = 'train')\nSELECT row_id, "
    + ", ".join(f"round(CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END, 6) AS {c}"
                for c in LF) + " FROM line, st")
def r1_min_max_scale(spark, sf_dir):
    return _out(scale.min_max_scale(_line(spark, sf_dir), LF), LF)


@register("r2_standard_scale", W + ",\n" + _std_stats_sql(LF) + "\nSELECT row_id, "
          + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in LF) + " FROM line, st")
def r2_standard_scale(spark, sf_dir):
    return _out(scale.standard_scale(_line(spark, sf_dir), LF), LF)


def _quantile_sql(c: str, div: int) -> str:
    """SQL twin of the R3 map for one column (grid from train, linear quantiles)."""
    return f"""
tr_{c} AS (SELECT {c} AS x FROM line WHERE split = 'train' AND {c} IS NOT NULL),
n_{c} AS (SELECT count(*) AS n, greatest(least(greatest(count(*) // {div}, 2), count(*)), 1) AS nq FROM tr_{c}),
s_{c} AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM tr_{c}),
g_{c} AS (SELECT k, CASE WHEN nq > 1 THEN k / (nq - 1) ELSE 0.0 END AS ref, n, nq FROM n_{c}, range(nq) t(k)),
h_{c} AS (SELECT k, ref, CASE WHEN nq > 1 THEN (k * (n - 1)) // (nq - 1) ELSE 0 END AS lo,
                 CASE WHEN nq > 1 THEN ((k * (n - 1)) % (nq - 1)) / (nq - 1) ELSE 0.0 END AS fr FROM g_{c}),
q_{c} AS (SELECT h.k, h.ref, CASE WHEN fr = 0 OR a.x = b.x THEN a.x ELSE a.x + fr * (b.x - a.x) END AS qv
          FROM h_{c} h JOIN s_{c} a ON a.i = h.lo JOIN s_{c} b ON b.i = CASE WHEN fr = 0 THEN h.lo ELSE h.lo + 1 END),
u_{c} AS (SELECT qv AS u, min(ref) AS lo, max(ref) AS hi FROM q_{c} GROUP BY qv),
ui_{c} AS (SELECT u, lo, hi, row_number() OVER (ORDER BY u) AS j FROM u_{c}),
ends_{c} AS (SELECT min(lo) AS first_lo, max(hi) AS last_hi FROM u_{c}),
m_{c} AS (SELECT l.row_id, l.{c} AS x, a.u AS u0, a.lo AS l0, a.hi AS h0, a.j
          FROM line l ASOF LEFT JOIN ui_{c} a ON l.{c} >= a.u),
r_{c} AS (SELECT m.row_id, CASE WHEN m.x IS NULL THEN NULL WHEN m.u0 IS NULL THEN e.first_lo
                 WHEN m.x = m.u0 THEN (m.l0 + m.h0) / 2 WHEN b.u IS NULL THEN m.h0
                 ELSE m.h0 + (m.x - m.u0) / (b.u - m.u0) * (b.lo - m.h0) END AS v
          FROM m_{c} m LEFT JOIN ui_{c} b ON b.j = m.j + 1, ends_{c} e)"""


def _wide_sql(exprs: dict[str, str]) -> str:
    first, *rest = list(exprs)
    return (f"\nSELECT r_{first}.row_id, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in exprs.items())
            + f" FROM r_{first} " + " ".join(f"JOIN r_{c} ON r_{first}.row_id = r_{c}.row_id" for c in rest))


@register("r3_quantile_uniform", W + "," + ",".join(_quantile_sql(c, 10) for c in LF) + _wide_sql({c: f"r_{c}.v" for c in LF}))
def r3_quantile_uniform(spark, sf_dir):
    return _out(scale.quantile_uniform(_line(spark, sf_dir), LF, "10"), LF)


@register("r3_all_data", W + "," + ",".join(_quantile_sql(c, 5) for c in LF) + _wide_sql({c: f"r_{c}.v" for c in LF}))
def r3_all_data(spark, sf_dir):
    return _out(scale.quantile_uniform(_line(spark, sf_dir), LF, "all_data"), LF)


def _horner_sql(coefs: list[float], x: str) -> str:
    out = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = f"({out}) * {x} + {c!r}"
    return out


def _probit_sql(p: str) -> str:
    """SQL form of the published AS241 inverse normal CDF (DuckDB has none built in)."""
    from ctxtab.functions import exprs as X
    q = f"({p} - 0.5)"
    t = f"(0.180625 - {q} * {q})"
    rr = f"sqrt(-ln(greatest(least({p}, 1 - {p}), 1e-300)))"
    central = f"{q} * ({_horner_sql(X._AS241_A, t)}) / ({_horner_sql(X._AS241_B, t)})"
    near = f"({_horner_sql(X._AS241_C, f'({rr} - 1.6)')}) / ({_horner_sql(X._AS241_D, f'({rr} - 1.6)')})"
    far = f"({_horner_sql(X._AS241_E, f'({rr} - 5.0)')}) / ({_horner_sql(X._AS241_F, f'({rr} - 5.0)')})"
    tail = f"(CASE WHEN {rr} <= 5.0 THEN {near} ELSE {far} END)"
    return (f"CASE WHEN {p} IS NULL THEN NULL WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END")


def _clip_sql(v: str) -> str:
    return f"least(greatest({v}, {scale.BOUNDS!r}), {1 - scale.BOUNDS!r})"


@register("r4_quantile_norm", W + "," + ",".join(_quantile_sql(c, 5) for c in LF)
          + ",".join([""] + [f"\np_{c} AS (SELECT row_id, {_clip_sql('v')} AS pv FROM r_{c})" for c in LF])
          + "\nSELECT p_l_quantity.row_id, " + ", ".join(f"round({_probit_sql(f'p_{c}.pv')}, 6) AS {c}" for c in LF)
          + " FROM p_l_quantity " + " ".join(f"JOIN p_{c} ON p_l_quantity.row_id = p_{c}.row_id" for c in LF if c != "l_quantity"))
def r4_quantile_norm(spark, sf_dir):
    return _out(scale.quantile_normal(_line(spark, sf_dir), LF, "5"), LF)


@register("r5_robust_scale", W + ",\nst AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}"
    for c in LF) + " FROM line WHERE split = 'train')\nSELECT row_id, " + ", ".join(
    f"round(({c} - m_{c}) / CASE WHEN b_{c} - a_{c} = 0 THEN 1 ELSE (b_{c} - a_{c}) / {scale.Z75_MINUS_Z25} END, 6)"
    f" AS {c}" for c in LF) + " FROM line, st")
def r5_robust_scale(spark, sf_dir):
    return _out(scale.robust_scale(_line(spark, sf_dir), LF), LF)


@register("r6_yeo_johnson")
def r6_yeo_johnson(spark, sf_dir):
    return _out(scale.yeo_johnson(_line(spark, sf_dir), LF), LF)


EVW = "WITH " + tables.EVX_SQL
FIN = "CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END"


@register("r7_log_normal", EVW + """,
c AS (SELECT row_id, split, """ + FIN.format(c="xv") + """ AS xv FROM evx),
m1 AS (SELECT avg(xv) AS mu FROM c WHERE split = 'train'),
f AS (SELECT row_id, split, coalesce(xv, mu) AS xv FROM c, m1),
mn AS (SELECT min(xv) AS lo FROM f WHERE split = 'train'),
lg AS (SELECT row_id, split, CASE WHEN xv + abs(lo) + 1e-10 > 0 THEN ln(xv + abs(lo) + 1e-10) END AS xv FROM f, mn),
m2 AS (SELECT avg(xv) AS mu2 FROM lg WHERE split = 'train')
SELECT row_id, round(coalesce(xv, mu2), 6) AS xv FROM lg, m2""")
def r7_log_normal(spark, sf_dir):
    d = tables.evx(spark, sf_dir).select("row_id", "split", "xv")
    return _out(scale.log_normal(d, ["xv"]), ["xv"])


@register("r8_kdi_uniform")
def r8_kdi_uniform(spark, sf_dir):
    return _out(scale.kdi_uniform(_line(spark, sf_dir), LF, alpha=1.0), LF)


@register("r9_union_transforms", W + """,
st AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_quantity) AS mu,
              coalesce(nullif(stddev_pop(l_quantity), 0), 1) AS sd FROM line WHERE split = 'train')
SELECT row_id, l_quantity, round(CASE WHEN hi = lo THEN 0 ELSE (l_quantity - lo) / (hi - lo) END, 6) AS l_quantity_minmax,
       round((l_quantity - mu) / sd, 6) AS l_quantity_std
FROM line, st""")
def r9_union_transforms(spark, sf_dir):
    d = _line(spark, sf_dir, ["l_quantity"])
    out = scale.union_transforms(d, ["l_quantity"], {"minmax": scale.min_max_scale, "std": scale.standard_scale})
    return out.select("row_id", "l_quantity", r6("l_quantity_minmax", "l_quantity_minmax"),
                      r6("l_quantity_std", "l_quantity_std"))


@register("r11_append_svd")
def r11_append_svd(spark, sf_dir):
    out = scale.append_svd(_line(spark, sf_dir), LF)
    return out.select("row_id", *[r6(c, c) for c in out.columns if c.startswith("svd_")])


@register("r12_mean_impute", EVW + """,
m AS (SELECT avg(""" + FIN.format(c="xv") + """) AS mx, avg(value) AS mv FROM evx WHERE split = 'train')
SELECT row_id, round(coalesce(""" + FIN.format(c="xv") + """, mx), 6) AS xv, round(coalesce(value, mv), 6) AS value
FROM evx, m""")
def r12_mean_impute(spark, sf_dir):
    d = tables.evx(spark, sf_dir).select("row_id", "split", "xv", "value")
    return _out(scale.mean_impute(d, ["xv", "value"]), ["xv", "value"])


def _soft_clip_sql(c):
    return f"""
a_{c} AS (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM line WHERE split = 'train'),
b_{c} AS (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM line, a_{c}
          WHERE split = 'train' AND {c} BETWEEN a_{c}.m - 4 * a_{c}.s AND a_{c}.m + 4 * a_{c}.s),
x_{c} AS (SELECT row_id, greatest(-ln(1 + abs({c})) + (b_{c}.m - 4 * b_{c}.s), {c}) AS v, b_{c}.m + 4 * b_{c}.s AS hi
          FROM line, b_{c}),
y_{c} AS (SELECT row_id, least(ln(1 + abs(v)) + hi, v) AS {c} FROM x_{c})"""


@register("r13_soft_clip_outliers", W + "," + _soft_clip_sql("l_extendedprice") + """
SELECT row_id, round(l_extendedprice, 6) AS l_extendedprice FROM y_l_extendedprice""")
def r13_soft_clip_outliers(spark, sf_dir):
    return _out(scale.soft_clip_outliers(_line(spark, sf_dir, ["l_extendedprice"]), ["l_extendedprice"]),
                ["l_extendedprice"])


@register("r14_train_standardise_clip", W + ",\nst AS (SELECT count(*) AS n, " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in LF) + " FROM line WHERE split = 'train')\nSELECT row_id, "
    + ", ".join(f"round(least(greatest(({c} - m_{c}) / CASE WHEN n <= 1 THEN 1 ELSE coalesce(s_{c}, 0) + 1e-20 END, "
                f"-100), 100), 6) AS {c}" for c in LF) + " FROM line, st")
def r14_train_standardise_clip(spark, sf_dir):
    return _out(scale.train_standardise_clip(_line(spark, sf_dir), LF), LF)


R15_COLS = ["value", "user_id", "props_len", "const"]


@register("r15_scale_by_valid_features", EVW + ",\nst AS (SELECT " + " + ".join(
    f"CAST(coalesce(min({c}) < max({c}), false) AS INTEGER)" for c in R15_COLS) + " AS nv FROM evx)\nSELECT row_id, "
    + ", ".join(f"round({c} * sqrt(6.0 / greatest(nv, 1)), 6) AS {c}" for c in R15_COLS)
    + ", CAST(0 AS DOUBLE) AS pad_4, CAST(0 AS DOUBLE) AS pad_5 FROM evx, st")
def r15_scale_by_valid_features(spark, sf_dir):
    d = tables.evx(spark, sf_dir).select("row_id", *R15_COLS)
    out = scale.scale_by_valid_features(d, R15_COLS, 6)
    return out.select("row_id", *[r6(c, c) for c in R15_COLS], "pad_4", "pad_5")


@register("r16_standardise_target", "WITH " + tables.ORD_SQL + """,
st AS (SELECT avg(y) AS m, stddev_samp(y) AS s FROM ord WHERE split = 'train')
SELECT row_id, round((y - m) / s, 6) AS y_std FROM ord, st""")
def r16_standardise_target(spark, sf_dir):
    d = tables.ord_(spark, sf_dir)
    ts = scale.TargetScaler(ddof=1).fit(d)
    return ts.transform(d).select("row_id", r6("y_std", "y_std"))


@register("r17_inverse_pipeline", W + ",\nst AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM line WHERE split = 'train')\n"
          "SELECT row_id, y, l_linestatus, " + ", ".join(f"round({c}, 6) AS {c}" for c in LF)
          + ", round((l_quantity - m) / s, 6) AS model_l_quantity FROM line, st")
def r17_inverse_pipeline(spark, sf_dir):
    """A chain of all kinds of steps; what a model returns (codes and indicators off by up to 0.4) is undone."""
    from ctxtab.functions.exprs import id_hash
    from ctxtab.operators import inverse as inv
    d = tables.line(spark, sf_dir).select("row_id", "split", "y", "l_linestatus", *LF).withColumn("unit", F.lit("pc"))
    chain = inv.InversePipeline([
        inv.ConstantColumns(["unit"]), inv.PermutedCodes("y", seed=3), inv.OneHot("l_linestatus"), inv.Standardised(LF),
        inv.ExtraColumns(lambda t: scale.append_svd(t, LF)), inv.Reordered(LF, seed=5)])
    z = chain.apply(d)
    noise = F.pmod(id_hash("row_id", 21), F.lit(801)) / 1000.0 - 0.4
    z = z.withColumns({c: F.col(c) + noise for c in z.columns if c == "y" or c.startswith("l_linestatus__")})
    z = z.withColumn("y", F.when(F.col("y") > 1.5, F.col("y") + 7).otherwise(F.col("y")))  # beyond the last code
    back = chain.undo(z).where("unit = 'pc'")
    model = z.select("row_id", r6("l_quantity", "model_l_quantity"))
    return back.select("row_id", "y", "l_linestatus", *[r6(c, c) for c in LF]).join(model, "row_id")
