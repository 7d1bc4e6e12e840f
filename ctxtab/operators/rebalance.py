"""Members of an ensemble with rebalancing steps, fitted together.

A member is a JSON-style dict: ``PolynomialInteractionGenerator`` {max_interaction_features},
``RebalanceFeatureDistribution`` {worker_tags, discrete_flag, original_flag, svd_tag},
``CategoricalFeatureEncoder`` {encoding_strategy}, ``FingerprintFeatureEncoder`` (bool),
``FeatureShuffler`` {mode} and ``retrieval_config`` {retrieval_len}.  Its steps run in this order:
interactions, valid features, rebalancing (with the appended singular directions), encoding,
fingerprint, feature order.

Fit planner.  A step is a generator: it asks for statistics of expressions, gets their values, and
ends with new expressions.  Steps of all members that wait for statistics are served by one
aggregation, equal requests once, so the number of passes follows the longest chain and not the
number of steps or members; what a member has fitted is one projection.  Transforms through a table
of values (quantile and kernel maps) need the rows themselves: they are applied between two such
rounds, on the projection reached so far.
"""

from __future__ import annotations

from collections.abc import Callable, Generator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxtab.functions.exprs import nonfinite_to_null
from ctxtab.operators import encode, power, scale
from ctxtab.operators.meta import resolve_tag, shuffle_features

Exprs = dict[str, Column]
Chain = Generator[dict, dict, Exprs]

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "avg": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "count": F.count, "sum": F.sum,
    "q25": lambda x: F.percentile(x, F.lit(0.25)), "q50": lambda x: F.percentile(x, F.lit(0.5)), "q75": lambda x: F.percentile(x, F.lit(0.75))}


def fit_together(df: DataFrame, chains: dict, split: str = "split") -> tuple[dict, int]:
    """Results of all ``chains`` (generators), and the number of aggregations that served them.

    A chain yields {key: (aggregate, expression, rows)}, rows being ``all``, ``train`` or ``test``.
    """
    done, asked, passes = {}, {}, 0

    def step(name, value):
        try:
            asked[name] = chains[name].send(value)
        except StopIteration as end:
            asked.pop(name, None)
            done[name] = end.value

    for name in list(chains):
        step(name, None)
    while asked:
        wanted: dict[str, Column] = {}
        place = {}
        for name, request in asked.items():
            for key, (kind, x, rows) in request.items():
                col = AGGREGATES[kind](x if rows == "all" else F.when(F.col(split) == rows, x))
                label = col._jc.toString()
                place[name, key] = label
                wanted.setdefault(label, col)
        row = df.agg(*[c.alias(str(i)) for i, c in enumerate(wanted.values())]).first()
        passes += 1
        value = dict(zip(wanted, row))
        for name, request in list(asked.items()):
            step(name, {key: value[place[name, key]] for key in request})
    return done, passes


# ------------------------------------------------------------------ steps over expressions
def _fill(x: Exprs) -> Chain:
    """Non-finite values and gaps become the train mean (0 for a column without values)."""
    x = {c: nonfinite_to_null(e) for c, e in x.items()}
    m = yield {c: ("avg", e, "train") for c, e in x.items()}
    return {c: F.coalesce(e, F.lit(float(m[c] or 0.0))) for c, e in x.items()}


def _standard(x: Exprs, center: bool = True) -> Chain:
    st = yield {(k, c): (k, e, "train") for c, e in x.items() for k in ("avg", "std")}
    return {c: (e - F.lit(float(st["avg", c] or 0.0) if center else 0.0)) / F.lit(float(st["std", c] or 1.0)) for c, e in x.items()}


def _robust(x: Exprs) -> Chain:
    st = yield {(k, c): (k, e, "train") for c, e in x.items() for k in ("q25", "q50", "q75")}
    out = {}
    for c, e in x.items():
        low, mid, high = (st[k, c] for k in ("q25", "q50", "q75"))
        out[c] = e if mid is None else (e - F.lit(mid)) / F.lit((high - low) / scale.Z75_MINUS_Z25 or 1.0)
    return out


def _log_normal(x: Exprs) -> Chain:
    x = yield from _fill(x)
    low = yield {c: ("min", e, "train") for c, e in x.items()}
    return (yield from _fill({c: F.log(e + F.lit(abs(float(low[c] or 0.0))) + F.lit(1e-10)) for c, e in x.items()}))


def _identity(x: Exprs) -> Chain:
    yield from ()
    return x


EXPRESSION_TAGS = {"robust": _robust, "logNormal": _log_normal, "identity": _identity}


def _interactions(x: Exprs, most: int | None, seed: int) -> Chain:
    sd = yield {c: ("std", e, "all") for c, e in x.items()}
    scaled = {c: e / F.lit(float(sd[c] or 1.0)) for c, e in x.items()}
    names = list(x)
    pairs = encode.interaction_pairs(len(names), 100 if most is None else most, seed)
    return scaled | {f"{names[a]}_x_{names[b]}": scaled[names[a]] * scaled[names[b]] for a, b in pairs}


def _valid(x: Exprs) -> Chain:
    """Columns that are not constant (a constant one with gaps stays) and have values in train and in test."""
    st = yield {"rows": ("count", F.lit(1), "all"), "test": ("count", F.lit(1), "test"),
                **{(k, c, r): (k, e, r) for c, e in x.items() for k, r in (("count", "all"), ("min", "all"), ("max", "all"), ("count", "train"), ("count", "test"))}}
    keep = {}
    for c, e in x.items():
        flat = st["count", c, "all"] == st["rows"] and st["min", c, "all"] == st["max", c, "all"]
        if not flat and st["count", c, "train"] and (st["count", c, "test"] or not st["test"]):
            keep[c] = e
    if not keep:
        raise ValueError("no feature tells any two rows apart")
    return keep


# ------------------------------------------------------------------ transforms through tables of values
def _table_tag(tag: str):
    """(df, cols) -> df for a tag that maps values through a table, or None."""
    if tag.startswith("quantile_"):
        _, shape, variant = tag.split("_", 2)
        fn = scale.quantile_uniform if shape == "uniform" else scale.quantile_normal
        return lambda df, cols: fn(df, cols, variant)
    if tag.startswith("kdi_"):
        shape, _, alpha = tag[4:].partition("_alpha_")
        return lambda df, cols: scale.kdi_uniform(df, cols, float(alpha or 1.0), "uniform" if shape == "uni" else "normal")
    return scale.yeo_johnson if tag == "power" else None


def _tags(tags) -> list[tuple[str, str]]:
    """(name of the output, tag) of each transform; a union tag is two transforms side by side."""
    out = []
    for i, tag in enumerate(tags or ()):
        tag = resolve_tag(tag)
        both = ("quantile_norm_10", "kdi_uni") if tag == "norm_and_kdi" else (tag,)
        out += [(f"{i}{'ab'[j] if len(both) > 1 else ''}", t) for j, t in enumerate(both)]
    return out


def _first_part(features: list[str], categorical: list[str], member: dict, seed: int) -> Chain:
    """Interactions, valid features, and the rebalancing that expressions can say; names tell the routes apart."""
    x = {c: F.col(f"`{c}`").cast("double") for c in features}
    if (poly := member.get("PolynomialInteractionGenerator")) is not None:
        x = yield from _interactions(x, poly.get("max_interaction_features"), seed)
    x = yield from _valid(x)
    rb = member.get("RebalanceFeatureDistribution")
    kinds = {"cat": [c for c in x if c in categorical], "cont": [c for c in x if c not in categorical]}
    if rb is None:
        return {f"plain:{c}": x[c] for c in x}
    original, discrete = rb.get("original_flag", False), rb.get("discrete_flag", False)
    routed = kinds["cat"] + kinds["cont"] if discrete else kinds["cont"]
    out = {f"plain:{c}": x[c] for c in x} if original else {} if discrete else {f"plain:{c}": x[c] for c in kinds["cat"]}
    for name, tag in _tags(rb.get("worker_tags")):
        part = {c: x[c] for c in routed}
        if tag in EXPRESSION_TAGS and part:
            part = yield from EXPRESSION_TAGS[tag](part)
        out |= {f"{name}:{c}": e for c, e in part.items()}
    return out


def _svd(table: DataFrame, cols: list[str], n_features: int, keep: list[str]) -> tuple[DataFrame, list[str]]:
    n = table.where("split = 'train'").count()
    out = scale.append_svd(table, cols, n_components=min(len(cols), max(1, min(n // 10 + 1, n_features // 2))))
    more = [c for c in out.columns if c.startswith("svd_")]
    return out.select(*keep, *cols, *more), cols + more


def member_tables(df: DataFrame, features: list[str], categorical: list[str], members, seed: int = 0,
                  keep: tuple[str, ...] = ("row_id", "split", "y_code")) -> list[tuple[DataFrame, list[str]]]:
    """(table, feature order) of each member; the statistics of all members are gathered together.

    Missing values stay missing where a member's transforms leave them.  Categorical features are
    numbers (codes); ``encoding_strategy`` ``ordinal*`` gives them codes by sorted value, ``onehot``
    indicators, anything else leaves them.
    """
    chains = {i: _first_part(features, categorical, m, seed + i) for i, m in enumerate(members)}
    fitted, _ = fit_together(df, chains)
    out = []
    for i, m in enumerate(members):
        rb = m.get("RebalanceFeatureDistribution") or {}
        exprs = fitted[i]
        name = {k: f"f{j}" for j, k in enumerate(exprs)}
        table = df.select(*keep, *[e.alias(name[k]) for k, e in exprs.items()])
        for tag_name, tag in _tags(rb.get("worker_tags")):
            cols = [name[k] for k in exprs if k.startswith(f"{tag_name}:")]
            if cols and (fn := _table_tag(tag)):
                table = fn(table, cols).select(*keep, *name.values())
        cols = list(name.values())
        discrete = rb.get("discrete_flag", False) and not rb.get("original_flag", False)
        cats = [] if discrete else [name[k] for k in exprs if k.startswith("plain:") and k[6:] in categorical]
        if rb.get("svd_tag") == "svd" and len(cols) >= 2:
            table, cols = _svd(table, cols, len({k.partition(":")[2] for k in exprs}), list(keep))
        strategy = str((m.get("CategoricalFeatureEncoder") or {}).get("encoding_strategy"))
        if cats and strategy.startswith("ordinal"):
            table = encode.ordinal_encode(table, cats).select(*keep, *cols)
        elif cats and strategy == "onehot":
            table = encode.one_hot(table, cats)
            table = table.toDF(*[c.replace(".", "_") for c in table.columns])
            cols = [c for c in table.columns if c not in keep]
        if m.get("FingerprintFeatureEncoder"):
            table = encode.row_fingerprint(table, cols, salt=seed + i)
            cols = [*cols, "fingerprint"]
        mode = (m.get("FeatureShuffler") or {}).get("mode")
        order, _ = shuffle_features(cols, cats, mode, offset=i, seed=seed + i)
        out.append((table, order))
    return out
