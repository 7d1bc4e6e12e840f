"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets.  Sources in code point order (null last) weigh 5, 2, 1, repeating, and share all
   words; a target stops at three times its source's words, and the excess is shared again by
   weight among the others until none is above.
2. Quotas.  The mix is apportioned in blocks of ``BLOCK`` words: each block goes to the source with
   the highest quotient target / (2 * blocks so far + 1).  A source's words are dealt by a hash into
   shards of about ``SHARD_WORDS`` (so that a rare source has few, full ones), and its blocks are
   apportioned among these in the same way.  The divisor that gives just so many blocks is found by
   counting, for all sources at once, how many a few trial divisors would give; shards with equal
   quotients at the end are served in order.  So quotas are whole, and add up to the target but for
   a block, however many shards there are.
3. Selection.  The words of a source in a shard are one sequence, documents in seeded hash order.
   A quota is whole passes over it and, for what is left, blocks spread evenly from a seeded
   starting phase and a last, partial one; how many words of a document that takes follows from its
   place alone.

The plan moves only ids, sizes and hashes until the rows are final.  One row for each source
reaches the driver; the per-shard tables stay in Spark.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ctxtab.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 16
SHARD_WORDS = 1 << 17
EMPTY_SHARDS = 1 << 20  # that documents without words are dealt into
TRIALS = 15            # divisors tried at once for each source
RESULTS = ("size", "source_size", "target", "taken", "passes", "rest")
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Target of each source: all words by weight, none above ``most`` times its own size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set[str | None] = set()
    total = sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        among = sum(weight[s] for s in order if s not in full)
        out = {s: float(most * sizes[s]) if s in full else left * weight[s] / among for s in order}
        above = {s for s in order if s not in full and out[s] > most * sizes[s]}
        if not above:
            return out
        full |= above


def sainte_lague(target: np.ndarray, limit: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients target / (2 k + 1), at most ``limit`` each; ties to the first source."""
    def above(q: float) -> np.ndarray:
        return np.minimum(limit, np.floor((target / q + 1) / 2).astype(np.int64))

    got = np.zeros(len(target), np.int64)
    seats = min(int(seats), int(limit[target > 0].sum()))
    if seats <= 0:
        return got
    low, high = 1e-12, float(target.max()) * 2  # quotients of at least ``high`` give no more than the seats
    for _ in range(100):
        mid = (low * high) ** 0.5
        low, high = (low, mid) if above(mid).sum() <= seats else (mid, high)
    got = above(high)
    heap = [(-target[i] / (2 * got[i] + 1), i) for i in range(len(target)) if got[i] < limit[i] and target[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < limit[i]:
            heapq.heappush(heap, (-target[i] / (2 * got[i] + 1), i))
    return got


def _seats(divisor):
    """Blocks of a shard whose quotients are ``divisor`` or more: words / (2 k + 1) >= divisor for each k < blocks."""
    return F.least(F.ceil(F.col("_most") * F.col("_words") / F.col("_block")), F.floor((F.col("_words") / divisor + 1) / 2)).cast("long")


def _divisors(parts: DataFrame, seats: dict) -> dict:
    """{source: (divisor, blocks it gives)}: the least trial divisor that gives no more than the source's blocks."""
    found = {}
    edge = {s: (0.0, w * 2.0 + 1.0) for s, (n, w) in seats.items() if n}  # too many blocks (or none tried), too few
    for r in parts.groupBy("_none", "_name").agg(F.max("_words").alias("w")).collect():
        s = None if r["_none"] else r["_name"]
        if s in edge:
            edge[s] = (0.0, 2.0 * r["w"] + 1.0)
            found[s] = (edge[s][1], 0)
    spark = parts.sparkSession
    while edge:
        tried = {s: [lo + (hi - lo) * (i + 1) / (TRIALS + 1) for i in range(TRIALS)] for s, (lo, hi) in edge.items()}
        table = spark.createDataFrame([(s is None, s or "", t) for s, t in tried.items()], "_none boolean, _name string, _t array<double>")
        got = (parts.join(F.broadcast(table), ["_none", "_name"]).groupBy("_none", "_name")
               .agg(F.array(*[F.sum(_seats(F.get("_t", F.lit(i)))) for i in range(TRIALS)]).alias("n")).collect())
        for r in got:
            s = None if r["_none"] else r["_name"]
            lo, hi = edge[s]
            for t, n in zip(tried[s], r["n"]):
                if n > seats[s][0]:
                    lo = max(lo, t)
                elif t < hi:
                    hi, found[s] = t, (t, n)
                    break
            # an exact fit, no room for more, or quotients that a double does not tell apart
            if found[s][1] == seats[s][0] or (lo, hi) == edge[s] or hi - lo <= 1e-12 * hi:
                del edge[s]
            else:
                edge[s] = (lo, hi)
    return found


def _quotas(parts: DataFrame, words: dict, target: dict, block: int, most: int) -> DataFrame:
    """(_shard, _none, _name, _passes, _rest, _blocks) of each part (_shard, _none, _name, _words)."""
    spark = parts.sparkSession
    order = sorted(words, key=lambda s: (s is None, s or ""))
    t, n = np.array([target[s] for s in order], float), np.array([words[s] for s in order], np.int64)
    quota = sainte_lague(t, -(-most * n // block), round(t.sum() / block))
    whole = {s for s in order if target[s] >= most * words[s]}  # all their words as often as they may go
    seats = {s: (int(q), words[s]) for s, q in zip(order, quota) if s not in whole}
    parts = parts.withColumn("_block", F.lit(block)).withColumn("_most", F.lit(most))
    found = _divisors(parts, seats)
    rows = [(s is None, s or "", float(found[s][0]), seats[s][0] - found[s][1], False) if s in found else (s is None, s or "", None, 0, s in whole) for s in order]
    table = spark.createDataFrame(rows, "_none boolean, _name string, _divisor double, _left long, _whole boolean")
    given = parts.join(F.broadcast(table), ["_none", "_name"], "left").withColumn("_got", F.coalesce(_seats(F.col("_divisor")), F.lit(0)).cast("long"))
    room = (F.col("_left") > 0) & (F.col("_got") * block < most * F.col("_words"))
    next_ = F.col("_words") / (2 * F.col("_got") + 1)
    rank = F.row_number().over(Window.partitionBy("_none", "_name").orderBy(F.desc("_next"), "_shard"))
    # quotients just below the divisor: all others of the source are below the trial that gave too many
    more = (given.where(room).withColumn("_next", next_).withColumn("_r", rank).where("_r <= _left")
            .select("_shard", "_none", "_name", F.lit(1).cast("long").alias("_more")))
    want = F.when(F.col("_whole"), most * F.col("_words")).otherwise(F.least((F.col("_got") + F.coalesce("_more", F.lit(0))) * block, most * F.col("_words"))).cast("long")
    full = F.expr(f"_words div {block}")
    return (given.join(more, ["_shard", "_none", "_name"], "left").withColumn("_want", want)
            .select("_shard", "_none", "_name", F.expr("_want div _words").alias("_passes"), F.expr("_want % _words").alias("_rest"), full.alias("_blocks")))


def _selected(j: str, part: str, block: int) -> str:
    """SQL: whether block ``j`` of the full ones is selected: floor((j * r + phase) / blocks) steps up there."""
    return f"({_upto(f'({j} + 1)', part, block)} > {_upto(j, part, block)})"


def _upto(j: str, part: str, block: int) -> str:
    """SQL: selected blocks before block ``j``; the phase leaves block 0 out unless all are selected."""
    return f"cast((cast({j} as decimal(19,0)) * cast({part}rest div {block} as decimal(18,0)) + {part}phase) div greatest({part}blocks, 1) as bigint)"


def _taken_before(at: str, part: str, block: int) -> str:
    """SQL: words before word ``at`` that selected blocks and the partial one take.

    Of the full blocks rest div block are selected, evenly spread; the other rest % block words come from
    the start of block 0, which is not among them, or from the words after the last full block.
    """
    full, more = f"({part}rest div {block})", f"({part}rest % {block})"
    j = f"least({at} div {block}, {part}blocks)"
    whole = f"({block} * {_upto(j, part, block)} + if({j} < {part}blocks AND {_selected(j, part, block)}, {at} - {block} * {j}, 0))"
    tail = f"if({full} < {part}blocks, least({at}, {more}), least(greatest({at} - {block} * {part}blocks, 0), {more}))"
    return f"({whole} + {tail})"


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20240601,
          weights=WEIGHTS, most: int = MOST, block: int = BLOCK, with_text: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, taken, passes and rest; ``with_text=False`` leaves the text behind.

    ``taken`` words are ``passes`` whole copies of the text and the words of the selected blocks;
    ``rest`` describes those (see ``selected_words``).  Null text: size 0, nothing taken.  A null
    source is a source of its own, after all others.  Null ids and repeated rows take part like
    others (rows are dealt by id and text); equal rows are told apart by no column, so which of them
    gives a word is arbitrary but the words taken are the same.  Columns with the names of the results are replaced.  Empty
    table: empty result.  The same input and seed give the same result.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in RESULTS if c in docs.columns])
    row = (F.col(id_col).cast("string"), F.col(text_col))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if with_text or c != text_col]).alias("_doc"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed + 1), *row).alias("_deal"), F.xxhash64(F.lit(seed), row[0]).alias("_order"), F.xxhash64(F.col(text_col)).alias("_tie"),
        F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col), F.lit("")).alias("_name"))
    if not with_text:  # small rows: texts are looked at once
        sized = cut_lineage(sized)
    words = {None if r["_none"] else r["_name"]: r["n"] for r in sized.groupBy("_none", "_name").agg(F.sum("_size").alias("n")).collect()}
    target = targets(words, weights, most)
    by_source = spark.createDataFrame(
        [(s is None, s or "", words[s], float(target[s]), max(1, words[s] // SHARD_WORDS)) for s in target],
        T.StructType([T.StructField("_none", T.BooleanType()), T.StructField("_name", T.StringType()), T.StructField("source_size", T.LongType()),
                      T.StructField("target", T.DoubleType()), T.StructField("_shards", T.LongType())]))
    shard = F.when(F.col("_size") > 0, F.pmod("_deal", "_shards")).otherwise(-1 - F.pmod("_deal", F.lit(EMPTY_SHARDS)))
    sized = sized.join(F.broadcast(by_source), ["_none", "_name"]).withColumn("_shard", shard)  # a row for each source
    group = ["_shard", "_none", "_name"]
    parts = cut_lineage(sized.where("_size > 0").groupBy(*group).agg(F.sum("_size").alias("_words")))
    quotas = _quotas(parts, words, target, block, most)
    place = Window.partitionBy(*group).orderBy("_order", "_tie", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("_passes", "_rest", "_blocks")}
    placed = (sized.withColumn("_end", F.sum("_size").over(place)).withColumn("_start", F.col("_end") - F.col("_size"))
              .join(quotas, group, "left").withColumns(none)
              .withColumn("_phase", F.pmod(F.xxhash64(F.lit(seed + 2), *group), F.greatest(F.col("_blocks") - F.expr(f"_rest div {block}"), F.lit(1)))))
    extra = F.expr(f"{_taken_before('_end', '_', block)} - {_taken_before('_start', '_', block)}")
    return placed.select(
        "_doc.*", F.col("_size").alias("size"), "source_size", "target", (F.col("_passes") * F.col("_size") + extra).alias("taken"),
        F.col("_passes").alias("passes"), F.struct(F.col("_start").alias("start"), F.col("_rest").alias("rest"), F.col("_blocks").alias("blocks"),
                                                   F.col("_phase").alias("phase")).alias("rest"))


def selected_words(text_col: str, block: int = BLOCK):
    """The words of ``text_col`` in the selected blocks, joined by one space (needs the ``rest`` column of ``mixed``).

    Blocks that meet the text are looked at once each, not word by word; then their words are cut out.
    """
    full, more = f"(rest.rest div {block})", f"(rest.rest % {block})"
    first, last = f"(rest.start div {block})", f"least((rest.start + size(w) - 1) div {block}, rest.blocks - 1)"
    met = f"if({first} <= {last}, sequence({first}, {last}), cast(array() as array<bigint>))"
    chosen = f"transform(filter({met}, j -> {_selected('j', 'rest.', block)}), j -> struct({block} * j AS a, {block} * j + {block} AS b))"
    ranges = (f"if({full} < rest.blocks, concat(array(struct(0L AS a, {more} AS b)), {chosen}), "
              f"concat({chosen}, array(struct({block} * rest.blocks AS a, {block} * rest.blocks + {more} AS b))))")
    low, high = "greatest(r.a, rest.start)", "least(r.b, rest.start + size(w))"
    cut = f"slice(w, cast({low} - rest.start + 1 as int), cast(greatest({high} - {low}, 0L) as int))"
    # the lambda over one array names the words, so that they are extracted once
    return F.expr(f"transform(array(regexp_extract_all({text_col}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), "
                  f"w -> array_join(flatten(transform({ranges}, r -> {cut})), ' '))[0]")


def materialised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: each document once for each whole pass, and once with its selected words if there are any."""
    m = mixed(docs, id_col, text_col, source_col, **kw)
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("passes", F.lit(1))), lambda i: F.col(text_col))
    whole = F.when((F.col("passes") > 0) & (F.col("size") > 0), copies).otherwise(F.array().cast("array<string>"))
    part = F.when(F.col("taken") > F.col("passes") * F.col("size"), F.array(selected_words(text_col))).otherwise(F.array().cast("array<string>"))
    kept = [c for c in docs.columns if c in m.columns and c not in RESULTS]
    out = m.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), F.explode(F.concat(whole, part)).alias("_text"))
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_doc.`{c}`") for c in kept])
