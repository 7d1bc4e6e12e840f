"""Sharding by balanced label propagation: copies of a text move to one shard, counts stay even.

Documents are linked when their texts are equal.  A link set is held as one row for each (text,
shard) with the number of its documents there, never as pairs or lists.  Linked documents start
dealt evenly over the shards.  In each round the documents of a text ask to move to the shard where
most of their neighbours are (ties by a hash; shards that the text fills alone are left out, and
after some rounds all shards without room).  The
16 x 16 table of asked moves is cut down so that arrivals less departures fit each shard's quota,
and the moves are admitted in a fixed order by running totals.  Rounds go on until none moves.
Documents with no copy have no link to cut and fill the shards up to their quotas.

Quotas are row counts that differ by at most one (law ``rows``).  Sixteen loads are all that the
driver sees.  Ranks and running totals come in two levels (buckets, then inside a bucket), so a
text with a third of all rows is many small windows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxtab.session import cut_lineage

SHARDS = 16
ROWS_PER_BUCKET = 4096
EXCHANGES = 4     # rounds in which shards without room may be aims


def _running(df: DataFrame, keys: list[str], value, order: list[str], name: str) -> DataFrame:
    """Total of ``value`` over the rows of the same ``keys`` that come earlier by (``_bucket``, ``order``)."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_offset"))
    return (df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(offsets, [*keys, "_bucket"]).withColumn(name, F.col(name) + F.col("_offset")).drop("_offset"))


def _numbers(values: list[int]):
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _admitted(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """Asked moves that keep every shard within its room, arrivals less departures.

    A chain of asked moves is admitted when it ends in a shard with room or where it began; each
    chain uses up an ask or a room, so there are few.
    """
    n, left, free = len(room), [row[:] for row in asked], list(room)
    whole = [[0] * n for _ in range(n)]

    def chain(s: int, t: int) -> list[int] | None:
        came, queue = {t: s}, [t]
        for u in queue:
            if free[u] > 0 or u == s:
                path = [u]
                while len(path) == 1 or path[-1] != s:
                    path.append(came[path[-1]])
                return path[::-1]
            for v in range(n):
                if left[u][v] and v not in came:
                    came[v] = u
                    queue.append(v)
        return None

    for s, t in sorted(((s, t) for s in range(n) for t in range(n)), key=lambda x: -asked[x[0]][x[1]]):
        while left[s][t] and (path := chain(s, t)):
            steps = list(zip(path, path[1:]))
            k = min([left[u][v] for u, v in steps] + ([free[path[-1]]] if path[-1] != s else []))
            for u, v in steps:
                left[u][v] -= k
                whole[u][v] += k
            free[path[-1]] -= k
            free[s] += k
    return whole


def _asks(state: DataFrame, limit: list[int], buckets: int, turn: int) -> DataFrame:
    """(text_key, shard, to, n): documents that would join most of their neighbours; ties by a hash.

    A shard is no aim for a text that has ``limit`` documents or more there.
    """
    most = F.element_at(_numbers(limit), F.col("shard") + 1)
    tie = F.xxhash64("text_key", "shard", F.lit(turn))
    pick = Window.partitionBy("text_key").orderBy(F.desc("_open"), F.desc("n"), tie, "shard")
    seen = (state.withColumn("_open", (F.col("n") < most).cast("int"))
            .withColumn("_to", F.first("shard").over(pick)).withColumn("_to_n", F.first("n").over(pick))
            .withColumn("_to_open", F.first("_open").over(pick)))
    return (seen.where((F.col("shard") != F.col("_to")) & (F.col("_to_open") == 1) & (F.col("n") <= F.col("_to_n")))
            .select("text_key", "shard", "n", "_to", F.pmod(F.xxhash64("text_key"), F.lit(buckets)).alias("_bucket")))


def _moved(state: DataFrame, asks: DataFrame, whole: list[list[int]]) -> DataFrame:
    """The state after the admitted moves; requests are served in one fixed order."""
    ranked = _running(asks, ["shard", "_to"], F.col("n"), ["text_key"], "_before")
    limit = F.element_at(_numbers([x for row in whole for x in row]), (F.col("shard") * len(whole) + F.col("_to") + 1).cast("int"))
    moves = ranked.withColumn("k", F.least("n", limit - F.col("_before"))).where("k > 0")
    return (state.unionByName(moves.select("text_key", "shard", (-F.col("k")).alias("n")))
            .unionByName(moves.select("text_key", F.col("_to").alias("shard"), F.col("k").alias("n")))
            .groupBy("text_key", "shard").agg(F.sum("n").alias("n")).where("n > 0"))


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the bytes of the text in UTF-8 plus one; a null text counts, and is grouped, as an
    empty one.  Every shard gets floor(n / shards) rows or one more.  A group of equal texts lies in
    one shard unless it is larger than a shard's quota or no shard has room; then in few.  ``slot``
    numbers the rows of a shard from 0 without gaps, by id.  Null ids are placed like others; equal
    rows get different slots.  Empty table: empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.count()
    buckets = max(8, -(-total // ROWS_PER_BUCKET))
    spread = F.xxhash64(F.col(id_col).cast("string"), text)
    base = cut_lineage(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_key"), F.pmod(F.xxhash64(spread, F.lit(7)), F.lit(buckets)).alias("_bucket")))
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    copied = base.groupBy("text_key").agg(F.count("*").alias("_all")).where("_all > 1").select("text_key")
    linked = _running(base.join(copied, "text_key").withColumn("_one", F.lit(0)), ["_one"], F.lit(1).cast("long"), ["_id", "text_key"], "_rank")
    state = cut_lineage(linked.groupBy("text_key", F.pmod(F.col("_rank"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n")))
    settled = False
    for turn in count():  # each move makes a larger pile of a text larger, so moves come to an end
        room = [q - n for q, n in zip(quota, _loads(state, shards))]
        # at first any shard that the text does not fill is an aim (exchanges), then only shards with room
        limit = [q if r > 0 or not settled else 0 for q, r in zip(quota, room)]
        asks = _asks(state, limit, buckets, turn)
        asked = [[0] * shards for _ in range(shards)]
        for r in asks.groupBy("shard", "_to").agg(F.sum("n").alias("n")).collect():  # shards x shards numbers
            asked[r["shard"]][r["_to"]] = r["n"]
        whole = _admitted(asked, room)
        moved = sum(map(sum, whole))
        if not moved and settled:
            break
        if moved:
            state = cut_lineage(_moved(state, asks, whole))
        settled = settled or turn >= EXCHANGES or not moved
    return _place(base, state, [q - n for q, n in zip(quota, _loads(state, shards))], id_col)


def _loads(state: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _place(base: DataFrame, state: DataFrame, left: list[int], id_col: str) -> DataFrame:
    """Documents by rank: linked ones into their text's shards, the others into what is left of each quota."""
    one = F.lit(1).cast("long")
    upto = Window.partitionBy("text_key").orderBy("shard")
    ends = (state.withColumn("_end", F.sum("n").over(upto)).groupBy("text_key")
            .agg(F.sort_array(F.collect_list(F.struct("_end", "shard"))).alias("_ends")))  # at most one for each shard
    marked = base.join(ends, "text_key", "left")
    linked = _running(marked.where("_ends IS NOT NULL"), ["text_key"], one, ["_id", "size"], "_rank")
    linked = linked.withColumn("shard", F.expr("filter(_ends, e -> e._end > _rank)[0].shard")).drop("_ends", "_rank")
    alone = _running(marked.where("_ends IS NULL").drop("_ends").withColumn("_one", F.lit(0)), ["_one"], one, ["_id", "text_key"], "_rank")
    bounds = _numbers([sum(left[:s + 1]) for s in range(len(left))])
    alone = alone.withColumn("shard", F.size(F.filter(bounds, lambda b: b <= F.col("_rank")))).drop("_one", "_rank")
    rows = linked.unionByName(alone).withColumn("shard", F.col("shard").cast("int"))
    slots = _running(rows, ["shard"], one, ["_id", "text_key"], "slot")
    return slots.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
