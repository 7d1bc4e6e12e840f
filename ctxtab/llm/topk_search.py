"""Exact top-k inner product search by no-random-access aggregation of sorted lists.

Vectors become integers (floor(256 x)).  Every component is a list of (value, candidate) of a block,
sorted by value; a query reads it from the top where its own component is positive and from the
bottom where it is negative, so that contributions come in falling order.  A cursor goes down all
lists in step.  What an entry adds is booked for its candidate; a candidate's score then lies between

* lower: what was read of it, and the least that each list not yet read for it can still give, and
* upper: what was read of it, and the last value read of each such list.

A block is passed over for queries whose k-th score so far is above what the heads of its lists add
up to.  Reading stops for a query when few candidates can still reach the k-th best lower bound (ties
included); their scores are resolved by reading the lists on to their ends and booking their entries
alone.  Every score is a sum of entries read from lists; no vector is looked up.

Blocks of queries meet blocks of candidates in cells of a grid, packed as the narrowest numbers that
hold them and dealt to as many partitions as there are cells, so that a task holds a few blocks
whatever the tables' size.  A cell reads its lists for a few queries at a time (``TILE``) and returns
k rows for each of its queries; a ranked window keeps the best k of all cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096        # candidates of a cell
QUERIES = 4096      # queries of a cell
TILE = 1 << 20      # bounds of scores held at once: queries x candidates
PARTITIONS = 4096   # most partitions over which the cells are dealt
SCALE = 256


def usable(vec: Column) -> Column:
    """True for a vector without null or non-finite components (and not null or empty itself)."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False))


class Lists:
    """The sorted lists of a block, and how many entries have been read of them."""

    def __init__(self, cands: np.ndarray):
        self.n, self.dims = cands.shape
        self.who = np.argsort(cands, axis=0, kind="stable")
        self.value = np.take_along_axis(cands, self.who, axis=0)
        self.read = 0

    def entries(self, d: int, begin: int, end: int, top: bool) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, values) of places ``begin`` to ``end`` of list ``d``, counted from the top or the bottom."""
        at = slice(self.n - end, self.n - begin) if top else slice(begin, end)
        self.read += end - begin
        return self.who[at, d], self.value[at, d]


def _entries(lists: Lists, begin: int, end: int, used: np.ndarray, top: bool, seen: np.ndarray | None = None, only: np.ndarray | None = None) -> np.ndarray:
    """Read places ``begin`` to ``end`` of the ``used`` lists: a table of candidates x lists with the values read, else 0.

    ``seen`` is marked; ``only`` maps candidates to rows of the table, or to -1 where nothing is booked.
    """
    out = np.zeros((lists.n if only is None else int(only.max()) + 1, lists.dims), lists.value.dtype)
    for d in np.flatnonzero(used):
        c, v = lists.entries(d, begin, end, top)
        if only is not None:
            c = only[c]
            c, v = c[c >= 0], v[c >= 0]
        else:
            seen[c, d] = True
        out[c, d] = v
    return out


def nra(queries: np.ndarray, lists: Lists, k: int, banned: np.ndarray, floor: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, candidates, scores) with every candidate that is among the query's best k, ties included.

    ``banned[q]`` is a candidate that query q may not return, or -1; candidates below ``floor[q]`` need
    not be found.
    """
    n, kind = lists.n, queries.dtype
    least = -np.inf if kind.kind == "f" else np.iinfo(np.int64).min
    floor = np.full(len(queries), least, kind) if floor is None else floor
    sides = ((True, np.maximum(queries, 0)), (False, np.minimum(queries, 0)))
    low, high = lists.value[0], lists.value[-1]
    open_ = np.flatnonzero(sides[0][1] @ high + sides[1][1] @ low >= floor)  # heads of the lists
    found = []
    score, depth = np.zeros((len(open_), n), kind), 0
    seen = {top: np.zeros((n, lists.dims), bool) for top, _ in sides}
    while len(open_):
        depth, before = min(n, max(1, 2 * depth, n // 4)), depth
        upper, lower = score.copy(), score.copy()
        for top, q in sides:
            q = q[open_]
            got = q @ _entries(lists, before, depth, q.any(0), top, seen[top]).T
            score += got
            rest = (~seen[top]).astype(kind).T
            upper += got + (q * (lists.value[n - depth] if top else lists.value[depth - 1])) @ rest
            lower += got + (q * (low if top else high)) @ rest
        rows = np.arange(len(open_))
        has = banned[open_] >= 0
        lower[rows[has], banned[open_][has]] = least
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), least, kind)
        alive = upper >= np.maximum(kth, floor[open_])[:, None]
        alive[rows[has], banned[open_][has]] = False
        done = (alive.sum(1) <= max(2 * k, n // 64)) | (depth == n)
        left = np.flatnonzero(alive[done].any(0))
        if len(left):
            own, place = score[np.ix_(done, left)], np.full(n, -1)
            place[left] = np.arange(len(left))
            for top, q in sides if depth < n else ():
                q = q[open_[done]]
                own = own + q @ _entries(lists, depth, n, q.any(0), top, only=place).T
            for row, r in enumerate(np.flatnonzero(done)):
                c = np.flatnonzero(alive[r, left])
                s = own[row, c]
                if len(c) > k:
                    keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                    c, s = c[keep], s[keep]
                found.append((int(open_[r]), left[c], s))
        open_, score = open_[~done], score[~done]
    return found


def _exact(queries: np.ndarray, cands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats or doubles where these hold every partial sum exactly, else as 64-bit integers; no more than these hold is allowed."""
    peak = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    most = peak(queries) * peak(cands) * cands.shape[1]
    if most >= 2**62:
        raise ValueError(f"inner products of up to {most} are not sure to fit 64 bits")
    kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
    return queries.astype(kind), cands.astype(kind)


WIDTHS = {2: np.int16, 4: np.int32, 8: np.float64}  # bytes of a packed number


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers that are given as doubles in the narrowest type that holds them."""
    top = np.abs(x).max(initial=0)
    return x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64)


def _unpacked(ids, vecs, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a block, views of the batch."""
    ids, raw = np.frombuffer(ids.as_buffer(), np.int64), vecs.as_buffer()
    return ids, np.frombuffer(raw, WIDTHS[raw.size // (len(ids) * dims)]).reshape(-1, dims)


def _pack(batch_cols, schema):
    def fn(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by("_id")
        vec = tbl["_vec"].combine_chunks()
        return pa.table([pa.array([tbl[c][0].as_py()]) for c in batch_cols] + [
            pa.array([tbl["_id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            pa.array([_narrow(vec.flatten().to_numpy(zero_copy_only=False)).tobytes()], pa.binary())], schema=schema)
    return fn


def _cell(k: int):
    def fn(batches):
        reached: dict = {}  # of a query block: the k-th scores that this task has seen for it
        for batch in batches:
            for i in range(batch.num_rows):
                dims, block, qi, qv, ci, cv = (batch.column(x)[i] for x in ("dims", "qb", "q_ids", "q_vecs", "c_ids", "c_vecs"))
                dims, block = dims.as_py(), block.as_py()
                (qi, qv), (ci, cv) = _unpacked(qi, qv, dims), _unpacked(ci, cv, dims)
                qv, cv = _exact(qv, cv)
                # rows with the query's own id are no candidates; a repeated id is left out by asking for that many more
                uniq, first, times = np.unique(ci, return_index=True, return_counts=True)
                at = np.searchsorted(uniq, qi)
                own = np.where((at < len(uniq)) & (uniq[np.minimum(at, len(uniq) - 1)] == qi), first[np.minimum(at, len(uniq) - 1)], -1)
                more = int(times.max()) - 1
                if (dims, block) not in reached:
                    reached = {(dims, block): np.full(len(qi), -2.0**62)}
                floor, lists = reached[dims, block], Lists(cv)
                q, c, s = [], [], []
                step = max(1, TILE // len(ci))
                for a in range(0, len(qi), step):
                    tile = slice(a, a + step)
                    for r, cand, score in nra(qv[tile], lists, k + more, own[tile], floor[tile].astype(qv.dtype)):
                        r += a
                        keep = ci[cand] != qi[r]
                        cand, score = cand[keep], score[keep]
                        best = np.lexsort((ci[cand], -score))[:k]
                        q.append(np.full(len(best), qi[r]))
                        c.append(ci[cand[best]])
                        s.append(score[best])
                        if len(best) == k and qv.dtype.kind == "f":
                            floor[r] = max(floor[r], score[best[-1]])
                cols = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (q, c, s)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["query_id", "vec_id", "score"])
    return fn


def top_k(queries: DataFrame, cands: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the highest integer inner product for each query.

    Ties go to smaller ids; fewer than k candidates give as many rows.  A row with the query's own
    id is no candidate.  Vectors that are null, empty or hold null or non-finite components, and
    rows with a null id, take part on neither side; vectors of another length are no candidates.
    Repeated candidate rows are candidates each; of repeated query ids with different vectors each
    candidate keeps its best score.  Components beyond 2**62 / 256, and blocks whose products might
    not fit 64 bits, raise a ValueError; below that all scores are exact.  Empty tables: empty result.
    """
    def ready(df, prefix, size):
        vec = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))  # a long, so at most 2**63
        rows = (df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
                .select(F.col(id_col).cast("long").alias("_id"), vec.alias("_vec"), F.size(vec_col).cast("long").alias("dims")))
        n = rows.count()
        blocks = max(1, -(-n // size))
        schema = pa.schema([("dims", pa.int64()), ("block", pa.int64()), (f"{prefix}_ids", pa.binary()), (f"{prefix}_vecs", pa.binary())])
        packed = (rows.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(blocks))).groupBy("dims", "block")
                  .applyInArrow(_pack(["dims", "block"], schema), f"dims long, block long, {prefix}_ids binary, {prefix}_vecs binary"))
        return packed, blocks

    (q, nq), (c, nc) = ready(queries, "q", QUERIES), ready(cands, "c", BLOCK)
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    cell, parts = ["dims", "qb", "cb"], min(nq * nc, PARTITIONS)
    cells = (q.withColumnRenamed("block", "qb").withColumn("cb", every(nc)).repartition(parts, *cell).hint("shuffle_hash")
             .join(c.withColumnRenamed("block", "cb").withColumn("qb", every(nq)).repartition(parts, *cell), cell))
    best = cells.select("dims", "qb", "q_ids", "q_vecs", "c_ids", "c_vecs").mapInArrow(_cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
