"""Context retrieval: test rows scored against train rows (Q1-Q12).

The score of test row i against train row j is ``s_ij = <x_i, x_j> * scale``
(``scale`` = 1/sqrt(d) by default) and the attention weight is the softmax
over all train rows, ``w_ij = exp(s_ij - lse_i)``.

Physical design (blocked score job).  Test rows are packed into blocks and train
rows into strips by id hash.  Test block ``tb`` meets every train strip ``rb`` of
its group through an equi-join on the grid cell ``(group, rb, tb)`` (the block
product of distributed matrix multiplication, so the shuffle moves blocks, not
pairs, no block is a hot key, and nothing is broadcast).  Cells are dealt to as many
partitions as there are cells, whatever their bytes: they are small and take long.
Where all pairs are scored, a small test side is cut into more blocks, so that no worker idles.
One Arrow task scores a cell with numpy (``functions/softmax.py``: with few
dimensions without touching every pair) and emits, per test row, the strip's best
score ``m``, ``z = sum exp(s - m)`` and the best ``K`` candidates -- never the pairs,
and never more than a bounded part of a cell at once.  A single shuffle on
``(group, test_id)`` then merges strips with a streaming log-sum-exp and
ranks the candidates.  Top-k is exact for ``K >= k``; ties break by train id.

Long contexts (``whole_rows``).  Beyond ``FEW`` candidates, lists from every strip would outweigh
the vectors by far.  Then a test block meets all strips in one task, which keeps them in a spool (a
scratch file, if they are many) and ranks as many test rows at a time as ``HELD`` scores allow.
The ranked rows leave in bounded batches: no candidate is shuffled, and the strips are copied for
every test block, not for every few rows that are ranked together.  Long contexts that are only
voted on (``LongContexts``) do not leave that task: it sums their votes (``long_votes``).

Shards (``ShardContexts``).  When every test row meets every one of many small shards, the contexts
outnumber the rows by the number of shards.  They are not made as a table: a test block stays in
one task, the shards pass it, and the votes of their contexts are summed there (``summed_votes``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.functions.exprs import id_hash
from ctxtab.functions.softmax import FEW, SERIES_DIMS, BestOfStrips, Voters, best_columns, scores, strip_scores
from ctxtab.functions.spool import Spool

DEFAULT_BLOCK_ROWS = 8192
MAX_STRIP_ROWS = 65_536
STRIP_BYTES = 4 << 20  # of a packed strip or block
CELL_PARTITIONS = 4096  # most partitions over which the cells of the grid are dealt
CELLS_SOUGHT, LEAST_BLOCK_ROWS = 48, 256  # cells below which blocks get smaller where all pairs are scored, and how small
EMIT = 1 << 20  # candidates in one output batch
HELD = 1 << 22  # scores that a task holds for test rows with long contexts
LONG_BLOCK_ROWS, LONG_BLOCKS, LEAST_LONG_ROWS = 4096, 48, 64  # most test rows of a block with long contexts; blocks sought before they grow, and how small they get
ROWS_OUT = 1 << 17  # ranked context rows in one output batch
COPIED_BYTES, LEAST_STRIP_ROWS = 64 << 20, 64  # of all copies of a strip, which Spark holds at once, unless strips got smaller than this
SHARD_BLOCK_ROWS, SHARD_BLOCKS = 2048, 32  # most test rows of a block that all shards pass; blocks sought before they grow
SHARD_ROWS = 4096  # most rows of a shard that passes the blocks as one row
SHARD_CELLS = 1 << 18  # scores of a shard held at once
BROADCAST_GROUPS = 100_000  # group count up to which the small table of block counts is broadcast


def _group_keys(keys: list[str] | None) -> list[str]:
    return list(keys) if keys else []


def _block_matrix(lst: pa.ListScalar | pa.Array, own: bool = False):
    """(ids, matrix) of a packed block, as doubles or with the vectors' ``own`` width."""
    vals = lst.values if isinstance(lst, pa.ListScalar) else lst
    ids = vals.field("id").to_numpy(zero_copy_only=False).astype(np.int64)
    v = vals.field("v")
    n = len(ids)
    flat = pc.list_flatten(v).to_numpy(zero_copy_only=False)
    flat = flat if own and flat.dtype == np.float32 else flat.astype(np.float64)
    d = flat.size // n if n else 0
    return ids, flat.reshape(n, d)


def _kernel_factory(keys: list[str], K: int, scale: float, key_types: list):
    def batch_of(group, parts):
        kk = parts[0][3].shape[1]
        tid, m, z, cid, cs, n = (np.concatenate(x) for x in zip(*[
            (t, top, total, c.ravel(), best.ravel(), np.full(len(t), n)) for t, top, total, c, best, n in parts]))
        offsets = pa.array(np.arange(len(tid) + 1, dtype=np.int32) * kk)
        return pa.RecordBatch.from_arrays(
            [*[pa.array([v] * len(tid), type=kt) for v, kt in zip(group, key_types)], pa.array(tid), pa.array(m), pa.array(z),
             pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(cid, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(cs, pa.float64()))],
            names=[*keys, "test_id", "_m", "_z", "_n", "_cid", "_cs"])

    def kernel(batches):
        for batch in batches:
            tcol, rcol = batch.column("_t"), batch.column("_r")
            for i in range(batch.num_rows):
                t_ids, Xt = _block_matrix(tcol[i])
                r_ids, Xr = _block_matrix(rcol[i])
                by_id = np.argsort(r_ids, kind="stable")
                r_ids, Xr = r_ids[by_id], Xr[by_id]
                group = [batch.column(k)[i].as_py() for k in keys]
                parts, held = [], 0
                for rows, top, z, cols, best in strip_scores(Xt, Xr, K, scale):
                    parts.append((t_ids[rows], top, z, r_ids[cols], best, len(r_ids)))
                    held += best.size + len(rows)
                    if held >= EMIT:
                        yield batch_of(group, parts)
                        parts, held = [], 0
                if parts:
                    yield batch_of(group, parts)
    return kernel


def block_scores(test: DataFrame, train: DataFrame, vec_col: str, K: int,
                 keys: list[str] | None = None, id_col: str = "row_id",
                 scale: float | None = None, block_rows: int | None = None) -> DataFrame:
    """Per (test row, train strip): best score, exp-sum, top-K candidates."""
    keys = _group_keys(keys)
    test = test.filter(F.col(vec_col).isNotNull())
    train = train.filter(F.col(vec_col).isNotNull())
    # one statistics pass per side: rows per group and vector width
    rs = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"), F.max(F.size(vec_col)).alias("_d"))
    ts = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nt"))
    tot = rs.agg(F.sum("_nr"), F.max("_d"), F.count(F.lit(1))).first()
    n_train, d = int(tot[0] or 0), int(tot[1] or 0)
    if scale is None:
        scale = 1.0 / math.sqrt(max(d, 1))
    fit = max(1, STRIP_BYTES // (8 + 8 * max(d, 1)))
    strip_rows, most_rows = min(MAX_STRIP_ROWS, fit), block_rows or min(DEFAULT_BLOCK_ROWS, fit)
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("long")
    if keys:
        nb = rs.join(ts, keys).select(*keys, blocks(F.col("_nr"), strip_rows).alias("_br"), blocks(F.col("_nt"), most_rows).alias("_bt"))
        cells = int(nb.agg(F.sum(F.col("_br") * F.col("_bt"))).first()[0] or 0)
        nb = F.broadcast(nb) if int(tot[2]) <= BROADCAST_GROUPS else nb
        test, train = test.join(nb, keys), train.join(nb, keys)
    else:  # one group: its block counts are literals, no join on a constant
        one = ts.first()
        n_test = int(one["_nt"]) if one else 0
        strips = max(1, math.ceil(n_train / strip_rows))
        if not block_rows and d > SERIES_DIMS:
            most_rows = min(most_rows, max(LEAST_BLOCK_ROWS, math.ceil(n_test * strips / CELLS_SOUGHT)))
        cells = strips * max(1, math.ceil(n_test / most_rows))
        counts = {"_br": blocks(F.lit(n_train), strip_rows), "_bt": blocks(F.lit(n_test), most_rows)}
        test, train = test.withColumns(counts), train.withColumns(counts)
    parts = max(1, min(cells, CELL_PARTITIONS))

    def packed(df: DataFrame, mine: str, count: str, keep: list[str], name: str) -> DataFrame:
        return (df.withColumn(mine, F.pmod(id_hash(id_col, 11), F.col(count))).groupBy(*keys, mine, *keep)
                .agg(F.collect_list(F.struct(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))).alias(name)))

    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    cell = [*keys, "_rb", "_tb"]
    tb = packed(test, "_tb", "_bt", ["_br"], "_t").withColumn("_rb", every("_br")).repartition(parts, *cell)
    rb = packed(train, "_rb", "_br", ["_bt"], "_r").withColumn("_tb", every("_bt")).drop("_bt").repartition(parts, *cell)
    pairs = tb.hint("shuffle_hash").join(rb, cell).select(*keys, "_t", "_r")
    schema = T.StructType(
        [pairs.schema[k] for k in keys]
        + [T.StructField("test_id", T.LongType()), T.StructField("_m", T.DoubleType()),
           T.StructField("_z", T.DoubleType()), T.StructField("_n", T.LongType()),
           T.StructField("_cid", T.ArrayType(T.LongType())),
           T.StructField("_cs", T.ArrayType(T.DoubleType()))])
    from pyspark.sql.pandas.types import to_arrow_type
    key_types = [to_arrow_type(pairs.schema[k].dataType) for k in keys]
    return pairs.mapInArrow(_kernel_factory(keys, K, float(scale), key_types), schema)


def _met(test: DataFrame, train: DataFrame, vec_col: str, keys: list[str], id_col: str, more: list[tuple[str, object]] = ()) -> tuple[DataFrame, int, int]:
    """(blocks of test rows, each before the strips of train rows it meets, all in one partition; most train rows of a group; vector width).

    ``more``: (name, expression) of what stands beside the train rows' vectors.  Rows without an id meet nothing.
    """
    test = test.filter(F.col(vec_col).isNotNull())
    rs = train.groupBy(*keys).agg(F.count(vec_col).alias("_nr"), F.max(F.size(vec_col)).alias("_d")).where("_nr > 0")
    ts = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nt"))
    most, d, groups, n_test = [*rs.agg(F.max("_nr"), F.max("_d"), F.count(F.lit(1))).first(), ts.agg(F.sum("_nt")).first()[0]]
    most, d, n_test = int(most or 0), int(d or 0), int(n_test or 0)
    fit = max(1, STRIP_BYTES // (8 + 8 * max(d, 1)))
    block_rows = min(LONG_BLOCK_ROWS, fit, max(LEAST_LONG_ROWS, math.ceil(n_test / LONG_BLOCKS)))
    strip_rows = max(LEAST_STRIP_ROWS, min(MAX_STRIP_ROWS, fit, COPIED_BYTES * fit // (STRIP_BYTES * max(1, math.ceil(n_test / block_rows)))))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("long")
    if keys:
        nb = rs.join(ts, keys).select(*keys, blocks(F.col("_nr"), strip_rows).alias("_br"), blocks(F.col("_nt"), block_rows).alias("_bt"))
        parts = int(nb.agg(F.sum("_bt")).first()[0] or 0)
        nb = F.broadcast(nb) if int(groups) <= BROADCAST_GROUPS else nb
        test, train = test.join(nb, keys), train.join(nb, keys)
    else:
        parts = math.ceil(n_test / block_rows)
        counts = {"_br": blocks(F.lit(most), strip_rows), "_bt": blocks(F.lit(n_test), block_rows)}
        test, train = test.withColumns(counts), train.withColumns(counts)
    parts = max(1, min(parts, CELL_PARTITIONS))
    row = lambda extra: F.struct(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), *extra)
    place = lambda count: F.pmod(id_hash(id_col, 11), F.col(count))
    nothing = [F.lit(None).cast(train.select(x).schema[0].dataType).alias(name) for name, x in more]
    asked = (test.groupBy(*keys, place("_bt").alias("_tb")).agg(F.collect_list(row(nothing)).alias("_rows"))
             .withColumn("_rb", F.lit(-1).cast("long")))
    known = (train.groupBy(*keys, place("_br").alias("_rb"), "_bt").agg(F.collect_list(row([x.alias(name) for name, x in more])).alias("_rows"))
             .withColumn("_tb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bt") - 1))))
    cols = [*keys, "_tb", "_rb", "_rows"]
    both = (asked.select(*cols).unionByName(known.select(*cols)).where(F.col("_tb").isNotNull() & F.col("_rb").isNotNull())
            .repartition(parts, *keys, "_tb").sortWithinPartitions(*keys, "_tb", "_rb"))
    return both, most, d


def whole_rows(test: DataFrame, train: DataFrame, vec_col: str, k: int | None, keys: list[str] | None = None, id_col: str = "row_id",
               scale: float | None = None, mass: float | None = None, least: int = 0) -> DataFrame:
    """Ranked contexts of any length, best first: the ``k`` best train rows of every test row (None: all).

    With ``mass``, cut after the row at which the weights reach it, though not before ``least`` rows;
    the length is in ``ctx_len``.  A task holds ``HELD`` scores, or those of one test row if they are more.
    """
    keys = _group_keys(keys)
    both, most, d = _met(test, train.filter(F.col(vec_col).isNotNull()), vec_col, keys, id_col)
    scale = float(1.0 / math.sqrt(max(d, 1)) if scale is None else scale)
    K = most if k is None else min(int(k), most)
    step = max(1, HELD // max(K, 1))
    schema = T.StructType([both.schema[c] for c in keys] + [
        T.StructField("test_id", T.LongType()), T.StructField("train_id", T.LongType()), T.StructField("rank", T.IntegerType()),
        T.StructField("score", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("lse", T.DoubleType()),
        T.StructField("n_ctx", T.LongType())] + ([T.StructField("ctx_len", T.LongType())] if mass is not None else []))
    from pyspark.sql.pandas.types import to_arrow_type
    key_types = [to_arrow_type(both.schema[c].dataType) for c in keys]
    limit = None if k is None else int(k)

    def kernel(batches):
        def out(group, test_id, ids, ranks, best, lse, n, length):
            full = lambda v, t: pa.array(np.full(len(ids), v), t)
            arrays = [*[pa.array([v] * len(ids), type=t) for v, t in zip(group, key_types)], full(test_id, pa.int64()), pa.array(ids),
                      pa.array(ranks, pa.int32()), pa.array(best), pa.array(np.exp(best - lse)), full(lse, pa.float64()), full(n, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays + ([full(length, pa.int64())] if mass is not None else []), names=schema.names)

        def ranked(t_ids, Xt, strips):
            ends, a, b = np.append(np.nonzero(np.diff(t_ids))[0] + 1, len(t_ids)), 0, 0
            while b < len(t_ids):  # rows that share an id stay together
                a, b = b, int(ends[max(np.searchsorted(ends, b + step, "right") - 1, np.searchsorted(ends, b, "right"))])
                state, at = BestOfStrips(Xt[a:b], K, scale), 0
                for n in strips[0]:
                    state.add(np.asarray(strips[1].rows()[at:at + n]), strips[2].rows()[at:at + n].astype(np.float64))
                    at += n
                yield from state.ranked(t_ids[a:b], limit)

        def finished(group, t_ids, Xt, strips):
            pending, held = [], 0
            for test_id, ids, best, lse, n in ranked(t_ids, Xt, strips):
                length = len(ids)
                if mass is not None:
                    below = np.cumsum(np.exp(best - lse)) < mass  # no number counts as reached, as in Spark
                    length = min(max(length if below.all() else int(np.argmin(below)) + 1, least), n)
                for a in range(0, min(length, len(ids)), ROWS_OUT):
                    b = min(a + ROWS_OUT, length, len(ids))
                    pending.append(out(group, test_id, ids[a:b], np.arange(a + 1, b + 1), best[a:b], lse, n, length))
                    held += b - a
                    if held >= ROWS_OUT:
                        yield pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
                        pending, held = [], 0
            if pending:
                yield pa.Table.from_batches(pending).combine_chunks().to_batches()[0]

        at = group = t_ids = Xt = strips = None
        for batch in batches:
            for i in range(batch.num_rows):
                here = [batch.column(c)[i].as_py() for c in [*keys, "_tb"]]
                ids, X = _block_matrix(batch.column("_rows")[i], own=True)
                by_id = np.argsort(ids, kind="stable")
                ids, X = ids[by_id], X[by_id]
                if batch.column("_rb")[i].as_py() < 0:
                    if at is not None:
                        yield from finished(group, t_ids, Xt, strips)
                    at, group, t_ids, Xt, strips = here, here[:-1], ids, X.astype(np.float64), ([], Spool(), Spool())
                elif here == at:
                    strips[0].append(len(ids))
                    strips[1].add(ids)
                    strips[2].add(X)
        if at is not None:
            yield from finished(group, t_ids, Xt, strips)

    return both.mapInArrow(kernel, schema)


@dataclass(frozen=True)
class LongContexts:
    """The ``k`` best train rows of every test row, too many to be handed on: what votes are summed from."""
    test: DataFrame
    train: DataFrame
    vec_col: str
    k: int
    id_col: str = "row_id"
    scale: float | None = None


def long_votes(ctx: LongContexts, train: DataFrame, label_col: str) -> DataFrame:
    """``(test_id, class, logit)``: log of the summed weights of the context rows of each class.

    Logits are relative to the best score of their test row; the normaliser is the same for all its
    classes.  A block of test rows meets all strips in one task, and only a row for each class leaves
    it.  ``train`` has the rows of the contexts and their labels; a missing label is a class of its own.
    """
    classes = sorted(r[0] for r in train.select(label_col).where(F.col(label_col).isNotNull()).distinct().collect())  # a value for each class
    kind, n = train.schema[label_col].dataType, len(classes) + 1
    code = (F.coalesce(F.array_position(F.array(*[F.lit(c).cast(kind) for c in classes]), F.col(label_col)), F.lit(n)) - 1
            if classes else F.lit(0)).cast("int")
    both, most, d = _met(ctx.test, train, ctx.vec_col, [], ctx.id_col, [("c", code)])
    scale, K = float(1.0 / math.sqrt(max(d, 1)) if ctx.scale is None else ctx.scale), min(ctx.k, most)

    def kernel(batches):
        def finished(t_ids, voters):
            for at, logit, voted in voters.logits(t_ids):
                r, c = np.nonzero(voted)
                yield pa.RecordBatch.from_arrays([pa.array(at[r]), pa.array(c.astype(np.int32)), pa.array(logit[r, c])], names=["test_id", "c", "logit"])

        at = t_ids = voters = None
        for batch in batches:
            for i in range(batch.num_rows):
                here, rows = batch.column("_tb")[i].as_py(), batch.column("_rows")[i].values
                ids, v = rows.field("id").to_numpy(), rows.field("v")
                X = pc.list_flatten(v).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v) - v.null_count, -1)
                if batch.column("_rb")[i].as_py() < 0:
                    if at is not None:
                        yield from finished(t_ids, voters)
                    at, t_ids, voters = here, ids, Voters(X, K, scale, n)
                elif here == at:
                    voters.add(ids, v.is_valid().to_numpy(zero_copy_only=False), X, rows.field("c").to_numpy())
        if at is not None:
            yield from finished(t_ids, voters)

    name = F.element_at(F.array(*[F.lit(c).cast(kind) for c in classes], F.lit(None).cast(kind)), F.col("c") + 1)
    return both.mapInArrow(kernel, "test_id long, c int, logit double").select("test_id", name.alias("class"), "logit")


@dataclass(frozen=True)
class ShardContexts:
    """The ``k`` best train rows of every test row in each shard, not yet met: what votes are summed from."""
    test: DataFrame
    train: DataFrame
    vec_col: str
    k: int
    shard: str
    id_col: str = "row_id"
    scale: float | None = None
    label_col: str | None = None  # set by the predictor
    temperature: float | None = None

    def voted(self, label_col: str, temperature: float) -> ShardContexts:
        return replace(self, label_col=label_col, temperature=float(temperature))


class _Shard:
    """The rows of one shard for a test block: those that can be found, and the votes that an id stands for."""

    def __init__(self, ids, codes, valid, X):
        by_id = np.argsort(ids[valid], kind="stable")
        self.ids, self.X = ids[valid][by_id], X[by_id]
        self.known, place = np.unique(ids, return_inverse=True)
        self.votes = np.split(codes[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place))[:-1])  # rows that share an id vote together
        self.single = len(self.known) == len(ids)
        self.codes = codes[np.argsort(ids, kind="stable")]

    def best(self, t_ids, Xt, k, scale):
        """Chunks of (test ids, log-sum-exp, per test id: codes, scores) in which a negative code is no vote."""
        step = max(1, SHARD_CELLS // max(1, len(self.ids)))
        ends, a, b = np.append(np.nonzero(np.diff(t_ids))[0] + 1, len(t_ids)), 0, 0
        while b < len(t_ids):  # rows that share an id stay together
            a, b = b, int(ends[min(np.searchsorted(ends, b + step), len(ends) - 1)])
            S = scores(Xt[a:b], self.X, scale)
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                top = S.max(axis=1)
                z = np.exp(S - top[:, None]).sum(axis=1)
                cols = best_columns(S, k) if np.isfinite(S).all() else np.argsort(-S, axis=1, kind="stable")[:, :k]
                yield from self._voters(t_ids[a:b], top, z, np.asarray(cols), np.take_along_axis(S, cols, axis=1), k)

    def _voters(self, t_ids, top, z, cols, best, k):
        at, first, n = np.unique(t_ids, return_index=True, return_counts=True)
        if self.single and len(at) == len(t_ids):
            codes = self.codes[np.searchsorted(self.known, self.ids)]
            yield at, top + np.log(z), codes[cols], best
            return
        for i, a, m in zip(at, first, n):  # ids stand more than once: candidates and votes one by one
            b = a + m
            ids, s = self.ids[cols[a:b]].ravel(), best[a:b].ravel()
            order = np.lexsort((ids, np.where(np.isnan(s), -np.inf, -s)))[:k]  # as Spark ranks them
            most = top[a:b].max()
            lse = most + np.log((z[a:b] * np.exp(top[a:b] - most)).sum())
            mine = [self.votes[p] for p in np.searchsorted(self.known, ids[order])]
            codes = np.concatenate(mine) if mine else np.zeros(0, dtype=np.int64)
            yield np.array([i]), np.array([lse]), codes[None, :], np.repeat(s[order], [len(x) for x in mine])[None, :]


def _share(codes, best, lse, classes, temperature):
    """Class probabilities of the contexts of one shard (M1 + M4): (test rows x classes, which classes voted)."""
    m = len(codes)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        logit, held = np.full((m, classes), -np.inf), np.zeros((m, classes), dtype=bool)
        for c in range(classes):
            mine = codes == c
            rows = np.nonzero(mine.any(axis=1))[0]
            if not len(rows):
                continue
            s = np.where(mine[rows], best[rows], -np.inf)
            high = s.max(axis=1)
            w = np.where(mine[rows], np.exp(best[rows] - high[:, None]), 0.0).sum(axis=1)
            logit[rows, c], held[rows, c] = high - lse[rows] + np.log(w), True
        x = np.where(held, logit / temperature, -np.inf)
        e = np.where(held, np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf)), 0.0)
        return e / e.sum(axis=1, keepdims=True), held


def summed_votes(ctx: ShardContexts, weights: DataFrame, classes: list) -> DataFrame:
    """``(test_id, class, p)``: the shards' class probabilities times their weight (``weights``: a row (shard, w) for each), summed.

    A block of test rows stays in one task, which the shards pass one by one; it holds a number for
    each test row and class.  Neither contexts nor the probabilities of a shard leave it.
    """
    shard, id_col, vec_col = ctx.shard, ctx.id_col, ctx.vec_col
    test = ctx.test.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
    train = ctx.train.where(F.col(id_col).isNotNull())
    d, n_test = train.agg(F.max(F.size(vec_col))).first()[0], test.count()
    d = max(int(d or 0), 1)
    scale = float(1.0 / math.sqrt(d) if ctx.scale is None else ctx.scale)
    fit = max(1, STRIP_BYTES // (8 + 8 * d))
    rows = min(max(math.ceil(n_test / SHARD_BLOCKS), SHARD_BLOCK_ROWS // 8), SHARD_BLOCK_ROWS, fit, HELD // (len(classes) + 1))
    blocks = max(1, math.ceil(n_test / max(1, rows)))
    kind = train.schema[ctx.label_col].dataType
    code = (F.coalesce(F.array_position(F.array(*[F.lit(c).cast(kind) for c in classes]), F.col(ctx.label_col)), F.lit(len(classes) + 1)) - 1
            if classes else F.lit(0))  # no label: a class of its own
    row = lambda c: F.struct(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), c.cast("long").alias("c"))
    asked = (test.groupBy(F.pmod(id_hash(id_col, 11), F.lit(blocks)).alias("_tb")).agg(F.collect_list(row(F.lit(0))).alias("_rows"))
             .select("_tb", F.lit(-1).cast("long").alias("_s"), F.lit(0.0).alias("_w"), "_rows"))
    few = weights.select(F.col("shard").alias(shard), F.col("w").cast("double").alias("_w"))
    known = (train.join(few, shard).groupBy(F.col(shard).cast("long").alias("_s"), "_w").agg(F.collect_list(row(code)).alias("_rows"))
             .select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_tb"), "_s", "_w", "_rows"))
    both = asked.unionByName(known).repartition(blocks, "_tb").sortWithinPartitions("_tb", "_s")  # a block comes before the shards
    temperature, k, n = ctx.temperature, ctx.k, len(classes) + 1

    def kernel(batches):
        def finished(ids, total, held):
            r, c = np.nonzero(held)
            return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(c.astype(np.int32)), pa.array(total[r, c])], names=["test_id", "c", "p"])

        at = None
        for batch in batches:
            for i in range(batch.num_rows):
                here, rows = batch.column("_tb")[i].as_py(), batch.column("_rows")[i].values
                ids, v = rows.field("id").to_numpy(), rows.field("v")
                X = pc.list_flatten(v).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v) - v.null_count, -1)
                if batch.column("_s")[i].as_py() < 0:
                    if at is not None:
                        yield finished(seen, total, held)
                    order = np.argsort(ids, kind="stable")
                    at, t_ids, Xt, seen = here, ids[order], X[order], np.unique(ids)
                    total, held = np.zeros((len(seen), n)), np.zeros((len(seen), n), dtype=bool)
                elif here == at:
                    part = _Shard(ids, rows.field("c").to_numpy(), v.is_valid().to_numpy(zero_copy_only=False), X)
                    if not len(part.ids):
                        continue
                    w = batch.column("_w")[i].as_py()
                    for found, lse, codes, best in part.best(t_ids, Xt, k, scale):
                        p, voted = _share(codes, best, lse, n, temperature)
                        place = np.searchsorted(seen, found)
                        total[place] += np.where(voted, p * w, 0.0)
                        held[place] |= voted
        if at is not None:
            yield finished(seen, total, held)

    name = F.element_at(F.array(*[F.lit(c).cast(kind) for c in classes], F.lit(None).cast(kind)), F.col("c") + 1)
    return both.mapInArrow(kernel, "test_id long, c int, p double").select("test_id", name.alias("class"), "p")


def _merge(blocks: DataFrame, keys: list[str], k: int | None) -> DataFrame:
    """Log-sum-exp over a test row's blocks, then the exact rank of their candidates.

    Block rows (not candidates) go through the windows of the normaliser; only
    then are candidates exploded and ranked, in the same partitioning.
    """
    w = Window.partitionBy(*keys, "test_id")
    e = blocks.withColumn("max_score", F.max("_m").over(w))
    e = (e.withColumn("lse", F.col("max_score") + F.log(F.sum(F.col("_z") * F.exp(F.col("_m") - F.col("max_score"))).over(w)))
         .withColumn("n_ctx", F.sum("_n").over(w)))
    if k is None:
        return e.groupBy(*keys, "test_id").agg(*[F.max(c).alias(c) for c in ("n_ctx", "max_score", "lse")])
    e = e.select(*keys, "test_id", "lse", "n_ctx",
                 F.explode(F.arrays_zip(F.col("_cid").alias("i"), F.col("_cs").alias("s"))).alias("c"))
    e = e.select(*keys, "test_id", F.col("c.i").alias("train_id"), F.col("c.s").alias("score"), "lse", "n_ctx")
    e = e.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), F.col("train_id"))))
    return (e.filter(F.col("rank") <= k)
            .withColumn("weight", F.exp(F.col("score") - F.col("lse")))
            .select(*keys, "test_id", "train_id", "rank", "score", "weight", "lse", "n_ctx"))


def context_scores(test: DataFrame, train: DataFrame, vec_col: str,
                   keys: list[str] | None = None, **kw) -> DataFrame:
    """Q1: per test row, ``n_ctx``, ``max_score`` and ``lse`` (log softmax normaliser)."""
    keys = _group_keys(keys)
    return _merge(block_scores(test, train, vec_col, 0, keys, **kw), keys, None)


def top_k_context(test: DataFrame, train: DataFrame, vec_col: str, k: int,
                  keys: list[str] | None = None, shard: str | None = None, votes: bool = False, **kw) -> DataFrame | ShardContexts | LongContexts:
    """Q4: the ``k`` best train rows of every test row (k clamped to [0, n]).

    Columns: keys, test_id, train_id, rank (1 = best), score, weight
    (softmax over *all* train rows), lse, n_ctx.  With ``shard``, a column of the train rows, every test
    row has a context in each shard; those are not a table, but what M1 and M6 sum votes from.  Neither are
    contexts of more than ``FEW`` rows of which only the ``votes`` are wanted (M1).
    """
    keys = _group_keys(keys)
    k = max(int(k), 0)
    if shard is not None:
        return ShardContexts(test, train, vec_col, k, shard, **kw)
    if k > FEW:
        kw.pop("block_rows", None)
        return LongContexts(test, train, vec_col, k, **kw) if votes and not keys else whole_rows(test, train, vec_col, k, keys, **kw)
    return _merge(block_scores(test, train, vec_col, k, keys, **kw), keys, k)


def mixed_context(test: DataFrame, train: DataFrame, cols: list[str], k: int, relevance: DataFrame | None = None,
                  keys: list[str] | None = None, id_col: str = "row_id", **kw) -> DataFrame:
    """Q3: top-k context by per-feature scores, averaged with the features' relevance as weights.

    ``relevance`` is (feature, relevance), a row for each feature (Q2); without it every feature counts
    alike (samples only).  The weighted mean of products is one dot product, so no score of a single
    feature is ever stored; a missing cell adds nothing to it.
    """
    weight = {c: 1.0 for c in cols} if relevance is None else {r["feature"]: float(r["relevance"]) for r in relevance.collect()}
    cell = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols}
    own = [*(keys or []), id_col]
    asked = test.select(*own, F.array(*[cell[c] * F.lit(weight[c] / len(cols)) for c in cols]).alias("_v"))
    known = train.select(*own, F.array(*cell.values()).alias("_v"))
    return top_k_context(asked, known, "_v", k, keys, scale=1.0, **kw)


def mass_context(test: DataFrame, train: DataFrame, vec_col: str, threshold: float = 0.5,
                 retrieval_len: int = 200, mixed_method: str = "max",
                 keys: list[str] | None = None, id_col: str = "row_id", **kw) -> DataFrame:
    """Q5: smallest best-first prefix whose weight mass reaches ``threshold``.

    The prefix length is combined with ``retrieval_len`` by max or min.  Weights
    are a softmax, so the row total is 1.  With ``min`` at most
    ``retrieval_len`` candidates are needed; with ``max`` all scores of a test
    row are ranked in one task, a few test rows at a time (exact, no cap).
    """
    keys = _group_keys(keys)
    L = max(int(retrieval_len), 1)
    if mixed_method == "max":
        kw.pop("block_rows", None)
        return whole_rows(test, train, vec_col, None, keys, id_col=id_col, mass=float(threshold), least=L, **kw)
    cand = top_k_context(test, train, vec_col, L, keys, id_col=id_col, **kw)
    row = Window.partitionBy(*keys, "test_id")
    cand = cand.withColumn("_cum", F.sum("weight").over(row.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    need = F.coalesce(F.min(F.when(F.col("_cum") >= F.lit(threshold), F.col("rank"))).over(row), F.lit(L))
    return (cand.withColumn("ctx_len", F.least(need, F.lit(L), F.col("n_ctx")))
            .filter(F.col("rank") <= F.col("ctx_len")).drop("_cum"))


def context_length(n_train: int, n_classes: int, retrieval_len, dynamic_ratio: float | None = None,
                   task: str = "cls") -> int:
    """Q6 (driver metadata): resolve the context length setting to a count."""
    if isinstance(retrieval_len, str):
        ratio = 1.0 if dynamic_ratio is None else float(dynamic_ratio)
        return int(ratio * n_train / max(n_classes, 1)) if task == "cls" else int(ratio * n_train)
    if isinstance(retrieval_len, float):
        return int(retrieval_len * n_train)
    return int(retrieval_len)


def context_overlap(ctx: DataFrame, keys: list[str] | None = None, salt: int = 8,
                    diagonal: bool = False) -> DataFrame:
    """Q8: shared context rows for each pair of test rows that share any.

    The overlap matrix is ``M M^T`` of the binary test x train membership, kept
    sparse: a self equi-join on train id followed by a count per pair (with
    map-side partial aggregation).  A train row in the context of ``c`` test
    rows contributes ``c^2`` products; so that such a hot train row is not
    handled by one task, the left side is spread over ``salt`` buckets by test
    id hash and the right side is replicated once per bucket (AQE skew-join
    splitting still applies on top).  Pairs are ``test_a < test_b``; with
    ``diagonal`` each test row's own context size is added as ``(t, t)``.
    """
    keys = _group_keys(keys)
    m = ctx.select(*keys, "test_id", "train_id").dropDuplicates([*keys, "test_id", "train_id"])
    a = m.select(*keys, F.col("test_id").alias("test_a"), "train_id",
                 F.pmod(id_hash("test_id", 29), F.lit(salt)).cast("int").alias("_s"))
    b = m.select(*keys, F.col("test_id").alias("test_b"), "train_id",
                 F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_s"))
    pairs = (a.join(b, [*keys, "train_id", "_s"]).filter(F.col("test_a") < F.col("test_b"))
             .groupBy(*keys, "test_a", "test_b").agg(F.count(F.lit(1)).alias("n_shared")))
    if diagonal:
        own = m.groupBy(*keys, "test_id").agg(F.count(F.lit(1)).alias("n_shared"))
        pairs = pairs.unionByName(own.select(*keys, F.col("test_id").alias("test_a"),
                                             F.col("test_id").alias("test_b"), "n_shared"))
    return pairs


def cluster_contexts(ctx: DataFrame, assign: DataFrame, keys: list[str] | None = None,
                     distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """Q9: per cluster, the union of its test rows' context rows and its test rows."""
    keys = _group_keys(keys)
    tr = ctx.join(assign, [*keys, "test_id"]).select(*keys, "cluster_id", "train_id")
    if distinct:
        tr = tr.dropDuplicates([*keys, "cluster_id", "train_id"])
    te = assign.select(*keys, "cluster_id", "test_id")
    return tr, te


def cluster_by_context(ctx: DataFrame, k: int, rounds: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Q7: k-means over each test row's binary train-membership vector; ``(test_id, cluster_id)``.

    Starts from the ``k`` test rows with the lowest id hash and runs a fixed number of Lloyd rounds
    (ends early when no row changes).  Centres stay sparse: a table ``(cluster_id, train_id, w)``
    joined to the contexts, so distances are grouped sums and nothing is as wide as the train side.
    A row with no train row of a centre has distance |c|^2 to it, so of those only the centre with
    the smallest norm can win.  Ties go to the lower cluster; a cluster without rows keeps its centre.
    """
    from ctxtab.session import cut_lineage
    if keys:
        raise ValueError("cluster one dataset at a time")
    m = cut_lineage(ctx.select("test_id", "train_id").distinct())
    first = m.select("test_id").distinct().orderBy(id_hash("test_id", 17), "test_id").limit(max(k, 1)).collect()  # k rows
    seeds = F.array(*[F.lit(r["test_id"]).cast("long") for r in first])
    at = F.array_position(seeds, F.col("test_id").cast("long"))
    centres = m.where(at > 0).select((at - 1).cast("int").alias("cluster_id"), "train_id", F.lit(1.0).alias("w"))
    assign = None
    for _ in range(rounds):
        centres = cut_lineage(centres)
        norms = {r["cluster_id"]: r["q"] for r in centres.groupBy("cluster_id").agg(F.sum(F.col("w") * F.col("w")).alias("q")).collect()}  # k rows
        low = min(norms, key=lambda c: (round(norms[c], 9), c))
        norm = F.element_at(F.array(*[F.lit(float(norms.get(c, 0.0))) for c in range(max(norms) + 1)]), F.col("cluster_id") + 1)
        near = (m.join(centres, "train_id").groupBy("test_id", "cluster_id").agg(F.sum("w").alias("dot"))
                .select("test_id", "cluster_id", F.round(norm - 2 * F.col("dot"), 9).alias("d")))
        far = m.select("test_id").distinct().select("test_id", F.lit(low).alias("cluster_id"), F.lit(round(norms[low], 9)).alias("d"))
        now = cut_lineage(near.unionByName(far).groupBy("test_id").agg(F.min(F.struct("d", "cluster_id")).alias("b"))
                          .select("test_id", F.col("b.cluster_id").alias("cluster_id")))
        if assign is not None and now.join(assign.withColumnRenamed("cluster_id", "was"), "test_id").where("cluster_id <> was").isEmpty():
            break
        assign = now
        size = now.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
        moved = (m.join(now, "test_id").groupBy("cluster_id", "train_id").agg(F.count(F.lit(1)).alias("c")).join(size, "cluster_id")
                 .select("cluster_id", "train_id", (F.col("c") / F.col("n")).alias("w")))
        centres = moved.unionByName(centres.join(size, "cluster_id", "left_anti"))
    return assign


def row_context_table(ctx: DataFrame, train: DataFrame, label_col: str = "y",
                      id_col: str = "row_id", keys: list[str] | None = None) -> DataFrame:
    """Q11: each test row's context rows joined to their labels."""
    keys = _group_keys(keys)
    t = train.select(*keys, F.col(id_col).alias("train_id"), F.col(label_col).alias("ctx_y"))
    return ctx.join(t, [*keys, "train_id"])
