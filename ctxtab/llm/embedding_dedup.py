"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors are one node with a count.  A table gives every node the signs of its products with
``bits`` seeded random hyperplanes; two vectors at angle t agree on all with probability
(1 - t / pi) ** bits, so ``tables`` is set from the threshold for a chance of missing a pair of
less than ``MISS``.  ``bits`` grows with the logarithm of the nodes, so that buckets stay small.
A bucket of more than ``BLOCK`` nodes is compared in cells of two blocks each: all its pairs, in
bounded memory.  Within a cell vectors are brought to length 1 (first divided by their largest
component, so that no square overflows or vanishes) and cosines are one matrix product in double
precision.  Vectors travel as packed bytes in the precision of the input.  A linked pair
counts in the first table in which the two share a bucket; a cell returns counts and the components
of its links, a row for each linked node, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxtab.llm.components import components
from ctxtab.llm.topk_search import usable
from ctxtab.session import cut_lineage

THRESHOLD = 0.95
MISS = 0.005         # chance that a pair right at the threshold shares no bucket
BUCKET = 256         # nodes of a bucket that the number of bits aims at
BLOCK = 2048
SEED = 20240715


def plan(nodes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for so many nodes."""
    bits = max(4, math.ceil(math.log2(nodes / BUCKET)) if nodes > BUCKET else 4)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length as rows of length 1."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(bits: int, tables: int, kind: str):
    def fn(batches):
        for batch in batches:
            vec = batch.column("vec")
            n = len(vec)
            off = vec.offsets.to_numpy()
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(kind)
            dims, begin = np.diff(off), off[:-1] - off[0]
            packed = [flat[a:a + d].tobytes() for a, d in zip(begin, dims)]
            codes = np.zeros((n, tables), np.int64)
            for d in np.unique(dims):
                planes = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), tables * bits))
                rows = np.flatnonzero(dims == d)
                signs = (_unit([packed[r] for r in rows], kind) @ planes >= 0).reshape(len(rows), tables, bits)
                codes[rows] = signs @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(packed, pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                                             ["node", "n", "vec", "codes"])
    return fn


def _links(threshold: float, kind: str):
    """Of one cell: for each node the rows linked with it here first, and the smallest node joined to it here."""
    def fn(tbl: pa.Table) -> pa.Table:
        table, node = tbl["table"][0].as_py(), tbl["node"].combine_chunks()
        side, rows = tbl["side"].to_numpy(), tbl["n"].to_numpy()
        x = _unit(tbl["vec"].to_pylist(), kind)
        codes = np.array(tbl["codes"].combine_chunks().flatten().to_numpy()).reshape(len(node), -1)[:, :table]
        left, right = [], []
        for a in range(0, len(node), 512):
            cos = x[a:a + 512] @ x.T
            i, j = np.nonzero(cos >= threshold)
            i += a
            ok = (i < j) & ((side[i] != side[j]) | (side[i] == 2))
            i, j = i[ok], j[ok]
            new = ~(codes[i] == codes[j]).any(1) if table else np.ones(len(i), bool)
            left.append(i[new])
            right.append(j[new])
        i, j = np.concatenate(left), np.concatenate(right)
        linked = np.bincount(i, rows[j], len(node)) + np.bincount(j, rows[i], len(node))
        low = np.arange(len(node))
        while True:
            less = low.copy()
            np.minimum.at(less, i, low[j])
            np.minimum.at(less, j, low[i])
            less = less[less]
            if (less == low).all():
                break
            low = less
        some = np.flatnonzero(linked > 0)
        return pa.table({"node": node.take(pa.array(some)), "joined": node.take(pa.array(low[some])), "linked": pa.array(linked[some].astype(np.int64))})
    return fn


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, joined, linked) for each cell that links a node of ``nodes`` (node string, n long, vec array<float or double>).

    ``linked`` adds up, over the cells, to the rows at cosine >= threshold from the node (each pair of
    nodes counts in one cell only); (node, joined) rows connect what the cell's links connect.
    """
    bits, tables = plan(nodes.count(), threshold)
    kind = "<f4" if nodes.schema["vec"].dataType.simpleString() == "array<float>" else "<f8"
    coded = nodes.mapInArrow(_codes(bits, tables, kind), "node string, n long, vec binary, codes array<bigint>")
    keyed = cut_lineage(coded.withColumn("dims", F.octet_length("vec")).select("node", "n", "vec", "codes", "dims"))
    bucket = ["dims", "table", "code"]
    spread = keyed.select("node", "n", "vec", "codes", "dims", F.posexplode("codes").alias("table", "code"))
    size = (keyed.select("dims", F.posexplode("codes").alias("table", "code")).groupBy(*bucket).agg(F.count("*").alias("size"))
            .where("size > 1").select(*bucket, F.ceil(F.col("size") / BLOCK).cast("long").alias("m")))
    cells = (spread.join(size, bucket).withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
             .select(*bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "vec", "codes",
                     F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side")))
    return cells.groupBy(*bucket, "i", "j").applyInArrow(_links(threshold, kind), "node string, joined string, linked long")


def near_duplicates(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row: id, n_links, component_id, kept.

    ``n_links`` counts the other rows linked directly (cosine >= threshold; equal vectors link),
    ``component_id`` is the smallest id reachable by links, ``kept`` whether it is the own one.
    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of other
    lengths, link with nothing.  A null id: its row counts as linked with no id of its own, so
    component_id is the smallest id of the others, else null, and kept is false.  Of rows that
    share an id and a component each is kept.  Empty table: empty result.
    """
    kind = "float" if vecs.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    vec = F.transform(F.col(vec_col), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 and 0.0 are one
    fine = usable(F.col(vec_col)) & F.coalesce(F.exists(F.col(vec_col), lambda x: x != 0), F.lit(False))
    rows = vecs.select(F.col(id_col).alias("_id"), F.when(fine, vec).alias("vec"))
    rows = rows.withColumn("node", F.when(F.col("vec").isNotNull(), F.sha2(F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))), 256)))
    members = cut_lineage(rows.select("_id", "node"))
    nodes = cut_lineage(rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.first("vec").alias("vec")))
    count = members.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("_id").alias("low"))
    found = cut_lineage(links(nodes, threshold))
    degree = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    roots = components(found, "node", "joined")
    info = (count.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(degree, "node", "left"))
    lowest = info.groupBy("root").agg(F.min("low").alias("component"))
    info = info.join(lowest, "root").select("node", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component")
    out = members.join(info, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
