"""Substring dedup: windows of 20 words that also start earlier are cut out of the texts.

Method (count-min prefilter).  Documents are dealt into chunks by a hash of their id.

1. Every chunk builds its own sketch: each of ``DEPTH`` rows maps every window to one of
   ``width`` cells.  The cells a chunk touches are sent, delta-coded, to the task that owns
   that slice of the sketch row; there the chunk sketches are merged into counters that stop
   at two.  Distinct windows may share a cell, so counts are overestimates, never too small.
   The owner answers every chunk with one bit for each cell it sent.
2. A chunk keeps the windows whose estimate (the least over the rows) is two or more.  Only
   these are grouped exactly, by a 128-bit fingerprint of the word sequence; a chunk sends
   one occurrence of each (its first), so that a passage in a third of all documents gives a
   group of at most one row for each chunk.
3. Each occurrence but the one with the smallest (doc_id, start) goes back to its chunk, which
   drops every word that such a window covers.

Everything that is shuffled is either the text itself (once; the three passes use the same
exchange) or packed arrays, about three bytes for each word.  Chunk and sketch sizes follow
the bytes of text; nothing is capped.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ctxtab.llm.words import Words, mix, pack_sorted, pieces, released, sequence_hashes, small_batches, text_buffer, unpack_sorted, window_starts

DEPTH = 2
CHUNK_BYTES = 8 << 20
LEAST_CHUNKS = 24
LAST_ID = 2**63 - 1
_BLOB = pa.schema([("slice", pa.int64()), ("chunk", pa.int64()), ("row", pa.int32()), ("blob", pa.binary())])
_BLOB_DDL = "slice long, chunk long, row int, blob binary"


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOB)], schema=_BLOB)


def _in_order(tbl: pa.Table) -> pa.Table:
    """Rows by (id, text): the same order in each pass."""
    return tbl.sort_by([("_id", "ascending"), ("_text", "ascending")]).combine_chunks()


def _windows(tbl: pa.Table, width: int):
    """For each piece of a chunk: word hashes, window starts in the piece, words before the piece, row of each window."""
    before = 0
    col = tbl["_text"]
    for a, b in pieces(col):
        w = Words(*text_buffer(col.slice(a, b - a)))
        yield w.hashes(), window_starts(w.first, width), before, w.first, a
        before += len(w.start)


def _cells(windows: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(windows, 0x632BE59BD9B4E019 * (row + 1) % 2**64) >> np.uint64(64 - bits)).astype(np.int64)


def _sorted_cells(tbl: pa.Table, width: int, bits: int) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
    for h, start, *_ in _windows(tbl, width):
        win = sequence_hashes(h, start, width)
        for r in range(DEPTH):
            out[r].append(_cells(win, r, bits))
    return [np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in out]


def _edges(bits: int, slices: int) -> np.ndarray:
    return np.array([(k << bits) // slices for k in range(slices + 1)], np.int64)


def _sketch(width: int, bits: int, slices: int):
    edges = _edges(bits, slices)

    def fn(tbl: pa.Table) -> pa.Table:
        chunk, rows = tbl["_chunk"][0].as_py(), []
        for r, cells in enumerate(_sorted_cells(tbl, width, bits)):
            cells = cells[np.diff(cells, prepend=-1) > 0]
            at = np.searchsorted(cells, edges)
            rows += [(k, chunk, r, pack_sorted(cells[at[k]:at[k + 1]] - edges[k])) for k in range(slices) if at[k] < at[k + 1]]
        return _rows(rows)

    return fn


def _merge(bits: int, slices: int):
    edges = _edges(bits, slices)

    def fn(tbl: pa.Table) -> pa.Table:
        k, r = tbl["slice"][0].as_py(), tbl["row"][0].as_py()
        count = np.zeros(edges[k + 1] - edges[k], np.uint8)
        for blob in tbl["blob"]:
            cells = unpack_sorted(blob.as_py())
            count[cells] = np.minimum(count[cells] + 1, 2)
        return _rows([(k, c.as_py(), r, np.packbits(count[unpack_sorted(b.as_py())] == 2).tobytes()) for c, b in zip(tbl["chunk"], tbl["blob"])])

    return fn


def _repeated(tbl: pa.Table, answers: pa.Table, width: int, bits: int, slices: int) -> list[np.ndarray]:
    """Tables of cells (modulo their size) whose merged count is at least two, for each sketch row."""
    edges = _edges(bits, slices)
    bit_of = {(r, k): b for r, k, b in zip(answers["row"].to_pylist(), answers["slice"].to_pylist(), answers["blob"].to_pylist())}
    out = []
    for r, cells in enumerate(_sorted_cells(tbl, width, bits)):
        new = np.diff(cells, prepend=-1) > 0
        own = cells[~new]
        cells = cells[new]
        at = np.searchsorted(cells, edges)
        hit = np.zeros(len(cells), bool)
        for k in range(slices):
            if (n := at[k + 1] - at[k]) and (r, k) in bit_of:
                hit[at[k]:at[k + 1]] = np.unpackbits(np.frombuffer(bit_of[r, k], np.uint8), count=n)
        size = 1 << max(10, min(24, int(8 * len(cells)).bit_length()))
        table = np.zeros(size, bool)
        table[cells[hit] & (size - 1)] = True
        table[own & (size - 1)] = True
        out.append(table)
    return out


def _candidates(width: int, bits: int, slices: int):
    def fn(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([])
        docs = _in_order(docs)
        chunk, ids = docs["_chunk"][0].as_py(), docs["_id"].to_numpy()
        tables = _repeated(docs, answers, width, bits, slices)
        h1, h2, at, who = [], [], [], []
        for h, start, before, first, row0 in _windows(docs, width):
            win = sequence_hashes(h, start, width)
            keep = np.ones(len(win), bool)
            for r, table in enumerate(tables):
                keep &= table[_cells(win, r, bits) & (len(table) - 1)]
            start = start[keep]
            h1.append(win[keep])
            h2.append(sequence_hashes(h, start, width, second=True))
            at.append(start + before)
            who.append(row0 + np.searchsorted(first, start, side="right") - 1)
        h1, h2, at = np.concatenate(h1), np.concatenate(h2), np.concatenate(at).astype(np.uint32)
        who = ids[np.concatenate(who)]
        order = np.lexsort((at, h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rows = [(chunk % slices, chunk, -1, np.sort(at[order[~new]]).tobytes())]  # later in the same chunk: settled here
        send = np.sort(order[new])
        part = ((h1[send] >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[by], np.arange(slices + 1))
        for k in range(slices):
            if cut[k] < cut[k + 1]:
                i = send[by[cut[k]:cut[k + 1]]]
                rows.append((k, chunk, 0, h1[i].tobytes() + h2[i].tobytes() + who[i].astype(np.int64).tobytes() + at[i].tobytes()))
        return _rows(rows)

    return fn


def _later(tbl: pa.Table) -> pa.Table:
    """Of each window all occurrences but the earliest, back to their chunks."""
    k = tbl["slice"][0].as_py()
    rows = [(k, c.as_py(), -1, b.as_py()) for c, r, b in zip(tbl["chunk"], tbl["row"], tbl["blob"]) if r.as_py() < 0]
    parts = [(c.as_py(), b.as_py()) for c, r, b in zip(tbl["chunk"], tbl["row"], tbl["blob"]) if r.as_py() == 0]
    if parts:
        n = [len(b) // 28 for _, b in parts]
        take = lambda kind, scale, skip: np.concatenate([np.frombuffer(b, kind, m, skip * m) for (_, b), m in zip(parts, n)])
        h1, h2, who, at = take(np.uint64, 8, 0), take(np.uint64, 8, 8), take(np.int64, 8, 16), take(np.uint32, 4, 24)
        chunk = np.repeat(np.array([c for c, _ in parts], np.int64), n)
        order = np.lexsort((at, chunk, who, h2, h1))  # rows that share an id: by chunk
        a, b = h1[order], h2[order]
        late = order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        late = late[np.argsort(chunk[late], kind="stable")]
        which, first = np.unique(chunk[late], return_index=True)
        for c, x in zip(which, np.split(at[late], first[1:])):
            rows.append((k, int(c), 0, np.sort(x).tobytes()))
    return _rows(rows)


def _cut(width: int, whole: bool, schema: pa.Schema):
    def fn(docs: pa.Table, late: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = _in_order(docs)
        at = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(b, np.uint32) for b in late["blob"].to_pylist())]).astype(np.int64)
        texts = [t.as_py().encode("utf-8", "surrogatepass").split() if t.is_valid else [] for t in docs["_text"]]
        size = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        cover = np.zeros(first[-1] + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, np.minimum(at + width, first[-1]), -1)
        keep = np.cumsum(cover)[:-1] == 0
        kept = [b" ".join(t if (k := keep[a:a + len(t)]).all() else compress(t, k)).decode("utf-8", "surrogatepass") for t, a in zip(texts, first)]
        if whole:
            kept = [k if t is None or not keep[a:a + n].all() else t for k, t, a, n in zip(kept, docs["_text"].to_pylist(), first, size)]
        gone = size - np.add.reduceat(np.append(keep, False).astype(np.int64), first[:-1]) * (size > 0) if len(size) else size
        out = docs.drop_columns(["_chunk", "_id", "_text"])
        for name, col in (("n_words", pa.array(size)), ("n_removed", pa.array(gone)), ("kept_text", pa.array(kept, pa.string()))):
            out = out.append_column(name, col)
        return out.cast(schema)

    return fn


def cut_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20,
                         whole: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    A word goes when some window of ``width`` words that covers it has a word sequence that also
    starts earlier: in a document with a smaller id, or before it in the same document.  Windows
    are judged on the input.  Null text: no words.  Texts of fewer than ``width`` words stay whole.
    Null ids come after all others.  Rows that share an id (many null ids, say) come in the order of
    a hash of id and text, which also deals them over chunks; windows do not reach across rows, so of
    equal rows the first keeps its words.  Columns
    named like the three results are replaced; others pass through.  Empty table: empty result.
    ``whole``: a text that loses nothing is returned as it is, with its own white space.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_text")
    nbytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    slices = max(LEAST_CHUNKS, -(-int(nbytes) // CHUNK_BYTES))
    bits = max(16, int(nbytes).bit_length())
    dealt = docs.select(
        F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.col(text_col)), F.lit(slices)).alias("_chunk"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"), F.col(text_col).alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_doc"))
    kept = T.StructType([dealt.schema["_doc"], *[T.StructField(n, t) for n, t in
                         (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()))]])
    chunks = dealt.groupBy("_chunk")
    merged = (chunks.applyInArrow(released(_sketch(width, bits, slices)), _BLOB_DDL)
              .groupBy("slice", "row").applyInArrow(released(_merge(bits, slices)), _BLOB_DDL))
    later = (chunks.cogroup(merged.groupBy("chunk")).applyInArrow(released(_candidates(width, bits, slices)), _BLOB_DDL)
             .groupBy("slice").applyInArrow(released(_later), _BLOB_DDL))
    return chunks.cogroup(later.groupBy("chunk")).applyInArrow(released(_cut(width, whole, to_arrow_schema(kept))), kept).select("_doc.*", "n_words", "n_removed", "kept_text")
