"""Fill-in-middle transformation with content-defined chunk memoization.

A text is cut into prefix, middle and suffix at two code points.  To find them without looking at
every character of texts that are largely the same:

1. Chunks.  A rolling hash over ``WINDOW`` bytes ends a chunk wherever its low bits are zero, so
   equal passages give equal chunks wherever they stand; a chunk has ``MOST`` bytes at most.
2. Memo.  A task keeps the summaries of the chunks it has met, by content: the dictionary compares
   the whole chunk, so a hash that clashes finds nothing wrong.  A summary holds the code points that
   begin in the chunk, whether a marker lies in it, and its first and last bytes, which tell whether
   a marker lies across a boundary.  The memo starts anew at ``MEMO_BYTES``.
3. Cuts.  Summaries are combined from left to right: their counts give the length in code points
   and the chunk that holds each cut; only that chunk is looked into.

The cuts, the form and the order of the parts follow from a hash of the document's id alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.llm.words import pieces, released, small_batches, text_buffer

# Fixed values of the form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORM_RATE, SPM_RATE = 90, 20  # of 100

WINDOW = 16
CUT_BITS = 9          # a chunk has 512 bytes on average
MOST = 4096
MEMO_BYTES = 32 << 20
_GEAR = np.random.default_rng(20240801).integers(1, 2**32, 256, dtype=np.uint32)
_STEP = 0x9E3779B1
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_EDGE = max(map(len, _MARKS)) - 1
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def chunk_ends(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted ends of the chunks of rows ``raw[off[i]:off[i + 1]]``; the end of each row that has bytes is one."""
    h = _GEAR[raw]
    width, step = 1, _STEP
    while width < WINDOW:  # h[i] covers ``width`` bytes up to i; twice as many after each step
        h[width:] += h[:-width] * np.uint32(step)
        width, step = 2 * width, step * step % 2**32
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    row = np.searchsorted(off, at - 1, side="right") - 1
    at = at[at - off[row] >= WINDOW]  # the window lies in the row
    ends = np.unique(np.concatenate([at, off[1:][off[1:] > off[:-1]]]))
    begin = np.concatenate([[0], ends[:-1]])
    more = (ends - begin - 1) // MOST
    inner = np.repeat(begin, more) + MOST * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    return np.sort(np.concatenate([ends, inner]))


def summary(chunk: bytes) -> tuple[int, bool, bytes, bytes]:
    """(code points that begin here, a marker inside, first bytes, last bytes)."""
    return len(chunk.translate(None, _CONTINUED)), any(m in chunk for m in _MARKS), chunk[:_EDGE], chunk[-_EDGE:]


class Memo:
    """Summaries by chunk content."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most, self.held, self.hits, self.known = most, 0, 0, {}

    def __call__(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        found = self.known.get(chunk)
        if found is None:
            found = summary(chunk)
            self.held += len(chunk)
            if self.held > self.most:
                self.known, self.held = {}, len(chunk)
            self.known[chunk] = found
        else:
            self.hits += 1
        return found


class Document:
    """Chunks of one text with their counts combined."""

    def __init__(self, data: bytes, ends: list[int], memo: Memo):
        self.data, self.begins, self.before, self.marked = data, [0, *ends[:-1]] if ends else [], [], False
        n, tail = 0, b""
        for a, b in zip(self.begins, ends):
            count, inside, first, last = memo(data[a:b])
            self.before.append(n)
            n += count
            self.marked = self.marked or inside or any(m in tail + first for m in _MARKS)
            tail = (tail + last)[-_EDGE:]
        self.n = n

    def place(self, point: int) -> int:
        """Byte at which code point ``point`` begins (the end of the text for the number of them)."""
        if point >= self.n:
            return len(self.data)
        k = bisect_right(self.before, point) - 1
        part = np.frombuffer(self.data, np.uint8, (self.begins[k + 1] if k + 1 < len(self.begins) else len(self.data)) - self.begins[k], self.begins[k])
        return self.begins[k] + int(np.flatnonzero((part & 0xC0) != 0x80)[point - self.before[k]])


def draws(key: str) -> tuple[int, int, int, int]:
    """First four 8-digit groups of the hex sha256 of ``key``."""
    d = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(d[8 * k:8 * k + 8], 16) for k in range(4))


def arranged(doc: Document, key: str) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points of prefix and middle, output) of a document."""
    h1, h2, h3, h4 = draws(key)
    if not doc.n or doc.marked or h3 % 100 >= FORM_RATE:
        return "plain", None, None, doc.data
    one, two = sorted((h1 % (doc.n + 1), h2 % (doc.n + 1)))
    a, b = doc.place(one), doc.place(two)
    prefix, middle, suffix = doc.data[:a], doc.data[a:b], doc.data[b:]
    p, s, m = _MARKS
    if h4 % 100 < SPM_RATE:
        return "spm", one, two - one, s + suffix + p + prefix + m + middle
    return "psm", one, two - one, p + prefix + s + suffix + m + middle


def _transform(batches):
    memo = Memo()
    for batch in batches:
        keys = batch.column("_key").to_pylist()
        for x, y in pieces(batch.column("_text")):
            raw, off = text_buffer(batch.column("_text").slice(x, y - x))
            ends = chunk_ends(raw, off)
            cut, data, rows = np.searchsorted(ends, off, side="right"), raw.tobytes(), []
            for k in range(y - x):
                a = int(off[k])
                doc = Document(data[a:off[k + 1]], (ends[cut[k]:cut[k + 1]] - a).tolist(), memo)
                rows.append((doc.n, *arranged(doc, keys[x + k])))
            n, form, prefix, middle, out = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc").slice(x, y - x), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["_doc", *RESULTS])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """``docs`` without the text, with n (code points), form, prefix_chars, middle_chars and output.

    The cuts are drawn from ``seed:`` and the decimal id; a null id counts as an empty one.  Null
    text: empty.  An empty text, one that holds a marker, and one in ten others stay plain.  Equal
    rows get equal results.  Columns with the names of the results are replaced.  Empty table: empty
    result.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col and c not in RESULTS]
    given = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_doc"), F.col(f"`{text_col}`").alias("_text"),
                        F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("_key"))
    schema = T.StructType([given.schema["_doc"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                           T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return given.mapInArrow(released(_transform), schema).select(*[F.col(f"_doc.`{c}`") for c in rest], *RESULTS)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, rebuilt from output and form alone: a text with a marker is always plain, so markers split exactly."""
    part = F.split(F.col(output), "|".join((PREFIX, SUFFIX, MIDDLE)))
    piece = lambda *k: F.concat(*[F.get(part, F.lit(i)) for i in k])
    return F.when(F.col(form) == "psm", piece(1, 3, 2)).when(F.col(form) == "spm", piece(2, 3, 1)).otherwise(F.col(output))
