"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into the spans of the public pre-tokenization pattern.  A task keeps the ids of the
spans it has met; the spans of a piece of input that are new are encoded together:

* all their symbols lie in one array (linked to the next and the previous symbol of the same span),
* an index maps each adjacent pair that has a merge rank to all positions where it occurs (exact
  lists for the present window of ranks, one common list for those beyond),
* a heap holds the active ranks.  The lowest rank is applied to all its positions at once, of
  overlapping ones to the left; places that a merge has changed are skipped, the pairs it creates
  are added to the index, and their ranks become active.

This is the order in which each span alone would be merged (lowest rank first, leftmost first),
since spans do not share symbols.  Decoding joins the bytes of the ids; invalid UTF-8 becomes
U+FFFD.  The vocabulary file is a parameter; its tables (a fixed size) are broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.llm.words import ArrayLookup, pieces, released, small_batches

# Fixed value: the pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 1024        # ranks whose lists are kept exactly
BATCH = 4 << 20      # bytes of text whose new spans are merged together
CACHE = 300_000      # spans that a task keeps; more only means encoding some again


def _byte_of() -> dict[str, int]:
    """Character of the vocabulary file for each byte: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges by pair of ids, bytes of each id, added tokens that are taken out of a text first."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of()
        ids = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for text, i in ids.items():
            if text not in self.added:
                self.bytes[i] = bytes(byte[c] for c in text)
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.single = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.single[b] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = np.array([(ids[a], ids[b]) for a, b in merges], np.int64).reshape(-1, 2)  # by rank
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)


class _Spans(dict):
    """Number of each span, given at first sight."""

    def __missing__(self, span):
        self[span] = n = len(self)
        return n


class Encoder:
    """Encodes texts for one task, keeping the ids of the spans it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.spans = regex.compile(PATTERN)
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.added, key=len, reverse=True))) + ")") if vocab.added else None
        self.none = len(vocab.pairs)
        self.rank = ArrayLookup(_pair_keys(vocab.pairs[:, 0], vocab.pairs[:, 1]), self.none)
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.first = _Spans(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _split(self, text: str) -> list[str]:
        """Spans of a text; an added token in it is a span of its own, marked as such."""
        if self.added is None or not any(t in text for t in self.vocab.added):
            return self.spans.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.added.split(text)):
            out += [(part,)] if k % 2 else self.spans.findall(part)
        return out

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text; the new spans of all of them are merged together."""
        if len(self.known) > CACHE:
            self._forget()
        number = self.known.__getitem__
        rows = [np.fromiter(map(number, self._split(t)), np.int32) for t in texts]
        new = list(islice(self.known, len(self.first) - 1, None))
        if new:
            plain = [s for s in new if isinstance(s, str)]
            ids, first = self._merge_all([s.encode("utf-8", "surrogatepass") for s in plain])
            if len(plain) < len(new):
                size = np.array([0 if isinstance(s, str) else 1 for s in new])
                size[size == 0] = np.diff(first)
                ends = np.cumsum(size)
                out = np.zeros(ends[-1], np.int32)
                added = np.array([not isinstance(s, str) for s in new])
                out[(ends - size)[added]] = [self.vocab.added[s[0]] for s in new if not isinstance(s, str)]
                rest = np.ones(len(out), bool)
                rest[(ends - size)[added]] = False
                out[rest] = ids
                ids, first = out, np.concatenate([[0], ends])
            self.first = np.concatenate([self.first, first[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        out = []
        for k in rows:
            n = self.first[k + 1] - self.first[k]
            ends = np.cumsum(n)
            out.append(self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[k] - (ends - n), n)])
        return out

    def _merge_all(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans, one after the other, and where each begins."""
        start = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int64)
        symbol = self.vocab.single[np.frombuffer(b"".join(spans), np.uint8)]
        n = len(symbol)
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[start[1:] - 1] = -1
        prev[start[:-1]] = -1
        at = np.flatnonzero(nxt >= 0)
        later = self._ranked(symbol[at], symbol[nxt[at]], at)
        later = [later[0]], [later[1]]               # occurrences of pairs beyond the present window of ranks
        while sum(map(len, later[0])):
            rank, at = np.concatenate(later[0]), np.concatenate(later[1])
            top = (int(rank.min()) // WINDOW + 1) * WINDOW
            now = rank < top
            later = [rank[~now]], [at[~now]]
            where: dict[int, list[np.ndarray]] = {}  # the index of this window: all positions of each pair, by rank
            self._index(rank[now], at[now], where)
            heap = sorted(where)
            while heap:
                r = heapq.heappop(heap)
                if r not in where:
                    continue
                rank, at = self._apply(r, where.pop(r), symbol, nxt, prev)
                now = rank < top
                if now.any():
                    for r in self._index(rank[now], at[now], where):
                        heapq.heappush(heap, r)
                    rank, at = rank[~now], at[~now]
                later[0].append(rank)
                later[1].append(at)
        live = symbol >= 0
        return symbol[live].astype(np.int32), np.concatenate([[0], np.cumsum(live)])[start]

    def _ranked(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, position) of the pairs that merge at all."""
        rank = self.rank(_pair_keys(a, b))
        some = rank < self.none
        return rank[some], at[some]

    @staticmethod
    def _index(rank: np.ndarray, at: np.ndarray, where: dict[int, list[np.ndarray]]) -> list[int]:
        """Add occurrences to the lists of their pairs; the ranks touched."""
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        ranks = rank[np.concatenate([[0], cut])].tolist()
        for r, part in zip(ranks, np.split(at, cut)):
            where.setdefault(r, []).append(part)
        return ranks

    def _apply(self, r: int, parts: list[np.ndarray], symbol, nxt, prev) -> tuple[np.ndarray, np.ndarray]:
        """Merge one pair at all its positions; the occurrences of ranked pairs that this creates."""
        a, b = self.vocab.pairs[r]
        merged = self.vocab.merged[r]
        i = parts[0] if len(parts) == 1 else np.concatenate(parts)
        j = nxt[i]
        fine = (symbol[i] == a) & (j >= 0) & (symbol[j] == b)   # others have been changed by a merge
        i = i[fine]
        if a == b or len(parts) > 1:
            i = np.unique(i)
        if a == b and len(i) > 1:  # of overlapping places the left one counts
            taken, keep = -1, []
            for x, y in zip(i.tolist(), nxt[i].tolist()):
                if x != taken:
                    keep.append(x)
                    taken = y
            i = np.array(keep)
        j = nxt[i]
        after = nxt[j]
        symbol[i], symbol[j], nxt[i] = merged, -1, after
        right = after >= 0
        prev[after[right]] = i[right]
        before = prev[i]
        left = before >= 0
        at = np.concatenate([i[right], before[left]])
        return self._ranked(symbol[at], symbol[nxt[at]], at)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64) + np.uint64(1)


class Decoder:
    """Text of ids: their bytes, one after the other."""

    def __init__(self, table: list[bytes]):
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in table])])

    def decode(self, ids: np.ndarray) -> str:
        i = ids[(ids >= 0) & (ids < len(self.begin) - 1)].astype(np.int64)
        n = self.begin[i + 1] - self.begin[i]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[i] - (ends - n), n)
        return self.data[at].tobytes().decode("utf-8", "replace")


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids",
           decoded_col: str | None = None, digest_col: str | None = None, with_text: bool = True) -> DataFrame:
    """``docs`` with the token ids of the whole text (array<int>); special tokens in a text are recognised.

    ``decoded_col`` adds the text decoded from the ids again and ``digest_col`` the SHA-256 of the
    ids as little-endian unsigned 32-bit integers, in the same pass.  A null text counts as empty and
    has no ids.  Columns named like the results are replaced; ``with_text=False`` leaves the text behind.
    """
    small_batches(docs.sparkSession)
    extra = [c for c in (decoded_col, digest_col) if c]
    docs = docs.drop(ids_col, *extra)
    keep = [c for c in docs.columns if with_text or c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    schema = T.StructType([T.StructField("_doc", docs.select(*[F.col(f"`{c}`") for c in keep]).schema), T.StructField("_ids", T.ArrayType(T.IntegerType())),
                           *[T.StructField(f"_{k}", T.StringType()) for k in range(len(extra))]])

    def fn(batches):
        encoder, decoder = Encoder(shared.value), Decoder(shared.value.bytes)
        make = [f for c, f in ((decoded_col, decoder.decode), (digest_col, _digest)) if c]
        for batch in batches:
            text = (pc.struct_field(batch.column("_doc"), at) if with_text else batch.column("_text")).fill_null("")
            for a, b in pieces(text, BATCH):
                ids = encoder.encode(t.as_py() for t in text.slice(a, b - a))
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                more = [pa.array([f(x) for x in ids], pa.string()) for f in make]
                yield pa.RecordBatch.from_arrays([batch.column("_doc").slice(a, b - a), lists, *more], names)

    names = [f.name for f in schema]
    at = docs.columns.index(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), *([] if with_text else [F.col(text_col).alias("_text")]))
    return rows.mapInArrow(released(fn), schema).select("_doc.*", F.col("_ids").alias(ids_col), *[F.col(f"_{k}").alias(c) for k, c in enumerate(extra)])


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids, special tokens included; null ids give null, invalid UTF-8 U+FFFD.

    Ids outside the vocabulary, and null ones in a list, are left out.
    """
    small_batches(rows.sparkSession)
    rows = rows.drop(text_col)
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(path).bytes)
    schema = T.StructType([T.StructField("_doc", rows.schema), T.StructField("_text", T.StringType())])

    def fn(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column("_ids")
            off = lists.offsets.to_numpy()
            ids = lists.values.fill_null(-1).to_numpy()
            texts = [decoder.decode(ids[a:b]) if ok else None for ok, a, b in zip(lists.is_valid().to_pylist(), off, off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(texts, pa.string())], ["_doc", "_text"])

    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_doc"), F.col(ids_col).alias("_ids"))
    return packed.mapInArrow(released(fn), schema).select("_doc.*", F.col("_text").alias(text_col))
