"""Periodic runs of words by descending-LCP Kruskal, and texts without the repetitions.

A run is a stretch of words with smallest period q that no neighbouring word extends; it counts
when it has ``min_length`` words and ``min_exponent`` periods or more.

1. Words are numbered by content.  A run makes some sequence of ``_least`` words stand twice in
   its document, so documents without such a sequence have none and are done.
2. The suffixes of the others are sorted by prefix doubling, a batch of documents at once, and the
   ranks of the doubling steps give the longest common prefix (LCP) of neighbours in that order.
3. Kruskal: pairs of neighbouring suffixes are united by decreasing LCP.  A class is the ordered set
   of its positions; the smaller set moves into the larger one.  Two positions that become adjacent
   at LCP l and distance d with (min_exponent - 1) * d <= l seed a run of period d and length d + l:
   were d not the smallest period, an earlier position would stand between the two.  Seeds that a
   word to the left would extend belong to a longer run and are left out.

Documents do not meet, so there is no shuffle; a task holds one small batch of texts.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.llm.words import mix, pieces, released, small_batches

MIN_LENGTH, MIN_EXPONENT = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"
RESULTS = ("n_words", "runs", "top", "collapsed")


def _least(min_length: int, min_exponent: int) -> int:
    """Smallest LCP of two positions, a period apart, at the start of a run."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def repeats_within(ids: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the documents ``ids[first[k]:first[k + 1]]`` in which some ``width`` words stand twice (or, by a hash clash, more)."""
    n = np.maximum(first[1:] - first[:-1] - width + 1, 0)
    if not n.sum():
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(doc)) + np.repeat(first[:-1] - (np.cumsum(n) - n), n)
    h = mix(doc.astype(np.uint64), 3)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mix(ids[start + k].astype(np.uint64), 7)
    order = np.argsort(h)
    twice = order[1:][h[order][1:] == h[order][:-1]]
    return np.unique(doc[twice])


def suffix_ranks(ids: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until all differ.

    Documents have no word number in common, so classes never cross them; ``end`` is the end of each
    position's document.  A rank is the place of the first suffix of the class in the whole order.
    """
    n = len(ids)
    act, key, base, levels, k = np.arange(n), ids, np.zeros(n, np.int64), [], 1
    rank = np.zeros(n, np.int64)
    while True:
        order = np.lexsort((key, base))
        act, key, base = act[order], key[order], base[order]
        at = np.arange(len(act))
        new_base = np.concatenate([[True], base[1:] != base[:-1]])[:len(act)]
        new = new_base | np.concatenate([[True], key[1:] != key[:-1]])[:len(act)]
        head = np.maximum.accumulate(np.where(new, at, 0))
        group = np.maximum.accumulate(np.where(new_base, at, 0))
        rank = rank.copy()
        rank[act] = base + head - group
        levels.append(rank)
        last = np.concatenate([new[1:], [True]])[:len(act)]
        act = act[~(new & last)]
        if not len(act):
            return levels
        nxt = act + k
        inside = nxt < end[act]
        key = np.where(inside, rank[np.minimum(nxt, n - 1)], -1)
        base = rank[act]
        k *= 2


def neighbours(levels: list[np.ndarray], end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions a, b, LCP) of suffixes that follow each other in the order with an LCP of ``least`` or more."""
    near = levels[min(len(levels) - 1, least.bit_length() - 1)]  # equal: so many words in common
    order = np.argsort(levels[-1], kind="stable")
    same = near[order][1:] == near[order][:-1]
    a, b = order[:-1][same], order[1:][same]
    lcp, x, y = np.zeros(len(a), np.int64), a.copy(), b.copy()
    for j in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((x < end[a]) & (y < end[b]))
        ok = ok[levels[j][x[ok]] == levels[j][y[ok]]]
        lcp[ok] += 1 << j
        x[ok] += 1 << j
        y[ok] += 1 << j
    much = lcp >= least
    return a[much], b[much], lcp[much]


def kruskal(a: np.ndarray, b: np.ndarray, lcp: np.ndarray, times: int) -> np.ndarray:
    """Seeds (position, distance, LCP): pairs that become adjacent at an LCP of ``times`` distances or more."""
    order = np.argsort(-lcp, kind="stable")
    sets: dict[int, list[int]] = {}
    seeds = []
    for p, q, l in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist()):
        big, small = sets.get(p) or [p], sets.get(q) or [q]
        if len(big) < len(small):
            big, small = small, big
        last, reach = None, l // times
        for k, x in enumerate(small):
            i = bisect_left(big, x)
            if i and big[i - 1] != last and x - big[i - 1] <= reach:
                seeds.append((big[i - 1], x - big[i - 1], l))
            if i < len(big) and big[i] - x <= reach and not (k + 1 < len(small) and small[k + 1] < big[i]):
                seeds.append((x, big[i] - x, l))
            big.insert(i, x)
            sets[x] = big
            last = x
        sets[p] = sets[q] = big
    return np.array(seeds, np.int64).reshape(-1, 3)


def find_runs(texts: list[list], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """Runs (start, length, period) of each list of words, by start and period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    least = _least(min_length, min_exponent)
    numbers: dict = {}
    fresh = count()
    ids = np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(fresh)) for t in texts for w in t), np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    some = repeats_within(ids, first, least)
    if not len(some):
        return out
    size = (first[1:] - first[:-1])[some]
    ends = np.cumsum(size)
    begins = ends - size
    word = ids[np.arange(ends[-1]) + np.repeat(first[:-1][some] - begins, size)] + np.repeat(np.arange(len(some)) * len(numbers), size)
    end = np.repeat(ends, size)
    seeds = kruskal(*neighbours(suffix_ranks(word, end), end, least), min_exponent - 1)
    p, d, l = seeds.T
    doc = np.searchsorted(ends, p, side="right")
    whole = (p == begins[doc]) | (word[p - 1] != word[np.minimum(p + d - 1, len(word) - 1)])
    whole &= d + l >= min_length
    p, d, l, doc = p[whole], d[whole], l[whole], doc[whole]
    order = np.lexsort((d, p))
    p, d, l, doc = p[order], d[order], l[order], doc[order]
    cut = np.searchsorted(doc, np.arange(len(some) + 1))
    for k, i in enumerate(some):
        s = slice(cut[k], cut[k + 1])
        out[i] = np.stack([p[s] - begins[k], d[s] + l[s], d[s]], 1)
    return out


def top_run(runs: list) -> tuple | None:
    """The run of the greatest length / period; ties: smallest start, then period."""
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def without_repeats(words: list[bytes], runs: list) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q:s + n] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def _runs(min_length: int, min_exponent: int):
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    name = ("start", "length", "period")

    def fn(batches):
        for batch in batches:
            for x, y in pieces(batch.column("_text")):
                texts = [(t or "").encode().split() for t in batch.column("_text").slice(x, y - x).to_pylist()]
                found = [r.tolist() for r in find_runs(texts, min_length, min_exponent)]
                best = [top_run(r) for r in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_doc").slice(x, y - x), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([[dict(zip(name, r)) for r in rs] for rs in found], pa.list_(kind)),
                     pa.array([None if r is None else dict(zip(name, r)) for r in best], kind),
                     pa.array([b" ".join(without_repeats(t, r)) for t, r in zip(texts, found)], pa.binary()).cast(pa.string())], ["_doc", *RESULTS])
    return fn


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` without the text, with n_words, runs (start, length, period), top and collapsed.

    Words are the runs of bytes other than ASCII white space, numbered from 0.  ``runs`` are ordered by
    start and period; ``top`` has the greatest length / period (null without a run; ties go to the
    smallest start, then period); ``collapsed`` is the text, joined by single spaces, without the words
    that a run holds after its first period.  Null or blank text: no words, no runs, empty text.  Null
    ids and repeated rows change nothing: a row is looked at alone.  Columns with the names of the
    results are replaced.  Empty table: empty result.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run needs two periods and a word at least")
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col and c not in RESULTS]
    given = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([given.schema["_doc"], *T._parse_datatype_string(f"n_words bigint, runs array<{RUN}>, top {RUN}, collapsed string").fields])
    return given.mapInArrow(released(_runs(min_length, min_exponent)), schema).select(*[F.col(f"_doc.`{c}`") for c in rest], *RESULTS)
