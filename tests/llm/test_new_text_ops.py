"""Fill-in-middle, periodic runs and the quality cascade against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from ctxtab.llm import fill_middle as fim
from ctxtab.llm import periodic_runs as runs
from ctxtab.llm import quality_rules as quality
from ctxtab.llm import queries
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


# ---------------------------------------------------------------- fill in middle
def _fim(i, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def _texts(seed=3):
    r = random.Random(seed)
    shared = "".join(r.choices("abc dé漢🙂\n", k=3000))
    out = [None, "", "a", "é", "🙂🙂", "x" * 20000, "é" * 9000, "<P", "a<M>b", "<<S>", "<S" * 3000, "y" * 4095 + "<P>" + "z" * 5000, "<S><P>", "<P<S<M"]
    out += [r.choice(["", "Intro 漢 "]) + shared[:r.randrange(3000)] + "".join(r.choices("ab <SPM>é", k=r.randrange(50))) for _ in range(200)]
    return out


def test_fill_in_middle(spark):
    rows = [*enumerate(_texts()), (None, "no id here"), (7, "x"), (7, "x")]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], DOCS + ", form string, _doc int").repartition(3)
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored())
    assert out.columns == ["doc_id", "_doc", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == Counter((i, *_fim(i, t)) for i, t in rows)
    assert Counter(r.back for r in out.collect()) == Counter(t or "" for _, t in rows)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


def test_chunks_follow_content_and_are_shared():
    r = np.random.default_rng(1)
    body = bytes(r.integers(97, 123, 40000, dtype=np.uint8))
    texts = [body, b"ahead of it " + body, b"", b"q" * 10000]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ends = fim.chunk_ends(raw, off)
    assert set(off[1:]) <= set(ends.tolist()) and np.diff(np.concatenate([[0], ends])).max() <= fim.MOST and (np.diff(ends) > 0).all()
    one, two = (ends[(ends > off[k]) & (ends <= off[k + 1])] - off[k] for k in (0, 1))
    memo = fim.Memo()
    fim.Document(texts[0], one.tolist(), memo)
    assert memo.hits == 0
    fim.Document(texts[1], two.tolist(), memo)
    assert memo.hits >= 0.9 * len(one)
    small = fim.Memo(1000)
    assert fim.Document(texts[1], two.tolist(), small).n == len(texts[1]) and small.held <= fim.MOST


def test_summaries_combine_at_any_boundary():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choices(["é", "漢", "🙂", "a", "<", "P", "S", ">", "<M>"], k=r.randrange(1, 12)))
        data = text.encode()
        ends = sorted({*r.sample(range(1, len(data) + 1), r.randrange(0, len(data))), len(data)})
        doc = fim.Document(data, ends, fim.Memo())
        assert doc.n == len(text) and doc.marked == any(m in text for m in ("<P>", "<S>", "<M>"))
        assert [doc.place(k) for k in range(doc.n + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]


# ---------------------------------------------------------------- periodic runs
def brute_runs(w, min_length=6, min_exponent=4):
    found = {}
    n = len(w)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q) and j > i:
                found.setdefault((i, j - i + q), q)  # the smallest period of a stretch comes first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def _periodic(r):
    w = []
    while len(w) < r.randrange(0, 120):
        part = r.choices("abc", k=r.randrange(1, 7))
        w += part * r.choice([1, 2, 4, 5, 9]) + part[:r.randrange(len(part) + 1)]
    return w


def test_runs_by_brute_force():
    r = random.Random(5)
    texts = [_periodic(r) for _ in range(1500)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 700, list("ab") * 4, list("ab") * 3, list("aab") * 30 + list("ab") * 40]
    got = runs.find_runs(texts)
    assert [[tuple(x) for x in g.tolist()] for g in got] == [brute_runs(w) for w in texts]
    assert sum(len(g) for g in got) > 500
    for length, exponent in ((1, 2), (4, 2), (9, 3)):
        got = runs.find_runs(texts[:400], length, exponent)
        assert [[tuple(x) for x in g.tolist()] for g in got] == [brute_runs(w, length, exponent) for w in texts[:400]]


def test_periodic_runs(spark):
    r = random.Random(6)
    rows = [(k, " ".join(_periodic(r))) for k in range(80)] + [(900, None), (901, ""), (902, " \n "), (None, "x y " * 9), (None, "x y " * 9), (903, "é " * 9 + "\x85 z")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], DOCS + ", runs int, _doc string").repartition(3)
    out = runs.periodic_runs(docs)
    assert out.columns == ["doc_id", "_doc", "n_words", "runs", "top", "collapsed"]
    want = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        found = brute_runs(w)
        gone = {p for s, n, q in found for p in range(s + q, s + n)}
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        want[i, len(w), tuple(found), best, b" ".join(x for p, x in enumerate(w) if p not in gone).decode()] += 1
    got = Counter((x.doc_id, x.n_words, tuple(tuple(y) for y in x.runs), x.top and tuple(x.top), x.collapsed) for x in out.collect())
    assert got == want
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_exponent=1)


def test_op12_query(spark, tmp_path):
    r = random.Random(7)
    rows = [(k, " ".join(r.choices("abcdefgh", k=r.randrange(1, 300)))) for k in range(60)] + [(60, None), (61, ""), (62, "one\ttwo")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want, planted = {}, 0
    for i, t in rows:
        w = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        found = brute_runs(w)
        gone = {x for s, n, q in found for x in range(s + q, s + n)}
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want[i] = (len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {x[0]: tuple(x[1:]) for x in out.collect()} == want and planted


# ---------------------------------------------------------------- quality rules
def _measures(text):
    w = [x.decode() for x in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    seen = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def _clean(seed=1, n=200):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghé", k=r.randrange(3, 8))) for _ in range(n))


QUALITY = [None, "", " \n ", "too short", _clean(), _clean(2) + "\n" + _clean(3), "the same three " * 40, _clean(4).replace(" ", " | "), " ".join("x" * 20 for _ in range(99)) + _clean(5, 2),
           _clean(6).upper(), " ".join(str(k) + "!" for k in range(100, 200)), "\n".join(f"- {_clean(k, 9)}" for k in range(20)), "\n".join(f"{_clean(k, 9)} ..." for k in range(20)),
           "\n".join([_clean(9, 9)] * 4 + [_clean(k, 9) for k in range(4)]), "a b c a b c a" + _clean(8), _clean(10, 3000)]


def _kept(text):
    n, chars, symbols, dup, repeat = _measures(text)
    if n < 50 or 100 * repeat > 50 * n:
        return True, False
    lines = [x for x in text.split("\n") if x.encode().split()]
    letters = [c for c in text if c.isalpha()]
    bad = (10 * symbols > n or not 3 * n <= chars <= 10 * n or 10 * dup > 3 * len(lines) or 100 * sum(any(c.isalpha() for c in w) for w in text.split()) < 80 * n
           or 2 * sum(c.isupper() for c in letters) > len(letters) or 10 * sum(x.lstrip(" \t")[:1] in "-*•" for x in lines) > 9 * len(lines)
           or 10 * sum(x.rstrip(" \t\r").endswith(("...", "…")) for x in lines) > 3 * len(lines))
    return False, not bad


def test_quality_rules(spark):
    rows = [*enumerate(QUALITY), (None, QUALITY[4]), (None, None), (4, QUALITY[4])]
    docs = spark.createDataFrame([(i, t, True, "w") for i, t in rows], DOCS + ", kept boolean, _words string").repartition(3)
    out = quality.judged(docs)
    assert out.columns == ["doc_id", "_words", *quality.RESULTS]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out.collect())
    assert got == Counter((i, *_measures(t), *_kept(t)) for i, t in rows)
    assert Counter(r.kept for r in out.collect())[True] >= 4
    assert quality.judged(spark.createDataFrame([], DOCS)).count() == 0
    assert not any(k in out._jdf.queryExecution().executedPlan().toString() for k in ("Python", "Pandas", "Arrow"))


def test_order_of_rules_changes_no_verdict(spark):
    frame = quality.measured(spark.createDataFrame(list(enumerate(QUALITY)), DOCS)).where(~quality.base_failed()).cache()
    found = quality.estimates(frame)
    order = quality.ordered(quality.RULES, found)
    assert {r.name for r in order} == set(found) and all(0 < s < 1 and c > 0 for s, c in found.values())
    rates = [found[r.name][0] / found[r.name][1] for r in order]
    assert rates == sorted(rates, reverse=True)
    base = [r[0] for r in frame.select(quality.cascade(order)).collect()]
    assert base == [r[0] for r in frame.select(quality.cascade(order[::-1])).collect()] and True in base and False in base
    each = {r.name: frame.where(quality._fails(r)).count() for r in quality.RULES}
    assert all(each.values())


def test_cascade_stops_at_the_first_rejection(spark):
    """A rule behind one that rejects is not evaluated."""
    raises = quality.Rule("raises", lambda: F.raise_error(F.lit("evaluated")).cast("boolean"))
    rejects = quality.Rule("rejects", lambda: F.col("id") >= 0)
    assert [r[0] for r in spark.range(3).select(quality.cascade([rejects, raises])).collect()] == [False] * 3
    assert quality.cascade([]) is not None
