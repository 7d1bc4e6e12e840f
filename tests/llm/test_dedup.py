"""Substring dedup, n-gram join, components and embedding dedup against brute force on small tables."""

from __future__ import annotations

import random

import numpy as np
from ctxtab.llm import embedding_dedup, ngram_join, substring_dedup
from ctxtab.llm.components import components
from ctxtab.llm.words import Words, pack_sorted, text_buffer, unpack_sorted, window_starts

from tests.llm import util

import pyarrow as pa

DOCS = "doc_id long, text string"


def _corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    passage = " ".join(r.choices(vocab, k=55))
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "one two"), (5, "ONE two"), (6, "x" * 5000), (7, " a b c d é " * 30)]
    for i in range(8, n):
        w = r.choices(vocab, k=r.choice([5, 19, 20, 21, 60, 200]))
        if i % 4 == 0:
            w[len(w) // 2:len(w) // 2] = passage.split()
        rows.append((i, r.choice([" ", "\n", "  "]).join(w)))
    for i in range(n, n + 30):  # copies and near copies
        w = rows[r.randrange(8, n)][1].split()
        for _ in range(len(w) // 25):
            w[r.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w) if i % 2 else rows[20][1]))
    loop = " ".join(["again and again we say"] * 12)
    return rows + [(500, loop), (501, "Y" + loop), (502, loop)]


def test_words_of_a_buffer():
    texts = ["a  b", None, "", " c", "d", "\x0bé f g\x85"]
    w = Words(*text_buffer(pa.array(texts)[1:]))
    assert [bytes(w.raw[a:b]).decode() for a, b in zip(w.start, w.end)] == [x.decode() for t in texts[1:] for x in util.words(t)]
    assert np.diff(w.first).tolist() == [len(util.words(t)) for t in texts[1:]]
    h = w.hashes()
    assert len(set(h.tolist())) == len(h)
    assert window_starts(np.array([0, 3, 3, 5, 10]), 3).tolist() == [0, 5, 6, 7]
    for v in ([], [0], [5, 5, 300, 2**40]):
        assert unpack_sorted(pack_sorted(np.array(v, np.int64))).tolist() == v


def test_substring_dedup(spark):
    rows = _corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.cut_repeated_windows(docs).collect()}
    assert got == util.cut(rows)


def test_substring_dedup_edges(spark):
    t = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (None, t, None), (2, " ".join(t.split()[:19]), "b")], DOCS + ", _doc string")
    out = substring_dedup.cut_repeated_windows(docs)
    assert out.columns == ["doc_id", "_doc", "n_words", "n_removed", "kept_text"]
    assert sorted((r.doc_id or 0, r.n_removed) for r in out.collect()) == [(0, 25), (1, 0), (1, 25), (2, 0)]
    assert substring_dedup.cut_repeated_windows(spark.createDataFrame([], DOCS)).count() == 0
    many = spark.createDataFrame([(None, f"row {k} " + t) for k in range(60)], DOCS)
    many = substring_dedup.cut_repeated_windows(many)
    assert sorted(r.n_removed for r in many.collect()) == [0, *[25] * 59]
    whole = substring_dedup.cut_repeated_windows(spark.createDataFrame([(1, "a \n b")], DOCS), whole=True).first()
    assert whole.kept_text == "a \n b"


def test_ngram_join(spark):
    rows = _corpus(2)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    want = util.jaccard(rows)
    assert got == want
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect())
    assert kept == sorted(i for i, (_, c) in want.items() if c == i)


def test_ngram_join_edges(spark):
    t = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, t, 1), (1, t, 1), (None, t, 2), (9, None, 3), (8, "", 3)], DOCS + ", node int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == [(0, 26, 1), (1, 26, 1), (1, 26, 1), (8, 0, 8), (9, 0, 9)]
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == [1, 8, 9]
    blank = spark.createDataFrame([(None, None, 1), (None, None, 2), (7, "", 3), (7, "", 3), (5, t, 4), (5, t, 5)], DOCS + ", k int")
    assert sorted(r.k for r in ngram_join.one_of_each(blank).collect()) in ([1, 2, 3, 3, 4], [1, 2, 3, 3, 5])
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_pigeonhole_signatures_miss_no_pair():
    """Any two sets at Jaccard 0.75 or more share a signature, at every size."""
    r = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 8, 11, 20, 33, 60, 150, 700]:
        for _ in range(30 if n < 100 else 5):
            a = r.integers(1, 2**63, n, dtype=np.uint64)
            drop = int(r.integers(0, n // 4 + 1))
            b = a[drop:]
            grow = (4 * len(b) // 3 - n) if drop == 0 else 0
            b = np.concatenate([b, r.integers(1, 2**63, max(0, grow), dtype=np.uint64)])
            both = len(a) - drop
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            sig, own = ngram_join.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]))
            assert set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())


def test_sketch_bounds_the_difference():
    r = np.random.default_rng(4)
    for n in (5, 50, 500):
        a = np.unique(r.integers(1, 2**63, n, dtype=np.uint64))
        b = np.concatenate([a[n // 10:], r.integers(1, 2**63, n, dtype=np.uint64)])
        s, t = (np.frombuffer(ngram_join.parity_sketch(x), np.uint8) for x in (a, b))
        size = min(len(s), len(t))
        assert np.bitwise_count(ngram_join._fold(s, size) ^ ngram_join._fold(t, size)).sum() <= n // 10 + n


def test_no_group_is_one_task_or_row(monkeypatch):
    """Of a signature that many sets share a slice reads one member a batch, and all its members become one tree."""
    monkeypatch.setattr(ngram_join, "FLUSH", 4000)
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = pa.array([" ".join([*base[:100], f"own{k}", *r.choices(base, k=9)]) for k in range(1500)])
    sent = pa.concat_tables([pa.Table.from_batches([b]) for b in ngram_join._send(4, 0)(pa.RecordBatch.from_arrays([texts[k:k + 100]], ["text"]) for k in range(0, 1500, 100))])
    edges, reps = [], 0
    for k in set(sent["slice"].to_pylist()):
        part = sent.filter(pa.compute.equal(sent["slice"], k))
        out = ngram_join._meet(4)(part)
        edges += list(zip(*(out[c].to_pylist() for c in ("gid", "a", "b"))))
        if k < 4:
            reps = max(reps, out.num_rows and max(np.unique(out["gid"].to_numpy(), return_counts=True)[1]))
    batches = sum(x >= 4 for x in sent["slice"].to_pylist())
    assert batches > 3 and 0 < reps < batches
    groups = {}
    for g, a, b in edges:
        groups.setdefault(g, []).append((a, b))
    full = max(groups.values(), key=len)
    assert len(full) > 1000 and len(full) + 1 == len({x for e in full for x in e}) and len(set(util.union(full, {x for e in full for x in e}).values())) == 1


def test_one_component_is_not_compared_again(spark, monkeypatch):
    """Groups of one component are not opened; members of the largest component meet only the few others."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    size, few = 600, 3
    met = spark.createDataFrame([(g, 0, k) for g in (1, 2) for k in range(1, size)] + [(1, 0, size + k) for k in range(few)] + [(3, 5, size)], "gid long, a long, b long")
    roots = spark.createDataFrame([(k, 0) for k in range(size)], "node long, root long")
    opened = ngram_join._open_groups(met, met.select("a", "b").distinct(), roots)
    assert {tuple(r) for r in opened.collect()} == {(1, k) for k in range(size + few)}
    info = spark.createDataFrame([(k, 10, bytearray(8)) for k in range(size + few)], "node long, n_shingles long, sketch binary")
    opened = ngram_join._still_open(opened, roots)
    pairs = {tuple(r) for r in ngram_join._cross_pairs(opened, info, True).collect()}
    assert pairs == {(a, b) for b in range(size, size + few) for a in range(b)}
    one = {tuple(r) for r in ngram_join._cross_pairs(opened, info, False).collect()}
    assert one <= pairs and len(one) <= 40 * 6 and {(0 if a < size else a, b) for a, b in one} == {(0 if a < size else a, b) for a, b in pairs}

    def rows(batches):
        for batch in batches:
            n = len(batch.column("members").flatten())
            yield pa.RecordBatch.from_arrays([pa.array([int(np.random.default_rng().integers(2**60))]), pa.array([n], pa.int64())], ["a", "b"])

    monkeypatch.setattr(ngram_join, "_across", lambda every: rows)
    total = sum(r.b for r in ngram_join._cross_pairs(opened, info, True).collect())
    assert total <= size + few * (size // 8 + 2)


def test_closest_pairs_first_lose_no_link(spark, monkeypatch):
    """Clusters of near copies whose trees leave many components end as by brute force."""
    r = random.Random(12)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(len(w))] = f"e{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    rounds = []
    merged = ngram_join._merged
    monkeypatch.setattr(ngram_join, "_merged", lambda *a: rounds.append(1) or merged(*a))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == util.jaccard(rows)


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)] + [(300, k) for k in range(301, 340)]
    df = spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")
    want = util.union(links, {x for p in links if p[0] != p[1] for x in p} | {x for p in links for x in p})
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and {k for p in links if p[0] != p[1] for k in p} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_dedup(spark):
    r = np.random.default_rng(6)
    base = r.standard_normal((40, 16))
    near = np.concatenate([base[k % 5] + 0.12 * r.standard_normal((1, 16)) for k in range(200)])
    rows = [(int(k), v.tolist()) for k, v in enumerate(np.concatenate([base, near, base[:3], base[:1] * 2]))]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 8), (904, [float("inf")] + [1.0] * 15), (905, [])]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vecs).collect()}
    x = np.array([np.float32(v) for k, v in rows if k < 900], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    pairs = [(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95)) if i < j]
    root = util.union(pairs, range(len(x)))
    found = sum(got[k][0] for k in range(len(x)))
    assert found <= 2 * len(pairs) and found >= 0.95 * 2 * len(pairs)
    assert sum(got[k][1] == root[k] for k in root) >= 0.95 * len(root)
    assert all(got[k] == (0, k, True) for k in range(900, 906))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cosine_of_very_small_and_large_vectors(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1.0, 100.0]), (2, [1e200, 2e200]), (3, [2e200, 4e200]), (4, [1e308, -1e308]), (5, [5e-324, -5e-324]), (6, [-0.0, 3.0])]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert got[0] == (0, 0) and got[2] == (1, 2) and got[3] == (1, 2) and got[4] == (1, 4) and got[5] == (1, 4) and got[1] == (1, 1) and got[6] == (1, 1)
    assert embedding_dedup.plan(2**40)[0] == 32


def test_large_bucket_is_compared_in_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(7)
    x = np.float32(r.standard_normal(8) + 0.05 * r.standard_normal((100, 8)))
    vecs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vecs).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = ((y @ y.T) >= 0.95).sum(1) - 1
    assert sum(got[k][0] for k in got) >= 0.97 * want.sum()
    assert all(got[k][0] <= want[k] for k in got)
