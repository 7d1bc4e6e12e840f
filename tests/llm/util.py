"""Brute-force versions that the operators are held against."""

from __future__ import annotations

from collections import defaultdict

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().split()


def cut(rows, width=20):
    """{id: (n_words, n_removed, kept text)} for rows (id, text) in the order of ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        keep = [True] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s:s + width])
            if key in seen:
                keep[s:s + width] = [False] * width
            seen.add(key)
        out[i] = (len(w), len(w) - sum(keep), b" ".join(x for x, k in zip(w, keep) if k).decode())
    return out


def shingles(text, n=5):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def union(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(rows):
    """{id: (n_shingles, component)} by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    index, both = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for g in s:
            for j in index[g]:
                both[j, i] += 1
            index[g].append(i)
    links = [(a, b) for (a, b), c in both.items() if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    root = union(links, sets)
    return {i: (len(s), root[i]) for i, s in sets.items()}
