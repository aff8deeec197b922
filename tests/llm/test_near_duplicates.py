import random
from collections import defaultdict

import numpy as np

from tidemark.llm import near_duplicates as near
from tidemark.llm.components import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)] + [(500, 501 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().split()
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """(id, class_id, copy_id, n_links) by comparing all sets."""
    low = lambda k: -(1 << 63) if k is None else k
    reps = {}
    for k, t in rows:
        s = shingles(t)
        reps[s] = min(reps.get(s, low(k)), low(k))
    sets = list(reps)
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * 10**6 >= round(threshold * 10**6) * len(a | b):
                links[i].add(j)
                links[j].add(i)
    least = {}
    for i in range(len(sets)):
        seen, todo = {i}, [i]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        least[sets[i]] = min(reps[sets[x]] for x in seen)
    show = lambda k: None if k == -(1 << 63) else k
    return sorted(((k, show(least[shingles(t)]), show(reps[shingles(t)]), len(links[sets.index(shingles(t))])) for k, t in rows), key=str)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(rng, groups, size, length):
    rows = []
    for _ in range(groups):
        base = [f"v{rng.randrange(5000)}" for _ in range(length)]
        rows += [" ".join(changed(rng, base, rng.randrange(3))) for _ in range(size)]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    texts = corpus(rng, 25, 6, 120) + corpus(rng, 1, 60, 90) + [None, "", " \n", "one two", "one  two", "One two", "a b c d e", "w " * 20_000]
    texts += texts[3:9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[4]), (7, "other text under a known id"), (None, "alone without id")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, rep int")
    want = brute(rows)
    for small, block in ((32, 512), (3, 16)):
        monkeypatch.setattr(near, "SMALL", small)
        monkeypatch.setattr(near, "BLOCK", block)
        got = sorted(((r["doc_id"], r["class_id"], r["copy_id"], r["n_links"]) for r in near.near_duplicates(docs).collect()), key=str)
        assert got == want
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_pruning_keeps_true_pairs():
    rng = np.random.default_rng(3)
    kept = lost = 0
    for _ in range(300):
        common, own = 400, 50  # similarity exactly 0.8
        base = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64)
        a, b = np.unique(near.mixed(base[: common + own])), np.unique(near.mixed(np.concatenate((base[:common], base[common + own :]))))
        x, y = near.min_hashes(a), near.min_hashes(b)
        kept += len(near.survivors(x[None, : near.COMPARED].astype(np.uint16), y[None, : near.COMPARED].astype(np.uint16), 0.8))
        kept_band = bool((near.band_keys(x) == near.band_keys(y)).any())
        lost += not kept_band
    assert kept == 300 and lost == 0
    far = rng.integers(0, 1 << 16, (2, 100, near.COMPARED), dtype=np.uint16)
    assert len(near.survivors(far[0], far[1], 0.8)) == 0
