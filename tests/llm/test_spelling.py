"""Words one letter apart against the definition, word by word."""

import random
import re
import zlib
from collections import Counter

import duckdb

from tidemark.llm import spelling


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, lose_every=97, min_chars=5, min_count=3):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if lose_every and h % lose_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    near = {w: [o for o in words if o != w and distance_one(w, o)] for w in words}
    form = {w: (min(near[w], key=lambda o: (-words[o], o)) if near[w] else None) for w in words}
    form = {w: o if o and words[o] >= 2 * words[w] else None for w, o in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def texts():
    rng = random.Random(4)
    stems = ["river", "cloud", "stone", "garden", "übermut", "forêt", "ababababab", "house"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: 1 + min(rng.randrange(9), 7)])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("abÿÀ") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("eà") + w[k + 1 :]])
            words.append(rng.choice([w, w.upper(), w.capitalize()]))
        rows.append((i % 100, rng.choice([" ", "-", "1", "\n", "Ā"]).join(words)))
    return rows + [(None, "river rivers " * 4), (7, None), (8, ""), (9, "w" * 4000), (9, "w" * 4000), (10, "w" * 4000), (11, "w" * 3999 + "x"), (11, "w" * 3999 + "x"), (12, "w" * 3999 + "x")]


def test_variants_by_definition_and_by_sql(spark, tmp_path):
    rows = texts()
    docs = spark.createDataFrame([(k, t, 1, "x", "y") for k, t in rows], "doc_id long, text string, n int, word string, letter string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert sum(f is not None for _, f, *_ in want) > 50 and any(f and f != r for _, f, r, *_ in want)
    df = spelling.op13_spelling_variants(spark, str(tmp_path))
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.sql(spelling.OP13_SQL)
    assert found.columns == df.columns and set(found.fetchall()) == want


def test_crowds_of_anagrams_meet_by_order(spark):
    rng = random.Random(6)
    made = {"".join(rng.sample("aaaabbbbcc", 10)) for _ in range(400)} | {"".join(rng.sample("aaaabbbbc", 9)) for _ in range(300)} | {"".join(rng.sample("aaaabbbbcd", 10)) for _ in range(300)}
    words = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(made))], "word string, n long")
    want = {(a, b) for a in made for b in made if a != b and distance_one(a, b)}
    for crowd in (1, 64, 1 << 30):
        got = [(r["word"], r["other"]) for r in spelling.near_words(words, crowd=crowd).collect()]
        assert set(got) == want and len(got) == len(want)


def test_chains_of_forms(spark):
    words = spark.createDataFrame([("a" * (5 + k), 3 * 2**k) for k in range(21)] + [("zzzzz", 3)], "word string, n long")
    found = spelling.with_roots(spelling.forms(words, spelling.near_words(words))).collect()
    assert {r["word"]: r["root"] for r in found} == {"a" * (5 + k): "a" * 25 for k in range(21)} | {"zzzzz": "zzzzz"}
    assert {r["n_near"] for r in found if r["word"] == "zzzzz"} == {0}


def test_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
