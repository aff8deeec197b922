"""Columns with clashing names, null ids, repeated rows and empty tables, for what keeps all columns of its input."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
from tests.llm.test_near_duplicates import brute
from tests.llm.test_text_operators import naive_lines, naive_quality

from tidemark.llm import decontaminate, line_dedup, near_duplicates, quality

#: Names that the operators use themselves, now or once.
CLASHES = ["__own", "__taken", "__id", "own_body", "Own_Body_", "stay_id", "map_id", "bitmap", "votes", "n", "repeats", "quality", "whole", "c0", "key", "rep", "row_id", "body", "a.b", "with space", "fitted_votes"]


def corpus(spark, rows):
    schema = ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in CLASHES)])
    return spark.createDataFrame([(k, t, *[f"{c}{n}" for c in CLASHES]) for n, (k, t) in enumerate(rows)], schema)


def texts():
    rng = random.Random(5)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    shared = " ".join(rng.choices(vocabulary, k=14)) + "."
    rows = []
    for i in range(40):
        lines = [" ".join(rng.choices(vocabulary, k=20)) + "." for _ in range(4)]
        rows.append((i if i % 9 else None, "\n".join([*lines, *([shared] if i % 4 == 0 else [])])))
    return rows + [(3, rows[3][1]), (500, rows[4][1]), (501, None), (502, ""), (3, "spam " * 60), (None, None), (503, "### $$$ " * 30)]


def kept(df, docs):
    """Rows of all columns but the text, and (id, text); the columns must be those of ``docs``."""
    assert df.dtypes == docs.dtypes
    out = df.collect()
    for r in out:
        n = r["__own"].removeprefix("__own")
        assert all(r[k] == f"{c}{n}" for k, c in enumerate(CLASHES, 2))
    return Counter((r["doc_id"], r["text"]) for r in out)


def test_all_columns_come_back(spark):
    rows = texts()
    docs = corpus(spark, rows)
    post = quality.fit(dict(Counter(quality.measure(t)[5] for _, t in rows)))
    assert kept(quality.passing(docs), docs) == Counter((k, t) for k, t in rows if not naive_quality(t)[5] and post[quality.measure(t)[5]] >= 0.5)
    low = lambda k: -(1 << 63) if k is None else k
    want = Counter((None if k == low(None) else k, t) for k, _, _, t in naive_lines([(low(k), t) for k, t in rows]))
    got = kept(line_dedup.without_lines(docs, min_docs=5), docs)
    assert Counter((k, t or "") for k, t in got.elements()) == Counter((k, t or "") for k, t in want.elements()) and got[(501, None)] == got[(None, None)] == 1
    by = {}
    for k, c, _, _ in brute(rows):
        by.setdefault(k, set()).add(c)
    one = kept(near_duplicates.one_of_each(docs), docs)
    assert max(one.values()) == 1 and {k for k, _ in one} == {k for k in by if k in by[k]}
    found = decontaminate.removal_spans(docs, spark.createDataFrame([(1, " ".join(rows[1][1].split()[:12]))], "item_id long, text string"), carry=CLASHES)
    assert found.select("rest.*").columns == CLASHES and sum(bool(r["spans"]) for r in found.collect()) == 1


def test_empty_tables(spark):
    docs = corpus(spark, []).limit(0)
    for f in (quality.passing, line_dedup.without_lines, near_duplicates.one_of_each):
        df = f(docs)
        assert df.dtypes == docs.dtypes and df.count() == 0


def test_pipeline_with_null_ids_and_without_counts(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[1][1].split()[:12])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["round_trip"] for r in out) and None in {r["doc_id"] for r in out} and 30 <= len(out) < len(rows)


def plain_em(patterns, rounds=200):
    """Expectation-maximisation by the definition: document after document, probabilities as products."""
    docs = [k for k, n in sorted(patterns.items()) for _ in range(n)]
    width = len(docs[0])
    share, good, bad = 0.8, [0.95] * width, [0.3] * width
    for _ in range(rounds):
        weights = []
        for votes in docs:
            x, y = share, 1 - share
            for v, g, b in zip(votes, good, bad):
                x *= {"+": g, "-": 1 - g, "0": 1}[v]
                y *= {"+": 1 - b, "-": b, "0": 1}[v]
            weights.append(x / (x + y))
        share = (sum(weights) + 1) / (len(docs) + 2)
        for k in range(width):
            cast = [(w, votes[k]) for w, votes in zip(weights, docs) if votes[k] != "0"]
            good[k] = (sum(w for w, v in cast if v == "+") + 2) / (sum(w for w, _ in cast) + 3)
            bad[k] = (sum(1 - w for w, v in cast if v == "-") + 2) / (sum(1 - w for w, _ in cast) + 3)
    return dict(zip(docs, weights))


def test_kept_by_an_independent_estimate(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "house", "river", "stone", "cloud", "grass", "of", "the"]
    rows = []
    for i in range(150):
        words = rng.choices([f"{a}{b}" for a in vocabulary for b in vocabulary], k=rng.choice([4, 20, 60, 90]))
        kind = rng.randrange(5)
        if kind == 3:
            words = [w + rng.choice(["###", "$$", "%"]) for w in words]
        if kind == 4:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words) + ("." if rng.random() < 0.7 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["quality"]) for r in quality.scored(docs).collect()}
    votes = {k: quality.measure(t)[5] for k, t in rows}
    post = plain_em(Counter(votes.values()))
    for k, t in rows:
        assert np.isclose(got[k][1], post[votes[k]], atol=1e-6) and got[k][0] == (not naive_quality(t)[5] and post[votes[k]] >= 0.5)
    assert 20 < sum(x for x, _ in got.values()) < 130
