import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tests.llm.test_near_duplicates import brute
from tests.llm.test_text_operators import naive_lines, naive_quality

from tidemark.llm import decontaminate, quality, segmentations


def small_corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    bench = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(6)]
    rows, shared = [], " ".join(rng.choices(vocabulary, k=25))
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([5, 60, 120]))
        lines = [" ".join(words[k : k + 20]) + "." for k in range(0, len(words), 20)]
        if i % 4 == 0:
            lines.insert(1, shared)
        if i % 7 == 0:
            lines.insert(0, "Intro " + rng.choice(bench)[1].upper())
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i * 3][1] + " more") for i in range(8)] + [(200, None), (201, ""), (202, "spam " * 100), (203, "###$$$ &&& " * 20)]
    rows += [rows[1], (300, rows[2][1])]
    return rows, bench


def test_equals_brute_force(spark, tmp_path):
    rows, bench = small_corpus()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    post = quality.fit(dict(Counter(quality.measure(t)[5] for _, t in rows)))
    now = [(k, t) for k, t in rows if not naive_quality(t)[5] and post[quality.measure(t)[5]] >= 0.5]
    assert 40 < len(now) < len(rows)
    now = [(k, t) for k, _, _, t in naive_lines(now)]
    stays = {k for k, c, _, _ in brute(now) if k == c}
    now = sorted({(k, t) for k, t in now if k in stays})
    want = {}
    for k, t in now:
        words, hit = decontaminate.words(t), set()
        for _, b in bench:
            b = decontaminate.words(b)
            for i in range(len(words) - 9):
                if any(words[i : i + 10] == b[j : j + 10] for j in range(len(b) - 9)):
                    hit.update(range(i, i + 10))
        spans, i = [], 0
        while i < len(words):
            j = i
            while j in hit:
                j += 1
            if j > i:
                spans.append({"start": i, "end": j})
            i = max(j, i + 1)
        want[k] = decontaminate.cut(t, spans) if spans else t
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        columns = columns or docs.dtypes
        assert docs.dtypes == columns
    got = docs.collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    pieces = segmentations.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == set(want) and all(r["round_trip"] for r in rows.values())
    for k, t in list(want.items())[:5]:
        own = segmentations.sample(pieces, [t], [k], 2, 7)[0]
        assert rows[k]["n_pieces"] == [len(i) for i, *_ in own] and np.allclose(rows[k]["log_prob"], [p for _, p, *_ in own])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
