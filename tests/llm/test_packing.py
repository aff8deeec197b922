"""Packed pieces against the whole library's ids: every id once, sequences full, steps balanced."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if text else []


def test_words_encode_like_the_library():
    rng, words = random.Random(1), packing.Words(PATH)
    letters = "aBcé ÀÿßÇ ,.'!\n\t  '\"s t ll 09ªºµ×÷İΣσς中文́  \x1c\x85<|>endoftext’-_"
    texts = ["", " ", "\n", 'İ"', "x<|endoftext|>, y", "<|startoftext|>", "can't STOP'S 'll", "a" * 3000, ("word, " * 9 + "\n") * 40_000]
    texts += ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(2000)]
    tokenizer = Tokenizer.from_file(PATH)
    for text in texts:
        assert np.frombuffer(words.encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:200]


def held(pieces, want):
    """Checks what holds for any packing; ``want``: (doc, ids) of every document row."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append(r)
        docs[r["doc"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for rows in sequences.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows])[:-1]]
        assert len({(r["tier"], r["step"]) for r in rows}) == 1 and sum(r["length"] for r in rows) <= rows[0]["tier"]
    expected = defaultdict(list)
    for doc, ids in want:
        expected[doc].append(ids)
    assert set(docs) == set(expected)
    for doc, rows in docs.items():
        # rows of repeated ids can only be told apart by what they hold
        got = sorted((r["start"], r["length"], bytes(r["ids"])) for r in rows)
        if len(expected[doc]) == 1:
            assert [s for s, _, _ in got] == [0, *np.cumsum([n for _, n, _ in got])[:-1]] and b"".join(x for _, _, x in got) == np.array(expected[doc][0], dtype="<u4").tobytes()
        assert sum(n for _, n, _ in got) == sum(map(len, expected[doc]))
    return [sum(r["length"] for r in rows) for rows in sequences.values()]


def test_every_id_in_one_piece(spark):
    rng = random.Random(3)
    vocabulary = ["river", "Stone,", "house", "über", "a1", "the", "end."]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 60, 300, 1500])))) for i in range(300)] + [(None, None), (900, ""), (901, "x"), (901, "x y"), (902, "long " * 30_000), (902, "long " * 30_000)]
    docs = spark.createDataFrame([(k, t, "c", 1, 2) for k, t in rows], "doc_id long, text string, doc string, tier int, part int").repartition(3)
    full = held(packing.pack(docs, PATH).collect(), [(k, [*library(t), 1]) for k, t in rows])
    short = [n for n in full if n not in packing.TIERS]
    assert len(short) <= 1 and len(set(full) - set(short)) >= 2


def test_steps_have_the_same_share_of_every_tier(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40 * 50 + 20)) for i in range(400)], "doc_id long, text string").repartition(4)
    by = defaultdict(lambda: defaultdict(set))
    for r in packing.pack(docs, PATH, step_ids=1 << 15).collect():
        by[r["tier"]][r["step"]].add(r["sequence_id"])
    assert len(by) > 1
    for steps in by.values():
        sizes = [len(steps[k]) for k in range(max(map(max, by.values())) + 1)]
        assert max(sizes) - min(sizes) <= 1


def test_pool_cuts_what_does_not_fit():
    pool = packing.Pool((4, 8))
    for doc, n in ((1, 5), (2, 3), (3, 4), (4, 7), (5, 2)):
        pool.add((doc, 0, bytes(4 * n), n))
    made = list(pool.packed())
    assert [sum(len(x[2]) // 4 for x in items) for _, items in made] == [t for t, _ in made] == [8, 8, 4]
    assert sum(len(x[2]) // 4 for x in pool.rest()) == 1


def test_no_rows(spark):
    none = packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert none.count() == 0 and none.columns == packing.COLUMNS


def test_query_digests(spark, tmp_path):
    rows = [(1, "One two three."), (2, None), (3, "word " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in packing.op11_packing(spark, str(tmp_path)).collect():
        ids = [*library(rows[r["doc_id"] - 1][1]), 1]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
