import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import segmentations as seg

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return seg.Pieces(MODEL, 1.0)


def every(pieces, text):
    """All segmentations with their probabilities, by recursion over the characters of the whole text."""
    units = []
    for c in seg.SPACE + text.replace(" ", seg.SPACE) if text else "":
        units += [c] if c in pieces.ids else list(c.encode())

    def rest(i):
        if i == len(units):
            return [((), 1.0)]
        if isinstance(units[i], int):
            return [((pieces.byte_ids[units[i]], *t), w) for t, w in rest(i + 1)]
        out, piece = [], ""
        for j in range(i, len(units)):
            if isinstance(units[j], int):
                break
            piece += units[j]
            k = pieces.ids.get(piece)
            if k is not None:
                out += [((k, *t), pieces.weights[k] * w) for t, w in rest(j + 1)]
        return out

    found = rest(0)
    total = sum(w for _, w in found)
    return {t: w / total for t, w in found}


@pytest.mark.parametrize("text", ["", "a", "the", "the cat", "漢é", " in  it\n", "▁x\x00"])
def test_probabilities_and_distinctness(pieces, text):
    truth = every(pieces, text)
    for key in range(40):
        got = seg.sample(pieces, [text], [key], 6, 1)[0]
        ids = [tuple(i.tolist()) for i, *_ in got]
        assert len(set(ids)) == len(ids) == min(6, len(truth))
        values = [v for *_, v, _ in got]
        assert values == sorted(values, reverse=True)
        for t, (_, log_prob, _, q) in zip(ids, got):
            assert math.isclose(log_prob, math.log(truth[t]), rel_tol=1e-9, abs_tol=1e-9) and 0 < q <= 1
            assert pieces.decode(t) == text.replace(seg.SPACE, " ")
        if len(truth) <= 6:
            assert all(q == 1 for *_, q in got)


def test_sampling_follows_the_distribution(pieces):
    """First samples follow the probabilities, ordered pairs those of drawing without replacement, and the sum of
    indicator over inclusion probability is unbiased."""
    text, n = "the", 40_000
    truth = every(pieces, text)
    first, pair, estimate = Counter(), Counter(), 0.0
    some = {t for t in truth if len(t) % 2}
    got = [x for i in range(0, n, 2000) for x in seg.sample(pieces, [text] * 2000, list(range(i, i + 2000)), 2, 9)]
    for a, b in got:
        x, y = tuple(a[0].tolist()), tuple(b[0].tolist())
        first[x] += 1
        pair[x, y] += 1
        estimate += sum(math.exp(p) / q for i, p, _, q in (a, b) if tuple(i.tolist()) in some)
    for t, p in truth.items():
        assert abs(first[t] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    for (x, y), c in pair.most_common(8):
        p = truth[x] * truth[y] / (1 - truth[x])
        assert abs(c / n - p) < 5 * math.sqrt(p / n) + 1e-4
    assert abs(estimate / n - sum(truth[t] for t in some)) < 0.02


def test_lattices_together_equal_one_by_one(pieces):
    words = ["▁the", "cat", "▁▁▁", "\n", "x漢\ty", "▁Straße" * 30, "é", "▁international"]
    pieces = seg.Pieces(MODEL, 1.0)
    assert [pieces.index[w] for w in words] == list(range(8))
    pieces.add()
    check_lattices(pieces, words)
    for w, n in zip(words, [3, 0, 2, 9, 1, 2, 1, 4]):
        pieces.uses[pieces.index[w]] = n
    pieces.forget()  # words used but once go
    assert {w: int(pieces.uses[k]) for w, k in pieces.index.items()} == {words[i]: n for i, n in ((0, 1), (2, 1), (3, 4), (5, 1), (7, 2))}
    check_lattices(pieces, list(pieces.index))
    assert [pieces.index[w] for w in ("cat", "é", "cat")] == [5, 6, 5]
    pieces.add()
    check_lattices(pieces, list(pieces.index))


def check_lattices(pieces, words):
    for w in words:
        edges, counts = (np.frombuffer(x, t) for x, t in zip(pieces.lattice(w), (seg.EDGE, "<u4")))
        a, b = pieces.begin[pieces.index[w]], pieces.end[pieces.index[w]]
        first = pieces.first_edge[a : b + 1]
        own = slice(first[0], first[-1])
        assert np.diff(first).tolist() == counts[:-1].tolist() and (pieces.step[own] + np.repeat(np.arange(b - a), np.diff(first)) == edges["to"]).all() and (pieces.id[own] == edges["id"]).all()
        assert np.allclose(pieces.cum[own], edges["cum"], rtol=1e-9) and np.allclose(pieces.p[own], edges["p"], rtol=1e-9)


def test_words_are_the_librarys(pieces):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("  a  b\n\nThe tion é漢 x\t", "Hello, world! 123"):
        assert pieces.decode(sp.encode(text)) == text == sp.decode(sp.encode(text))


def test_rows(spark):
    long = "Ab cd, " * 5000 + "x" * 3000
    rows = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, long), (1, "the cat sat on the mat"), (None, "no id \U0001f600"), (7, "a▁b")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, samples int, row_id string")
    one = {str((r["doc_id"], [(bytes(s["ids"]), s["log_prob"]) for s in r["samples"]])) for r in seg.encode_samples(docs.repartition(3), MODEL, k=3).collect()}
    got = seg.encode_samples(docs.coalesce(1), MODEL, k=3).collect()
    assert one == {str((r["doc_id"], [(bytes(s["ids"]), s["log_prob"]) for s in r["samples"]])) for r in got} and len(one) == 6
    assert all(r["round_trip"] for r in got) and len(got) == 7
    assert {r["doc_id"]: len(r["samples"]) for r in got} == {1: 3, 2: 1, 3: 1, 4: 3, None: 3, 7: 3}
    assert seg.encode_samples(docs.limit(0), MODEL).count() == 0
    assert np.frombuffer(got[0]["samples"][0]["ids"], "<u4").max() < 32_000
