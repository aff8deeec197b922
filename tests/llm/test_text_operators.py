import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, quality
from tidemark.llm.fm_index import FMIndex, suffix_array

DOCS = "doc_id long, text string, kind int, row_id string, line int, spans int"


def docs_of(spark, texts, first=0):
    rows = [(first + i if not isinstance(t, tuple) else t[0], t[1] if isinstance(t, tuple) else t, 1, "x", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def naive_suffixes(s):
    seps = [i for i, x in enumerate(s) if x == 0]
    key = [(0, seps.index(i)) if x == 0 else (1, x) for i, x in enumerate(s)]
    return sorted(range(len(s)), key=lambda i: key[i:])


def test_suffix_array_and_search():
    rng = np.random.default_rng(5)
    for n, sigma in ((1, 1), (7, 2), (200, 3), (500, 40)):
        s = np.append(rng.integers(0, sigma + 1, n), 0)
        s[: n // 3] = s[n // 3 : 2 * (n // 3)]
        assert suffix_array(s).tolist() == naive_suffixes(s.tolist())
        index = FMIndex(s, sample=4)
        text = s.tolist()
        for _ in range(60):
            k = int(rng.integers(1, 6))
            p = rng.integers(1, sigma + 2, k)
            table = np.zeros((1, 6), dtype=np.int64)
            table[0, -k:] = p
            low, high = index.search(table, np.array([k]))
            want = [i for i in range(len(text)) if text[i : i + k] == p.tolist()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "x1"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [("12", None), ("13", ""), ("3", "w1 w2")]
    texts = [None, "", "   \n"]
    for _ in range(60):
        parts = [" ".join(rng.choices([*vocabulary, "zz"], k=rng.randrange(30)))]
        if rng.random() < 0.6:
            words = rng.choice(items)[1] or ""
            parts += [words.upper().replace(" ", rng.choice([" ", ", ", "\n"])), "tail"]
        texts.append("-".join(parts))
    texts += texts[5:8] + [" ".join(rng.choices(vocabulary, k=20_000))]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, doc_id int")
    want = decontaminate.brute_force(texts, items)
    for settings in ({}, {"shard_words": 50}, {"phrase_bytes": 400}):
        got = {}
        for r in decontaminate.removal_spans(docs, bench, **settings).collect():
            hit = sum(s["end"] - s["start"] for s in r["spans"])
            got[r["doc_id"]] = (r["n_words"], hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), hit > 0)
        assert [got[i] for i in range(len(texts))] == want
    assert decontaminate.removal_spans(docs.limit(0), bench).count() == 0
    assert not any(r["spans"] for r in decontaminate.removal_spans(docs, bench.limit(0)).collect())


def test_cut(spark):
    docs = docs_of(spark, ["keep É, one TWO three! rest", None, "nothing"])
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r["doc_id"]: r["clean"] for r in decontaminate.without_spans(decontaminate.removal_spans(docs, bench)).collect()}
    assert got == {0: "keep É, ! rest", 1: None, 2: "nothing"}


def naive_quality(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a\xa0b c d", "x\x1fy z", "a\n\na\n a\na", "# <b> $ & | % *"]
    texts += ["".join(rng.choices(["a ", "b ", "c\n", "É ", "a b c d e ", "\n", "#"], k=rng.randrange(80))) for _ in range(80)]
    got = {r["doc_id"]: r for r in quality.scored(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == naive_quality(t), t
        assert not (r["base_failed"] and r["kept"])
    assert quality.scored(docs_of(spark, texts).limit(0)).count() == 0


def test_estimation_finds_the_accuracies():
    rng = np.random.default_rng(0)
    n, acc = 20_000, [0.95, 0.9, 0.7, 0.85]
    good = rng.random(n) < 0.75
    patterns = defaultdict(int)
    for y in good:
        patterns["".join("0" if rng.random() < 0.2 else "-+"[int(y == (rng.random() < a))] for a in acc)] += 1
    post = quality.fit(dict(patterns))
    assert post["++++"] > 0.98 and post["----"] < 0.02
    assert abs(sum(post[k] * v for k, v in patterns.items()) / n - 0.75) < 0.02
    assert quality.fit({}) == {}


def naive_lines(rows, min_chars=40, min_docs=5):
    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(-(1 << 63) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != (-(1 << 63) if d is None else d))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [c * 40 for c in "abcdefgh"] + ["É" * 40, "x" * 39, "  " + "Q" * 41 + "\t", "q" * 41, "", " "]
    rows = [(i, "\n".join(rng.choices([*pool, f"own line {i} " + "z" * 40], k=rng.randrange(12)))) for i in range(150)]
    rows += [(200, None), (201, ""), rows[7], (8, "a" * 40 + "\nother\n" + "b" * 40), (None, "a" * 40), (None, "c" * 40 + "\n" + "h" * 40), (202, "\n".join(["hot " * 12] * 300))]
    rows += [(1000 + i, "hot " * 12) for i in range(3000)]
    docs = docs_of(spark, rows)
    for n in ("1", "4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = line_dedup.deduplicated(docs).collect()
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"] or "") for r in got), key=str) == naive_lines(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_line_keys_are_cut_outside_the_jvm_and_staged_in_few_files(spark, monkeypatch):
    texts = {1: "Ab" * 20 + "\n" + " \x0b" + "É" * 40 + "\t\r\n" + "É" * 39 + "\n" + "\u00a0" + "\U0001f30a" * 39, 2: "ab" * 20 + "\x00\n\n" + "K" * 40, 3: None, 4: "\n".join(f"{i:040}" for i in range(8200))}
    docs = docs_of(spark, texts.items())
    want = []
    for d, t in texts.items():
        for pos, x in enumerate((t or "").split("\n")):
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
            want += [(hashlib.md5(key.encode()).digest(), d, pos)] * (len(key) >= 40)
    keys = line_dedup.line_keys(docs, "doc_id", "text", 40)
    got = keys.withColumn("same", F.col("body").isNotNull()).collect()
    assert sorted((bytes(r["line"]), r["doc"], r["pos"]) for r in got) == sorted(want) and all(r["same"] for r in got)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # a string for each line makes the JVM's heap grow to its limit
    files, staged = {}, line_dedup.common.staged

    def counted(df, label, **how):
        out, path = staged(df, label, **how)
        files[label] = len(out.inputFiles())
        return out, path

    monkeypatch.setattr(line_dedup.common, "staged", counted)
    monkeypatch.setattr(line_dedup.common, "partitions", lambda s: 12)
    line_dedup.deduplicated(docs).count()
    assert 0 < files["line-stream"] <= 4, files


def test_bitmaps():
    for n in (1, 8, 70):
        gone = {0, n - 1}
        assert set(np.flatnonzero(~line_dedup.from_bitmap(line_dedup.to_bitmap(gone), n + 3)).tolist()) == gone
