import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import common, dac, html_text, sharding, token_files, warc

DOCS = "doc_id long, text string, file string, place int"


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for ids in ([], [0], [255, 256], rng.integers(0, 50_257, 1000), rng.integers(0, 2**32, 777), np.repeat(7, 130)):
        ids = np.array(ids, dtype=np.uint32)
        for bits in (8, 16):
            reader = dac.Reader(dac.encode(ids, bits))
            assert len(reader) == len(ids)
            at = rng.integers(0, max(1, len(ids)), 50) if len(ids) else np.zeros(0, dtype=np.int64)
            assert reader.take(at).tolist() == ids[at].tolist()
            for _ in range(40):
                a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
                assert reader.read(a, b).tolist() == ids[a:b].tolist()


TEXTS = [None, "", " ", "a  b", "\n a\t b ", "it's 42 o'clock\n\n\nthen  \xa0x \x1c y", "<|endoftext|> a<|endoftext|>", "日本語 テキスト", "é   wide", "x" * 3000, "the " * 500, "don't  stop\r\n now"]


def test_encoder_equals_library():
    rng = random.Random(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(["a", " ", "  ", "\n", "'s", "9", "!", "é", "\xa0", " ", "\x1f", "the", " of"], k=rng.randrange(40))) for _ in range(400)]
    texts += ["the, cat. sat,", "a,b.\nc d.", "ab.\n\ncd", "x\n y", "\nx y", "y z\n", "Straße, ½. ²,", " lead", " , .", "a.\n b", "HEAT!! it%%% *** x's, y', _a_ b_ c-- (d) é... ½% a1. '' 'tis!? don't!\nyes'.\n\n!!"]
    encoder = token_files.Encoder(path)
    for text in texts:
        got = encoder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i * 3 % 50, t, "f", 1) for i, t in enumerate(TEXTS * 3)] + [(7, "again", "f", 1), (7, "again", "f", 1), (None, "no id", "f", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for file_tokens in (500, 1 << 20):
        folder = common.fresh_path(spark, "test-tokens")
        files = token_files.write_tokens(docs, folder, path, file_tokens=file_tokens)
        got = sorted((tuple(r) for r in token_files.read_files(files, folder).collect()), key=lambda r: r[1])
        index = token_files.documents(files, folder)
        some = token_files.read_tokens(index.where("start % 3 = 0"), folder).collect()
        assert sorted(map(tuple, some), key=lambda r: r[1]) == [r for r in got if r[1] % 3 == 0]
        assert sum(r["n_docs"] for r in files.collect()) == len(got) == index.count()
        want = sorted(((k, t) for k, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        start = 0
        for (key, at, n, ids), (k, t) in zip(got, want, strict=True):
            expected = plain.encode(t or "", add_special_tokens=False).ids + [0]
            assert (key, at, n) == (k, start, len(expected)) and np.frombuffer(ids, "<u4").tolist() == expected
            start += n
    empty = token_files.write_tokens(docs.limit(0), common.fresh_path(spark, "test-tokens"), path)
    assert empty.count() == 0 and token_files.read_files(empty, common.fresh_path(spark, "test-tokens")).count() == 0


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}é</p>") for i in range(60)] + [(100, None, None), (90, "u r\nl", ""), (5, "http://h/5", "<p>5é</p>"), (None, "n", "<p>0é</p>"), (None, "n", "only"), (300, "z", "big" * 100_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, first int")
    folder = common.fresh_path(spark, "test-warc")
    index = warc.write_archive(pages, folder, file_bytes=2000)
    got = warc.read_records(index, folder, gap=100, most=3000).collect()
    groups = defaultdict(list)
    for k, _, h in rows:
        groups[h or ""].append(k)
    want = Counter()
    for k, u, h in rows:
        ids = [x for x in groups[h or ""] if x is not None]
        first = min(ids) if ids else None
        again = first is not None and k != first
        raw = (h or "").encode()
        want[(k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    some = warc.read_records(index.where("page_id between 3 and 5"), folder).collect()
    assert sorted(r["page_id"] for r in some) == [3, 4, 5, 5] and {r["payload"].decode() for r in some} == {"<p>3é</p>", "<p>4é</p>", "<p>5é</p>"}
    assert warc.write_archive(pages.limit(0), common.fresh_path(spark, "test-warc")).count() == 0
    short = warc.write_archive(pages, common.fresh_path(spark, "test-warc"), revisit_bytes=11)
    assert {r["page_id"] for r in short.where("record_type = 'revisit'").collect()} == set()


def test_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (40, 5), (46, 100)], gap=20, most=50) == [(0, 2, 15), (2, 3, 45), (3, 4, 146)]
    with pytest.raises(ValueError):
        warc.parse(zlib.decompress(warc.record(1, "u", b"abc", warc.payload_digest(b"abd"), None, False, "d"), 31))


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        at = sharding.hilbert_index(cells, bits)
        walk = cells[np.argsort(at)]
        assert sorted(at.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    rng = random.Random(0)
    rows = [(i % 190 if i % 11 else None, rng.choice(["t", "", None, "u" * 500]), rng.choice(["de", "en", None, "x"]), f"src{rng.randrange(30)}", rng.randrange(1000)) for i in range(200)]
    rows += [(9, "same", "en", "src0", 1)] * 120
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for shards in (1, 7, 24):
        out = sharding.write_shards(docs, common.fresh_path(spark, "test-shards"), ["lang", "source", "n_chars", "doc_id"], shards=shards)
        got = out.collect()
        assert Counter(tuple(r[c] for c in docs.columns) for r in got) == Counter(rows)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert set(slots) == set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    few = sharding.write_shards(docs.limit(3), common.fresh_path(spark, "test-shards"), ["lang", "doc_id"])
    assert few.count() == 3 and all(r["slot"] == 0 for r in few.collect())
    assert sharding.write_shards(docs.limit(0), common.fresh_path(spark, "test-shards"), ["lang", "doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumnRenamed("lang", "slot"), common.fresh_path(spark, "test-shards"), ["slot"])


def test_shards_equal_a_naive_sort(spark):
    """Cells, curve, order and cuts in plain Python: the shard and slot of every row."""
    rng = random.Random(2)
    rows = [(k, rng.choice(["de", "en", "fr", None]), f"src{rng.randrange(9)}", None if k % 17 == 0 else rng.randrange(300)) for k in rng.sample(range(1000), 150)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long")
    out = sharding.write_shards(docs, common.fresh_path(spark, "test-shards"), ["lang", "source", "n_chars", "doc_id"], shards=7)
    columns = []
    for c in (1, 2, 3, 0):
        known = sorted(r[c] for r in rows if r[c] is not None)
        cuts = sorted({known[max(0, -(-len(known) * q // 16) - 1)] for q in range(1, 16)})
        columns.append([0 if r[c] is None else sum(r[c] > x for x in cuts) for r in rows])
    curve = sharding.hilbert_index(np.array(columns).T, 4)
    ranked = [r[0] for _, r in sorted(zip(curve.tolist(), rows), key=lambda x: (x[0], x[1][0]))]
    shard = [rank * 7 // len(rows) for rank in range(len(rows))]
    want = {k: (s, rank - shard.index(s)) for rank, (k, s) in enumerate(zip(ranked, shard))}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out.collect()} == want


def test_shards_prune_every_dimension(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('s', id % 16) as source", "cast(hash(id) % 1000 as long) as n_chars")
    out = sharding.write_shards(docs, common.fresh_path(spark, "test-shards"), ["source", "n_chars", "doc_id"], shards=64)
    spans = out.groupBy("shard").agg({"n_chars": "max", "doc_id": "max"}).join(out.groupBy("shard").agg({"n_chars": "min", "doc_id": "min"}), "shard").collect()
    assert np.mean([r["max(n_chars)"] - r["min(n_chars)"] for r in spans]) < 0.65 * 1998
    assert np.mean([r["max(doc_id)"] - r["min(doc_id)"] for r in spans]) < 0.65 * 20_000


def test_page_lines():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li>a</li></ul></nav>
    <!-- c <p>x</p> --><div class="ad">buy</div><main><h1>Big  &amp; &lt;b&gt;</h1><p>One <b>two</b><br>three<p>four &eacute;</p>
    <section id="comments"><p>me too</p></section><form>f</form><script>var a="<p>no</p>";</script><p>a < b</p></main><footer>z</footer>"""
    assert html_text.page_lines(page) == (["Big & <b>", "One two", "three", "four é", "a < b"], [False] * 5)
    assert html_text.page_lines("plain &copy;") == (["plain ©"], [True])
    for empty in (None, "", "<nav>x", "<!-- x", "<script>x", "<"):
        assert [x for x in html_text.page_lines(empty)[0] if x != "<"] == []


def naive_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randrange(12)) for _ in range(2))
        at = html_text.common_subsequence(a, b)
        picked = [a[k] for k in at]
        rest = iter(b)
        assert len(at) == naive_lcs(a, b) and at == sorted(set(at)) and all(x in rest for x in picked)


def test_page_differencing(spark):
    def page(k):
        return f"<div><p>Site menu</p><p>Log on</p></div><p>story {k} begins</p><p>and {k} ends</p><div>Imprint</div>"

    rows = [(k, f"http://one.example/a/{k:03d}", page(k)) for k in range(40)]
    rows += [(100, "http://two.example/x", page(100)), (101, None, page(101)), (102, "", None), (103, "http://one.example/a/999", "<p>Site menu</p>")]
    rows += [(200 + k, f"http://copy.example/{k}", "<p>same story</p><p>same end</p>") for k in range(5)]
    rows += [(300 + k, f"http://art.example/{k}", f"<nav>n</nav><article><p>shared passage</p><p>{k}</p></article>") for k in range(3)]
    pages = spark.createDataFrame([(*r, "x", False) for r in rows], "page_id long, url string, html string, path string, edge boolean")
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
        assert len(got) == len(rows)
        assert all(got[k] == f"story {k} begins and {k} ends" for k in range(40))
        assert got[100] == "Site menu Log on story 100 begins and 100 ends Imprint" and got[102] == ""
        assert all(got[200 + k] == "same story same end" for k in range(5)) and got[301] == "shared passage 1" and got[103] == "Site menu"
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert html_text.main_text(pages.limit(0)).count() == 0


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.read += n
        return self.raw[at : at + n]


def test_one_document_reads_a_fraction_of_its_file():
    rng = np.random.default_rng(4)
    ids = rng.choice([3, 200, 70_000, 5_000_000], 400_000).astype(np.uint32) + rng.integers(0, 50, 400_000).astype(np.uint32)
    codes = dac.encode(ids)
    sizes = np.full(4000, 100)
    raw = codes + dac.directory(list(range(4000)), sizes, len(codes))
    file = Counted(raw)
    keys, ends = dac.documents(file)
    assert keys == list(range(4000)) and ends[-1] == 400_000 and file.read < 20 * 4000
    file.read = 0
    reader = dac.Reader(file)
    assert reader.read(300_000, 300_100).tolist() == ids[300_000:300_100].tolist() and file.read < 2000 < len(raw) / 100
    places = [399_999, 0, 17, 200_000]
    file.read = 0
    assert reader.take(np.array(places)).tolist() == ids[places].tolist() and file.read < 2000
    assert reader.read(5, 5).tolist() == [] and reader.take(np.array([], dtype=int)).tolist() == []


def test_shards_keep_columns_with_any_names(spark):
    names = ["part", "rank", "total", "before", "curve", "place", "Part_", "a.b"]
    rows = [(i, f"t{i}", *[70 + 10 * i + k for k in range(len(names))]) for i in range(40)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` {'int' if k % 2 == 0 else 'long'}" for k, n in enumerate(names))]))
    out = sharding.write_shards(docs, common.fresh_path(spark, "test-shards"), ["doc_id", "rank"], shards=5)
    assert out.columns == [*docs.columns, "slot", "shard"] and sorted(tuple(r)[: len(docs.columns)] for r in out.collect()) == rows
