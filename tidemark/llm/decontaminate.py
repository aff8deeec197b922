"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of about ``shard_words`` words. Its index holds the maximal runs of words that
occur in the benchmark at all: a phrase cannot reach over another word, so leaving the rest out changes no result.
Backward search finds every phrase, sampled suffix positions locate it, and the hits merge into removal spans.

Rows never leave their partition, so a hot source or a common passage makes no shuffle and no large group.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common
from tidemark.llm.fm_index import FMIndex

#: ASCII letters and digits and all beyond ASCII make words; A-Z become a-z, the rest a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: UTF-8 bytes of benchmark text that the driver and each task hold at once, about ten times that as windows.
PHRASE_BYTES = 8 << 20

OUT = pa.schema(
    [
        ("row_id", pa.int64()),
        ("text", pa.string()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)
OUT_SQL = "row_id long, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


class Phrases:
    """The distinct windows of a block of items as rows of symbols, and the items each comes from, all in arrays."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({k for k, _ in items})
        number = {k: n for n, k in enumerate(self.names)}
        tables, owners = [np.zeros((0, window), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int32)
            if len(ids):
                # a shorter item is one row, right-aligned behind zeros
                own = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(max(0, window - len(ids)), dtype=np.int32), ids)), window)
                tables.append(own)
                owners.append(np.full(len(own), number[item]))
        self.table, row = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
        self.lengths = np.count_nonzero(self.table, axis=1)
        # items of row r: item[first[r] : first[r + 1]], ascending
        pairs = np.unique(row.ravel() * len(self.names) + np.concatenate(owners))
        self.item = (pairs % max(1, len(self.names))).astype(np.int32)
        self.first = np.searchsorted(pairs, np.arange(len(self.table) + 1) * len(self.names))
        self.shortest = int(self.lengths.min(initial=window))

    def of(self, rows: np.ndarray) -> list[str]:
        """Names of the items of any of the rows, sorted."""
        count = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return [self.names[i] for i in np.unique(self.item[at])]


def search_shard(ids: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """For each document's symbols (0: not a benchmark word) the merged hit spans in words, and the items found."""
    spans: list[list[tuple[int, int]]] = [[] for _ in ids]
    items: list[list[str]] = [[] for _ in ids]
    if not len(phrases.lengths) or not ids:
        return spans, items
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in ids])))
    flat = np.zeros(starts[-1], dtype=np.int64)
    for at, x in zip(starts, ids):
        flat[at : at + len(x)] = x
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flat != 0, [False])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return spans, items
    # the runs one after the other, each with the separator behind it
    size = end - begin + 1
    place = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    index = FMIndex(flat[place] * (np.arange(len(place)) != np.repeat(np.cumsum(size) - 1, size)))
    low, high = index.search(phrases.table, phrases.lengths)
    hit = np.flatnonzero(low < high)
    if not len(hit):
        return spans, items
    count = (high - low)[hit]
    which = np.repeat(hit, count)
    rows = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    at = place[index.locate(rows)]
    delta = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + phrases.lengths[which], -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(delta[:-1]) > 0, [False])).astype(np.int8)))
    owner = np.searchsorted(starts, edge[::2], side="right") - 1
    for d, a, b in zip(owner.tolist(), (edge[::2] - starts[owner]).tolist(), (edge[1::2] - starts[owner]).tolist()):
        spans[d].append((a, b))
    owner = np.searchsorted(starts, at, side="right") - 1
    pairs = np.unique(owner * len(phrases.lengths) + which)
    doc, row = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
    for x, y in zip(cuts, cuts[1:]):
        items[doc[x]] = phrases.of(row[x:y])
    return spans, items


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _searcher(items: list[tuple[str, str | None]], window: int, shard_words: int, first: bool):
    """``rest``: a column of its own that stays beside its row, when there is one."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, window)
        get = phrases.vocabulary.get
        rows: list[tuple] = []
        ids: list[np.ndarray] = []
        held, kind = 0, None

        def flush() -> pa.RecordBatch:
            spans, found = search_shard(ids, phrases)
            columns: tuple = ([], [], [], [], [], [])
            for (key, text, n, rest, old_spans, old_items), s, f in zip(rows, spans, found):
                s, f = (merged(old_spans, s), {*f, *old_items}) if old_spans else (s, f)
                for column, value in zip(columns, (key, text, n, [{"start": a, "end": b} for a, b in s], sorted(f), rest)):
                    column.append(value)
            rows.clear()
            ids.clear()
            schema = OUT if kind is None else OUT.append(pa.field("rest", kind))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            data = batch.to_pydict()
            kind = batch.schema.field("rest").type if "rest" in data else None
            rest = data.get("rest", [None] * batch.num_rows)
            for k, (key, text) in enumerate(zip(data["row_id"], data["text"])):
                w = words(text)
                ids.append(np.fromiter([get(x, 0) for x in w], dtype=np.int64, count=len(w)))
                old = ([], []) if first else ([(x["start"], x["end"]) for x in data["spans"][k]], data["items"][k])
                rows.append((key, text, len(w), rest[k], *old))
                held += len(w)
                if held >= shard_words:
                    yield flush()
                    held = 0
        if rows:
            yield flush()

    return common.lean(search)


def removal_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shard_words: int = 1 << 20,
    phrase_bytes: int = PHRASE_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per document: its id, text, ``n_words``, ``spans`` (word offsets [start, end), merged, ascending) and
    ``items`` (ids as strings, sorted) of the benchmark items of which a window occurs.

    A window is ``window`` consecutive item words; an item of fewer words, but not none, is one window.
    Null and empty texts have no words and no hits. A null item id counts as no item but its text still hits under
    the id ``''``. Repeated document rows are treated alike, each for itself. Empty tables give no rows or no hits.
    Other columns of either table are ignored, whatever their names, but for those of ``carry``: they come back as
    fields of the column ``rest``.

    Benchmark text beyond ``phrase_bytes`` is searched for block after block of items: each pass reads what the one
    before it wrote, so neither the driver nor a task ever holds more than one block.
    """
    spark = common.tuned(docs.sparkSession)
    wanted = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("k"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    size = wanted.agg(F.sum(F.octet_length("t") + F.lit(64))).first()[0] or 0
    blocks = max(1, -(-size // phrase_bytes))
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []
    out = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"), *rest)
    shape = T.StructType([*T._parse_datatype_string(OUT_SQL).fields, *out.schema.fields[2:]])
    done = None
    for b in range(blocks):
        block = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b)
        out = out.mapInArrow(_searcher([tuple(r) for r in block.collect()], window, shard_words, b == 0), shape)
        if b < blocks - 1:
            out, at = common.staged(out, "spans")
            if done:
                common.remove(spark, done)
            done = at
    return out.withColumnRenamed("row_id", id_col)


def cut(text: str, spans: list) -> str:
    """The text without its hit words: each span goes from its first word's first byte to its last word's last."""
    raw = text.encode()
    at = [(m.start(), m.end()) for m in WORD.finditer(raw.translate(TO_WORDS))]
    out, done = [], 0
    for s in spans:
        out.append(raw[done : at[s["start"]][0]])
        done = at[s["end"] - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def without_spans(found: DataFrame) -> DataFrame:
    """``clean``: the text of each row of ``removal_spans`` with its spans cut out; texts without spans, null and
    empty ones among them, stay as they are. Rows are treated each for itself, whatever their ids; none give none."""
    cutter = F.udf(lambda t, s: cut(t, s) if s else None, "string", useArrow=True)
    hit = F.size("spans") > 0
    return found.withColumn("clean", F.when(hit, cutter(F.when(hit, F.col("text")), F.when(hit, F.col("spans")))).otherwise(F.col("text")))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = removal_spans(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = 10) -> list[tuple]:
    """Per text: words, hit words, item ids, sha256; by comparing every window with every place."""
    wins = [(k, w[i : i + window]) for k, t in items for w in [words(t)] if w for i in range(max(1, len(w) - window + 1))]
    out = []
    for t in texts:
        w, hit, got = words(t), set(), set()
        for k, x in wins:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    got.add(k)
        out.append((len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)
), found AS (
  SELECT d.doc_id, d.i, d.size, t.item_id FROM doc_windows d JOIN item_windows t ON d.size = t.size AND d.phrase = t.phrase
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM words w LEFT JOIN hits h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""
