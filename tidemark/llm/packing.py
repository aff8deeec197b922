"""Packing of token ids into training sequences of several lengths.

Documents are routed to tiers, powers of two up to the window, by what is left of them behind whole windows. From the
longest tier down, a document opens a sequence of its tier, and documents of shorter tiers fill the gap, the longest
that fits first; one that does not fit is cut for the rest. So every sequence is exactly full. What a task cannot fill
goes to a second, small stage, and only there the last sequence of each task is padded. Training steps then take the
same share of every tier.
"""

from __future__ import annotations

import functools
import os
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.token_files import BYTE_CHARS, KEPT, LONGEST, PUNCTUATION

TIERS = (256, 512, 1024, 2048)
#: Ids that a task holds before it packs them, and characters of a text that are encoded at once.
POOL_IDS, SLICE = 1 << 19, 1 << 20
#: Tasks whose rests one task of the second stage packs, and rows that may be broadcast (of 40 bytes).
TOGETHER, FEW = 512, 100_000


@functools.cache
def loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(word: str) -> bool:
    """Letters of Latin-1 alone: in lower case they are letters still, one each."""
    return word.isalpha() and (word.isascii() or max(word) < "Ā")


class Words(dict):
    """Ids, as bytes, of text between white space, each distinct word encoded once a task, case by case.

    The tokenizer lower-cases, drops white space, and begins a new piece where letters and punctuation meet. Letters
    of Latin-1 go to its BPE model alone; anything else through the whole library.
    """

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.tokenizer, self.old = loaded(path), {}
        self.tokens = self.tokenizer.model.tokenize

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if plain(word):
                ids = array("I", [t.id for t in self.tokens(word.lower().encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
            elif (bare := word.rstrip(PUNCTUATION)) != word and plain(bare):
                ids = self[bare] + self.mark(word[len(bare) :])
            else:
                ids = self.library(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def mark(self, run: str) -> bytes:
        # a lone run of punctuation is looked up as a word of its own
        return self[run] if len(run) < 4 else self.library(run)

    def encode(self, text: str) -> bytes:
        parts, at = [], 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):  # up to white space
                found = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
                end = min(found, default=len(text))
            words = text[at:end].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            parts += map(self.__getitem__, words)
            at = end
        return b"".join(parts)

    def age(self) -> None:
        if len(self) > KEPT // 2:
            self.old = dict(self)
            self.clear()
            self[""] = b""


class Pool:
    """Items (doc, start, ids, doc_tokens) by length, and the sequences that they fill exactly."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.by_length, self.lengths, self.ids = tiers, {}, [], 0

    def add(self, item: tuple) -> None:
        n = len(item[2]) // 4
        if n not in self.by_length:
            self.by_length[n] = []
            insort(self.lengths, n)
        self.by_length[n].append(item)
        self.ids += n

    def take(self, n: int) -> tuple:
        stack = self.by_length[n]
        item = stack.pop()
        if not stack:
            del self.by_length[n]
            del self.lengths[bisect_left(self.lengths, n)]
        self.ids -= n
        return item

    def cut(self, item: tuple, n: int) -> tuple:
        """The first ``n`` ids of an item; the rest goes back, to its own tier."""
        doc, start, ids, size = item
        self.add((doc, start + n, ids[4 * n :], size))
        return doc, start, ids[: 4 * n], size

    def largest(self, most: int) -> int:
        at = bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else 0

    def packed(self, tiers: tuple[int, ...] | None = None) -> Iterator[tuple[int, list[tuple]]]:
        """(tier, items) of full sequences, as many as there are; what is left would not fill one. ``tiers``: only of
        these, shorter ones count for the shortest of them."""
        tiers = tiers or self.tiers
        for tier, shorter in reversed(list(zip(tiers, (0, *tiers)))):
            while (head := self.largest(tier)) > shorter:
                items, gap = [self.take(head)], tier - head
                while gap and (n := self.largest(gap)):
                    items.append(self.take(n))
                    gap -= n
                if gap and self.lengths:  # of a shorter tier if there is one
                    items.append(self.cut(self.take(self.largest(shorter) or self.lengths[0]), gap))
                    gap = 0
                if gap:
                    for item in items:
                        self.add(item)
                    break
                yield tier, items

    def rest(self) -> list[tuple]:
        return [self.take(n) for n in reversed(list(self.lengths)) for _ in range(len(self.by_length[n]))]


PIECES = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("part", pa.int64()), ("place", pa.int64())])
PIECES_SQL = "doc long, start long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, part long, place long"


class Output:
    """Rows of pieces; sequences are numbered by task, and inside a task by tier as well."""

    def __init__(self, part: int):
        self.part, self.rows, self.made, self.places = part, [], 0, {}

    def put(self, tier: int, items: list[tuple]) -> None:
        place = self.places[tier] = self.places.get(tier, -1) + 1
        at = 0
        for item in items:
            self.rows.append((*item, (self.part << 33) + self.made, at, tier, self.part, place))
            at += len(item[2]) // 4
        self.made += 1

    def waiting(self, items: list[tuple]) -> None:
        self.rows += [(*item, None, None, None, self.part, None) for item in items]

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            for at in range(0, len(self.rows), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows[at : at + 2048]), PIECES.types)], schema=PIECES)
            self.rows = []


def _packer(tokenizer: str, end_id: int, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, window = Words(tokenizer), np.array([end_id], dtype="<u4").tobytes(), tiers[-1]
        pool, out = Pool(tiers), Output(TaskContext.get().partitionId())
        for batch in batches:
            words.age()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py() or "") + end
                size = len(ids) // 4
                whole = size // window * window
                for at in range(0, whole, window):
                    out.put(window, [(doc, at, ids[4 * at : 4 * (at + window)], size)])
                if whole < size:
                    pool.add((doc, whole, ids[4 * whole :], size))
                if pool.ids >= POOL_IDS:
                    for tier, items in pool.packed():
                        out.put(tier, items)
                yield from out.batches(2048)
        last = list(pool.packed())
        rest = pool.rest()
        held = sum(len(x[2]) for x in rest) // 4
        for tier, items in reversed(last):  # short sequences wait with a rest that they make longer: less padding
            if rest and tier < window and held + tier < window:
                rest += items
                held += tier
            else:
                out.put(tier, items)
        out.waiting(rest)
        yield from out.batches()

    return common.lean(run)


def _rests(tiers: tuple[int, ...], first_part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, out = Pool(tiers), Output(first_part + TaskContext.get().partitionId())
        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("doc", "start", "ids", "doc_tokens"))):
                pool.add(item)
            for tier, items in pool.packed(tiers[-1:]):
                out.put(tier, items)
            yield from out.batches(2048)
        if rest := pool.rest():
            out.put(tiers[-1], rest)
        yield from out.batches()

    return common.lean(run)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_ids: int = 1 << 16) -> DataFrame:
    """One row a piece of a document: ``doc``, ``start`` (ids of the document before it), ``length``, ``ids``
    (little-endian u32), ``doc_tokens`` (ids of the document with its end), ``sequence_id``, ``offset`` (its place there),
    ``tier`` (the sequence's length) and ``step``.

    Every document is encoded whole and closed by ``end_id``; each id lies in exactly one piece. ``tiers``: ascending,
    each at most twice the one before. Sequences are full but for the last of each task of the second stage, one task
    for ``TOGETHER`` of the first, which is padded to the longest tier. ``step``: groups of about ``step_ids`` ids, each
    with the same number of sequences of a tier, give or take one. Null and empty texts are the end id alone; null ids
    stay null; repeated rows are documents of their own. No rows give none. Other columns are ignored.
    """
    spark = common.tuned(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    made, _ = common.staged(texts.mapInArrow(_packer(tokenizer, end_id, tiers), PIECES_SQL), "packed")
    tasks = made.agg(F.max("part")).first()[0]
    if tasks is None:
        return made.withColumn("length", F.lit(0).cast("long")).withColumn("step", F.lit(0).cast("long")).select(*COLUMNS)
    waiting = made.where("sequence_id is null").repartition(-(-(tasks + 1) // TOGETHER), F.floor(F.col("part") / TOGETHER)).sortWithinPartitions("part", "doc", "start")
    rests, _ = common.staged(waiting.mapInArrow(_rests(tiers, tasks + 1), PIECES_SQL), "packed-rests")
    both = made.where("sequence_id is not null").unionByName(rests)
    # where each task's sequences of a tier come among all of that tier: one row a task and tier
    counts = both.where("offset = 0").groupBy("tier", "part").agg(F.count("*").alias("own"))
    counts, _ = common.staged(counts.select("tier", "part", (F.sum("own").over(W.partitionBy("tier").orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(W.partitionBy("tier")).alias("all")), "packed-counts", per_file=8)
    totals = counts.groupBy("tier").agg(F.max("all").alias("n")).collect()  # a row a tier
    steps = max(1, round(sum(r["tier"] * r["n"] for r in totals) / step_ids))
    counts = F.broadcast(counts) if counts.count() <= FEW else counts.hint("merge")
    step = F.floor((F.col("before") + F.col("place")) * steps / F.col("all")).cast("long")
    return both.join(counts, ["tier", "part"]).select("doc", "start", (F.length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", "offset", "tier", step.alias("step"))


COLUMNS = ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step"]


def op11_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")
