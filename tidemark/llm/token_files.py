"""Token ids of all documents in files of directly addressable codes, in ascending document order."""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import common, dac

#: Where a text may be cut without changing its byte-level BPE: before one space between two characters that no
#: definition takes for white space. The pre-tokenizer starts a new piece there whatever surrounds it.
CUT = re.compile(r"(?<=[^\s\x85\xa0])(?= [^\s\x85\xa0])")
SPECIAL = "<|endoftext|>"
#: The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b)) for b in range(256)}
#: ASCII punctuation but for the apostrophe, which may begin a contraction.
PUNCTUATION = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and b != 39)
SPACE_CHAR = chr(BYTE_CHARS[32])
#: Words of at most ``LONGEST`` characters whose ids are kept during a task; when half are new, the rest is forgotten.
KEPT, LONGEST = 800_000, 40

FILES = "part int, file string, n_docs long, ids long"
FILES_ARROW = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("ids", pa.int64())])
DOCS = "file string, doc_at long, row_id long, n_tokens long, at_token long, start long"


@functools.cache
def loaded(path: str) -> tuple:
    """The tokenizer, and whether letters behind at most one space are one piece of it, so that no other look at them
    is needed. Kept by the worker process: its size is the vocabulary's, whatever the texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)


class Uneven(Exception):
    """A word begins or ends with white space: the text has to be cut with more care."""


class Marks(dict):
    """Ids of runs of punctuation behind letters, where the pre-tokenizer begins a new piece."""

    def __init__(self, encoder: "Encoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, run: str) -> bytes:
        ids = self.encoder.library(run)
        if len(run) <= LONGEST and len(self) < KEPT // 100:
            self[run] = ids
        return ids


class Words(dict):
    """Ids, as bytes, of words that follow ``lead``, one space or nothing; each is encoded when first seen."""

    def __init__(self, encoder: "Encoder", lead: str):
        super().__init__()
        self.encoder, self.lead, self.old = encoder, lead, {}
        self.marks, self.letters = encoder.marks, encoder.letters if encoder.direct else None

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            # letters, and letters before punctuation, are most of the words: no other look at them
            if self.letters and word.isalpha():
                ids = self.letters(self.lead + word)
            elif self.letters and (bare := word.rstrip(PUNCTUATION)) != word and bare.isalpha():
                ids = self[bare] + self.marks[word[len(bare) :]]
            elif not word or word[0].isspace() or word[-1].isspace():
                raise Uneven
            else:
                ids = self.encoder.piece(self.lead + word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > KEPT // 2:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Whole texts to ids with the tokenizers library, each distinct word of a task encoded once."""

    def __init__(self, path: str):
        self.tokenizer, self.direct = loaded(path)
        self.tokens = self.tokenizer.model.tokenize
        self.line_break = self.library("\n")
        self.marks = Marks(self)
        self.words, self.heads = Words(self, " "), Words(self, "")

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """A piece without white space at its end, and at its beginning none or one space. A line break between
        other characters stands alone."""
        if "\n" in piece:
            head, *tail = piece.split("\n")
            if head.strip(" ") and all(x and not x[0].isspace() and not x[-1].isspace() for x in tail) and not head[-1].isspace():
                return self.line_break.join([self.piece(head), *map(self.piece, tail)])
        word = piece.removeprefix(" ")
        if self.direct and word.isalpha():
            return self.letters(piece)
        return self.library(piece)

    def letters(self, piece: str) -> bytes:
        """Letters behind at most one space, by the model alone."""
        spelt = piece.replace(" ", SPACE_CHAR) if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.tokens(spelt)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text or SPECIAL in text:
            return self.library(text)
        try:  # lines without white space at their ends: a line break between them stands alone
            lines = []
            for line in text.split("\n"):
                head, *tail = line.split(" ")
                lines.append(self.heads[head] + b"".join(map(self.words.__getitem__, tail)))
            return self.line_break.join(lines)
        except Uneven:
            pass
        head, *tail = text.split(" ")
        try:
            if head[-1:].isspace():
                raise Uneven
            return b"".join([self.piece(head) if head else b"", *map(self.words.__getitem__, tail)])
        except Uneven:
            return b"".join(map(self.library, CUT.split(text)))


def _writer(folder: str, tokenizer: str, end_id: int, bits: int, file_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        ids: list[bytes] = []
        docs: list = []
        held, files = 0, 0

        def flush() -> pa.RecordBatch:
            # of several attempts at a partition each names its files; only the one that succeeds is in the index
            name = f"{part:06d}-{files:05d}-{attempt}.dac"
            size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            with fs.open_output_stream(f"{root}/{name}") as out:
                codes = dac.encode(np.frombuffer(b"".join(ids), dtype="<u4"), bits)
                out.write(codes)
                out.write(dac.directory(docs, size, len(codes)))
            return pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": len(ids), "ids": int(size.sum())}], schema=FILES_ARROW)

        fs.create_dir(root, recursive=True)
        for batch in batches:
            encoder.words.age()
            encoder.heads.age()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = encoder.encode(text or "")
                docs.append(key)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= file_tokens:
                    yield flush()
                    ids, docs, held, files = [], [], 0, files + 1
        if ids:
            yield flush()

    return common.lean(write)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, bits: int = 8, file_tokens: int = 4 << 20) -> DataFrame:
    """Write the ids of every document, each closed by ``end_id``, to files under ``folder`` in ascending id order;
    a file has a directory of its documents behind the codes.

    Returns the files, one row each: ``part``, ``file``, ``n_docs``, ``ids`` (how many it holds), ``before`` (ids of all
    files before it). File names sort in document order. Null and empty texts give the end id alone. Null ids come
    first. Rows that share an id keep their own entries, in the order of their texts. An empty table gives no files.
    Other columns are ignored, whatever their names.
    """
    spark = common.tuned(docs.sparkSession)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange(common.partitions(spark), F.col("row_id").asc_nulls_first())
        .sortWithinPartitions(F.col("row_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    files, _ = common.staged(ordered.mapInArrow(_writer(folder, tokenizer, end_id, bits, file_tokens), FILES), "token-files")
    # running sums over one row a partition, and over the files of each partition
    parts = files.groupBy("part").agg(F.sum("ids").alias("part_ids")).withColumn("part_before", F.sum("part_ids").over(W.orderBy("part")) - F.col("part_ids"))
    inside = F.sum("ids").over(W.partitionBy("part").orderBy("file")) - F.col("ids")
    return files.withColumn("inside", inside).join(parts.hint("merge"), "part").select(*files.columns, (F.col("part_before") + F.col("inside")).alias("before"))


def _directories(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with fs.open_input_file(f"{root}/{file}") as stream:
                    keys, ends = dac.documents(stream)
                size = np.diff(ends, prepend=0)
                columns = ([file] * len(keys), np.arange(len(keys)), keys, size, ends - size, before + ends - size)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names=["file", "doc_at", "row_id", "n_tokens", "at_token", "start"])

    return common.lean(read)


def documents(files: DataFrame, folder: str) -> DataFrame:
    """One row a document of the files, from their directories: ``file``, ``doc_at`` (place in the file), ``row_id``,
    ``n_tokens`` (with the end id), ``at_token`` (place of its first id in the file), ``start`` (ids of all documents
    before it). No files give no rows."""
    spark = common.tuned(files.sparkSession)
    return files.select("file", "before").repartition(common.partitions(spark), "file").mapInArrow(_directories(folder), DOCS)


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, reader, stream = None, None, None
        for batch in batches:
            out = []
            for file, at, n in zip(*(batch.column(k).to_pylist() for k in ("file", "at_token", "n_tokens"))):
                if file != name:
                    if stream is not None:
                        stream.close()
                    stream = fs.open_input_file(f"{root}/{file}")
                    name, reader = file, dac.Reader(stream)
                out.append(reader.read(at, at + n).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.binary())], names=["row_id", "start", "n_tokens", "ids"])
        if stream is not None:
            stream.close()

    return common.lean(read)


IDS = "row_id long, start long, n_tokens long, ids binary"


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """(row_id, start, n_tokens, ids) of chosen rows of ``documents``, each read alone from its file: of every level of
    the codes no more than the document's own part, and the head of the file once. ids: little-endian u32. Repeated rows come back as often; no rows give none."""
    spark = common.tuned(index.sparkSession)
    by_file = index.select("row_id", "start", "n_tokens", "file", "at_token").repartition(common.partitions(spark), "file").sortWithinPartitions("file", "at_token")
    return by_file.mapInArrow(_reader(folder), IDS)


def _whole_files(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with fs.open_input_file(f"{root}/{file}") as stream:
                    raw = dac.Whole(stream.read())
                keys, ends = dac.documents(raw)
                reader = dac.Reader(raw)
                size = np.diff(ends, prepend=0)
                for a in range(0, len(keys), common.ARROW_ROWS):
                    b = min(a + common.ARROW_ROWS, len(keys))
                    first = int(ends[a] - size[a])
                    ids = reader.read(first, int(ends[b - 1])).astype("<u4").tobytes()
                    cuts = [0, *((ends[a:b] - first) * 4).tolist()]
                    own = [ids[x:y] for x, y in zip(cuts, cuts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array((before + ends - size)[a:b]), pa.array(size[a:b]), pa.array(own, pa.binary())], names=["row_id", "start", "n_tokens", "ids"])

    return common.lean(read)


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """(row_id, start, n_tokens, ids) of all documents of the files, from nothing but the files and the number of ids
    before each. No files give no rows."""
    spark = common.tuned(files.sparkSession)
    return files.select("file", "before").repartition(common.partitions(spark), "file").mapInArrow(_whole_files(folder), IDS)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.fresh_path(spark, "tokens")
    files = write_tokens(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(files, folder).select(F.col("row_id").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
