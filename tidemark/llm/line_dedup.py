"""Exact line deduplication across documents.

Line hashes are range-partitioned with a secondary sort by document (largest first) and position, and streamed: the
first document of a hash keeps its lines, later ones lose theirs. A hash that a third of all documents hold spreads
over partitions, because the document is part of the range key; only what touches a partition's edge is settled
afterwards, from two counts a partition. The result is a compressed bitmap of kept lines per document, no text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

BLANK = b" \t\n\x0b\x0c\r"
INNER = bytes(range(0x80, 0xC0))  # bytes of a code point in UTF-8 behind its first

KEYS_SQL = "line binary, doc long, body long, pos int"
KEY_ROWS = 8192  # in one batch

STREAM = pa.schema([("kind", pa.int8()), ("line", pa.binary()), ("doc", pa.int64()), ("body", pa.int64()), ("pos", pa.int32()), ("docs", pa.int64()), ("part", pa.int32())])
STREAM_SQL = "kind byte, line binary, doc long, body long, pos int, docs long, part int"
DROP, WAIT, COUNT = 0, 1, 2


def _keys(min_chars: int):
    """Of (doc, body, text in UTF-8) the rows of ``KEYS_SQL``."""

    def is_long(key: bytes) -> bool:
        return len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.translate(None, INNER)) >= min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, rows, at = [], [], []

            def made() -> pa.RecordBatch:
                own = pa.array(rows, pa.int64())
                out = pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), batch.column(0).take(own), batch.column(1).take(own), pa.array(at, pa.int32())], names=["line", "doc", "body", "pos"])
                for x in (lines, rows, at):
                    x.clear()
                return out

            for row, text in enumerate(batch.column(2)):
                for pos, line in enumerate(text.as_py().split(b"\n")):
                    if len(line) >= min_chars and is_long(key := line.strip(BLANK)):
                        lines.append(hashlib.md5(key.lower(), usedforsecurity=False).digest())  # of bytes only A-Z change
                        rows.append(row)
                        at.append(pos)
                        if len(lines) == KEY_ROWS:
                            yield made()
            if lines:
                yield made()

    return common.lean(run)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(line, doc, body, pos) of every line whose key has at least ``min_chars`` code points.

    line: 128-bit hash of the key. body: hash of the whole text, which tells apart rows that share an id. Lines are
    cut in Python: as strings in the JVM they are garbage of many times the text, for which its heap grows to its limit.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("body"), text.cast("binary").alias("text")).mapInArrow(_keys(min_chars), KEYS_SQL)


def _stream(min_docs: int):
    """Within a partition sorted by (line, doc descending): DROP rows of lines settled inside, and for the first and
    the last line, which may go on in a neighbouring partition, WAIT rows and one COUNT row (documents, largest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        first = True  # the open group is the partition's first
        line = None  # of the open group
        top = docs = last_doc = None
        held: list[pa.RecordBatch] = []  # rows of the open group that no verdict covers yet

        def rows(kind: int, b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, kind, dtype=np.int8)), b.column(0), b.column(1), b.column(2), b.column(3), pa.nulls(b.num_rows, pa.int64()), pa.array(np.full(b.num_rows, number, dtype=np.int32))], schema=STREAM)

        def count() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([COUNT], [line], [top], [0], [0], [docs], [number]), STREAM.types)], schema=STREAM)

        def not_top(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.filter(pa.array(b.column(1).to_numpy(zero_copy_only=False) != top))

        for batch in batches:
            if not batch.num_rows:
                continue
            lines, doc = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(lines)) if lines[i] != lines[i - 1]), len(lines)]
            for a, b in zip(cuts, cuts[1:]):
                if b - a < min_docs and a and b < len(lines) and not first:  # short and settled within this batch
                    continue
                if lines[a] != line:
                    if line is not None and first:
                        yield count()  # its rows went out as WAIT
                    first = line is None
                    line, top, docs, last_doc, held = lines[a], int(doc[a]), 0, None, []
                part, own = batch.slice(a, b - a), doc[a:b]
                docs += int((own[1:] != own[:-1]).sum()) + (last_doc is None or int(own[0]) != last_doc)
                last_doc = int(own[-1])
                if first:
                    yield rows(WAIT, part)
                elif docs >= min_docs:  # it began here, so its largest document is known
                    for x in [*held, part]:
                        if (x := not_top(x)).num_rows:
                            yield rows(DROP, x)
                    held = []
                elif b == len(lines):
                    held.append(part)  # fewer than min_docs documents so far; it may go on
        if line is not None:
            for x in held:
                yield rows(WAIT, x)
            yield count()

    return common.lean(run)


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, body, ``bitmap``) for every document row that loses a line.

    A line's key is the line without blanks at both ends and with A-Z lower-cased. Keys of at least ``min_chars``
    code points found in at least ``min_docs`` documents lose their lines everywhere but in the largest id.
    Null ids count as one document below all others. Null and empty texts are one empty line, whose key is too
    short. Rows that share an id are one document for the counts and keep separate bitmaps by text. Empty tables
    give no rows. ``bitmap``: deflated bits, 1 for a dropped line, lowest first, up to the last dropped line.
    """
    spark = common.tuned(docs.sparkSession)
    low = -(1 << 63)
    keys = line_keys(docs.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.lit(low))), id_col, text_col, min_chars)
    hashed, keys_at = common.staged(keys, "line-keys")
    # a row is some 40 bytes: fewer ranges than for texts, as each writes files, and a process starts for each file
    ordered = hashed.repartitionByRange(max(1, common.partitions(spark) // 3), F.col("line").asc(), F.col("doc").desc()).sortWithinPartitions(F.col("line").asc(), F.col("doc").desc(), F.col("pos").asc())
    streamed, stream_at = common.staged(ordered.mapInArrow(_stream(min_docs), STREAM_SQL), "line-stream")
    # at most two rows a partition; their verdicts go back by partition and line, so a line that fills very many
    # partitions is no single key among the rows that wait
    counts = streamed.where(F.col("kind") == COUNT).select("line", "part", "doc", "docs")
    edges = counts.groupBy("line").agg(F.sum("docs").alias("all_docs"), F.max("doc").alias("top")).where(F.col("all_docs") >= min_docs)
    verdicts = counts.select("line", "part").join(edges.hint("merge"), "line").select(F.col("line").alias("edge_line"), F.col("part").alias("edge_part"), "top")
    late = streamed.where(F.col("kind") == WAIT).join(verdicts.hint("merge"), (F.col("line") == F.col("edge_line")) & (F.col("part") == F.col("edge_part"))).where(F.col("doc") != F.col("top"))
    gone = streamed.where(F.col("kind") == DROP).select("doc", "body", "pos").unionByName(late.select("doc", "body", "pos"))
    maps = gone.groupBy("doc", "body").agg(F.collect_set("pos").alias("gone")).select(F.when(F.col("doc") != low, F.col("doc")).alias(id_col), "body", pack("gone").alias("bitmap"))
    out, _ = common.staged(maps, "line-bitmaps")
    common.remove(spark, keys_at, stream_at)
    return out


def to_bitmap(gone) -> bytes:
    bits = np.zeros(max(gone) + 1, dtype=np.uint8)
    bits[list(gone)] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def from_bitmap(bitmap: bytes | None, lines: int) -> np.ndarray:
    """True for each line that stays."""
    if bitmap is None:
        return np.ones(lines, dtype=bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")[:lines]
    return np.concatenate((bits == 0, np.ones(lines - len(bits), dtype=bool)))


pack = F.udf(to_bitmap, T.BinaryType(), useArrow=True)


def kept_text(text: str | None, bitmap: bytes | None) -> str:
    lines = (text or "").split("\n")
    return "\n".join(x for x, stays in zip(lines, from_bitmap(bitmap, len(lines))) if stays)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist()):
            n = (text or "").count("\n") + 1
            if bitmap is None:
                out.append((n, 0, text))
            else:
                stays = from_bitmap(bitmap, n)
                out.append((n, n - int(stays.sum()), kept_text(text, bitmap)))
        n, gone, kept = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row_id", "n_lines", "n_dropped", "kept"])


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, n_lines, n_dropped, kept text) of every row, by joining the bitmaps to the texts."""
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    text = F.col(text_col).cast("string")
    left = docs.select(F.col(id_col).cast("long").alias("row_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("body"))
    # the bitmaps grow with the documents: one plan at every size, never a broadcast of them
    right = maps.select(F.col(id_col).alias("map_id"), F.col("body").alias("map_body"), "bitmap").hint("merge")
    joined = left.join(right, F.col("row_id").eqNullSafe(F.col("map_id")) & (F.col("body") == F.col("map_body")), "left")
    return joined.select("row_id", "text", "bitmap").mapInArrow(common.lean(_applied), "row_id long, n_lines long, n_dropped long, kept string").withColumnRenamed("row_id", id_col)


def without_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of ``docs`` with all their columns, whatever their names, dropped lines taken out of the text.

    Null ids, repeated ids and repeated rows count as in ``keep_bitmaps``. Null and empty texts stay as they are; a
    text that loses all its lines becomes empty. An empty table gives no rows.
    """
    own, map_id, map_body, bitmap = common.fresh_names(docs, "own_body", "map_id", "map_body", "bitmap")
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs).toDF(map_id, map_body, bitmap).hint("merge")
    body = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    joined = docs.withColumn(own, body).join(maps, F.col(id_col).cast("long").eqNullSafe(F.col(map_id)) & (F.col(own) == F.col(map_body)), "left")
    cut = F.udf(lambda text, dropped: None if dropped is None else kept_text(text, dropped), T.StringType(), useArrow=True)
    lost = F.col(bitmap).isNotNull()
    new = F.when(lost, cut(F.when(lost, F.col(text_col)), F.col(bitmap))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, new).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = deduplicated(common.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT d.doc_id, d.pos, d.line, h.k IS NOT NULL AND d.doc_id <> h.top AS gone FROM keyed d LEFT JOIN hot h ON d.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
