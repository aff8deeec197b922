"""WARC archives with an index written beside them, and reads that go by the index.

Each record is a gzip member of its own. The index has file, offset, length, URL and digest of every record; selected
records are sorted by place and read in coalesced byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_SQL = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD_SQL = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
CONTROL = re.compile(r"[\x00-\x20\x7f]")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, compressed. A revisit keeps the HTTP headers, so the size of the payload it stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Target-URI: {CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}"] if url is not None else []),
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{NAME}{'' if refers_to is None else refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}, rest


def page_of(urn: str) -> int | None:
    key = urn.strip("<>").removeprefix(NAME)
    return int(key) if key else None


def parse(raw: bytes) -> dict:
    """One decompressed record; the digest of a response is taken from its payload and held against its header."""
    head, rest = headers(raw)
    http, body = headers(rest[: int(head["content-length"])])
    stated, size = head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    revisit = head["warc-type"] == "revisit"
    if not revisit and (len(body) != size or payload_digest(body) != stated):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    return {
        "page_id": page_of(head["warc-record-id"]),
        "url": head.get("warc-target-uri"),
        "record_type": head["warc-type"],
        "payload_bytes": size,
        "payload_digest": stated,
        "refers_to": page_of(head["warc-refers-to"]) if revisit else None,
        "payload": None if revisit else body,
    }


def _writer(folder: str, date: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        out, name, files, at = None, "", 0, 0
        for batch in batches:
            rows = []
            for page, url, html, first, again in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "first", "again"))):
                payload = (html or "").encode()
                digest = payload_digest(payload)
                packed = record(page, url, payload, digest, first if again else None, again, date)
                if out is None or at + len(packed) > file_bytes and at:
                    if out:
                        out.close()
                    name, files, at = f"{stem}-{files:05d}.warc.gz", files + 1, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(packed)
                rows.append((page, url, digest, "revisit" if again else "response", first if again else None, name, at, len(packed)))
                at += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, INDEX.types)], schema=INDEX)
        if out:
            out.close()

    return common.lean(write)


def write_archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per row and return the index, staged.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes the smallest id is a response and the others
    revisit it; shorter payloads are all responses. A null payload is empty. Rows that repeat the smallest id are
    responses too; a null id never is the smallest unless all of its group are null. Control characters in URLs are
    percent-encoded, a null URL is left out. An empty table gives an empty index. Other columns are ignored.
    """
    spark = common.tuned(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sum", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # one row a payload that occurs twice, counted before the exchange, and staged: between two tables Spark splits the
    # key of a payload with very many copies, beside an aggregate it cannot
    twice = rows.where(F.octet_length("html") >= revisit_bytes).groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sum").alias("group_sum"), "first")
    groups, groups_at = common.staged(twice, "warc-groups")
    joined = rows.join(groups.hint("merge"), F.col("sum") == F.col("group_sum"), "left")
    again = F.col("group_sum").isNotNull() & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    index, _ = common.staged(joined.select("page_id", "url", "html", "first", again.alias("again")).mapInArrow(_writer(folder, date, file_bytes), INDEX_SQL), "warc-index")
    common.remove(spark, groups_at)
    return index


def coalesced(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int]]:
    """(first range, behind the last range, end byte) of each read: ascending (offset, length) ranges go together
    while at most ``gap`` bytes lie between them and the read stays within ``most`` bytes."""
    out: list[list[int]] = []
    for k, (at, n) in enumerate(ranges):
        if out and at - out[-1][2] <= gap and at + n - ranges[out[-1][0]][0] <= most:
            out[-1][1:] = [k + 1, max(out[-1][2], at + n)]
        else:
            out.append([k, k + 1, at + n])
    return [tuple(x) for x in out]


def _reader(folder: str, gap: int, most: int, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, stream = None, None
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            files, offsets, lengths = (batch.column(k).to_pylist() for k in ("file", "offset", "length"))
            cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if files[a] != name:
                    if stream:
                        stream.close()
                    name, stream = files[a], fs.open_input_file(f"{root}/{files[a]}")
                own = list(zip(offsets[a:b], lengths[a:b]))
                for i, j, end in coalesced(own, gap, most):
                    begin = own[i][0]
                    raw = stream.read_at(end - begin, begin)
                    rows = [parse(zlib.decompress(raw[at - begin : at - begin + n], 31)) for at, n in own[i:j]]
                    if not payloads:
                        for r in rows:
                            r["payload"] = None
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if stream:
            stream.close()

    return common.lean(read)


def read_records(index: DataFrame, folder: str, *, gap: int = 64 << 10, most: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of the index rows given, each verified; ``payload`` is null for revisits and without ``payloads``."""
    spark = common.tuned(index.sparkSession)
    placed = index.select("file", "offset", "length").repartitionByRange(common.partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_reader(folder, gap, most, payloads), RECORD_SQL)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    folder = common.fresh_path(spark, "warc")
    index = write_archive(common.table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  -- five hexadecimal digits are four of base 32
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, i // 4 * 5 + 1, 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""
