"""Sharding by Hilbert-curve order over several quantised metadata dimensions.

Each dimension is cut at quantiles of all rows, the cell's index on the Hilbert curve is the sort key, and the sorted
rows are cut into runs of equal count. A shard so covers a compact region, and the ranges of every dimension in its
files' statistics are narrow, whichever dimension a query filters by.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common


#: Runs of the curve a shuffle partition.
FINER = 4


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``cells`` (columns: dimensions, values below 2**bits).

    Skilling's transposed form (2004): undo excess work from the top bit down, Gray-encode, interleave the bits.
    """
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(n):
            on = (x[k] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & p)
            first = np.where(on, x[0] ^ p, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
            x[0] = first
        q >>= 1
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x = [v ^ flip for v in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> b) & 1)
    return out


def _measures(docs: DataFrame, dimensions: list[str]) -> dict[str, Column]:
    """A number in the order of each dimension: numbers as they are, strings by six bytes behind what all share."""
    texts = [c for c in dimensions if isinstance(docs.schema[c].dataType, T.StringType)]
    shared: dict[str, int] = {}
    if texts:
        ends = docs.agg(*[f(c).alias(f"{name}_{k}") for k, c in enumerate(texts) for name, f in (("low", F.min), ("high", F.max))]).first()
        for k, c in enumerate(texts):
            low, high = ((ends[f"{x}_{k}"] or "").encode() for x in ("low", "high"))
            shared[c] = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return {
        c: F.conv(F.rpad(F.hex(F.substring(F.col(c).cast("binary"), shared[c] + 1, 6)), 12, "0"), 16, 10).cast("double") if c in shared else F.col(c).cast("double")
        for c in dimensions
    }


def with_curve_index(docs: DataFrame, dimensions: list[str], bits: int = 4, accuracy: int = 400, name: str = "curve") -> DataFrame:
    """``name``: the Hilbert index of each row's cell. Cuts are quantiles of all rows; nulls are in the first cell."""
    measures = _measures(docs, dimensions)
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = docs.agg(*[F.percentile_approx(m, at, accuracy).alias(f"d{k}") for k, m in enumerate(measures.values())]).first()
    cells = []
    for k, m in enumerate(measures.values()):
        bounds = sorted(set(cuts[f"d{k}"] or []))
        cells.append(reduce(lambda a, b: a + b, [F.when(m > b, 1).otherwise(0) for b in bounds], F.lit(0)))

    @F.pandas_udf(T.LongType())
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return docs.withColumn(name, curve(*cells))


def write_shards(docs: DataFrame, folder: str, dimensions: list[str], *, id_col: str = "doc_id", shards: int = 24, bits: int = 4) -> DataFrame:
    """Write all rows under ``folder`` in ``shards`` runs of the curve order, counts at most one apart; reread them.

    Returns the input's columns and ``shard``, ``slot`` (its place in the shard, gapless from 0). Ties of the curve
    go by id, then by a hash of the whole row; equal rows are interchangeable, each still gets a place of its own.
    Nulls in a dimension count as lowest. An empty table gives no rows. Input columns named ``shard`` or ``slot`` are
    refused, all other names come back.
    """
    spark = docs.sparkSession
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns with names of the result: {sorted(clash)}")
    curve, place, part, before, total, rank = common.fresh_names(docs, "curve", "place", "part", "before", "total", "rank")
    own = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])
    keys = [F.col(curve).asc(), F.col(id_col).asc_nulls_first(), row.asc()]
    # rows of long texts lie together on the curve: runs are cut finer, so that theirs stay small in bytes too
    runs = with_curve_index(docs, dimensions, bits, name=curve).repartitionByRange(FINER * common.partitions(spark), *keys).sortWithinPartitions(*keys)
    sorted_rows, sorted_at = common.staged(runs.withColumn(place, F.monotonically_increasing_id()), "curve-runs")
    # place is (partition, row in it); one row a partition gives the rows before it
    counts = sorted_rows.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count("*").alias("n"))
    offsets = counts.select(part, (F.sum("n").over(W.orderBy(part)) - F.col("n")).alias(before), F.sum("n").over(W.partitionBy()).alias(total))
    placed = (
        sorted_rows.withColumn(part, F.shiftright(place, 33))
        .join(F.broadcast(offsets), part)
        .withColumn(rank, F.col(before) + F.col(place).bitwiseAND((1 << 33) - 1))
        # floor(rank * shards / total) in whole numbers, and the first rank of that shard
        .withColumn("shard", F.expr(f"({rank} * {shards}) div {total}"))
        .withColumn("slot", F.col(rank) - F.expr(f"(shard * {total} + {shards} - 1) div {shards}"))
        .withColumn("shard", F.col("shard").cast("int"))
    )
    placed.select(*own, "slot", "shard").write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    common.remove(spark, sorted_at)
    schema = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(folder)


def op4_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = write_shards(docs, common.fresh_path(spark, "shards"), ["lang", "source", "n_chars", "doc_id"])
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
