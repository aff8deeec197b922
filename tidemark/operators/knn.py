"""Exact k nearest neighbours by dot product, over a bank cut into clusters that bounds can rule out.

Centres are fitted on a bounded sample of the bank; every bank vector goes to its nearest centre, and each cluster keeps
its size and radius. For a query the k-th best score within the sample is a lower bound of its k-th best score, and
q . c + |q| r an upper bound of all scores in a cluster: a query is sent only to blocks with clusters that may matter,
and meets only those there. Candidates of all blocks meet in a top-k per query. What reaches the driver is the
sample, a row a cluster, and counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vectors

#: Bytes of vectors of either side that a task holds, and of the scores it makes at once.
BLOCK_BYTES = 64 << 20
#: Most vectors in the sample of the bank, which is a sixteenth of a smaller bank, and most clusters.
SAMPLE, CLUSTERS = 8192, 256
#: What rounding may do to a bound, in parts of the product of lengths.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(whole), -1)


def _centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Means of groups of the sample; which vectors they are decides about speed only."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        own = _nearest_centre(sample, centres)[0]
        centres = np.array([sample[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(n)])
    return centres


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre and the distance to it, the latter from differences, without cancellation."""
    own = (x @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(axis=1))


def _assigner(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = _nearest_centre(_matrix(batch.column(1)), centres) if len(batch) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cluster", "far"])

    return run


def _bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries in clusters, rounding allowed for."""
    size = np.sqrt((q * q).sum(axis=1))[:, None]
    return q @ centres.T + size * radius * (1 + SLACK) + SLACK * size * np.sqrt((centres * centres).sum(axis=1))


def _router(k: int, sample: np.ndarray, centres: np.ndarray, radius: np.ndarray, counts: np.ndarray, blocks: list[np.ndarray]):
    """Adds to queries ``least`` (what the k-th score reaches at least), the blocks to go to, and the pairs to score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch.column(1))
            least = np.full(len(q), -np.inf)
            if len(sample) >= k:
                scores = q @ sample.T
                least = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]
            able = _bounds(q, centres, radius) >= least[:, None]
            to = np.stack([able[:, own].any(axis=1) for own in blocks], axis=1)
            row, block = np.nonzero(to)
            ends = np.searchsorted(row, np.arange(len(q) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(block.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), lists, pa.array((able * counts).sum(axis=1).astype(np.int64))], names=[*batch.schema.names, "least", "blocks", "pairs"])

    return run


def _scorer(k: int, centres: np.ndarray, radius: np.ndarray, batch: int | None, names: list[str], types: list[pa.DataType]):
    shape = pa.schema([*zip(names, types), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        q, bank = _matrix(left.column("q")), _matrix(right.column("b"))
        cluster = right.column("cluster").to_numpy()
        # rows in the order of their keys, which settles ties, and then by cluster
        keys = pa.table({str(i): c for i, c in enumerate(pa.table({"key": right.column(names[1])}).flatten().columns)})
        order = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names]).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        present = np.unique(cluster)
        able = _bounds(q, centres[present], radius[present])
        step, parts = max(1, min(batch or len(q), BLOCK_BYTES // 8 // len(bank))), []
        for at in range(0, len(q), step):
            rows = np.arange(at, min(at + step, len(q)))
            least = left.column("least").to_numpy()[rows].copy()
            best_score, best_rank = np.full((len(rows), k), -np.inf), np.full((len(rows), k), np.iinfo(np.int64).max)
            # clusters that promise most come first, as they raise what the others have to reach
            for c in np.argsort(-able[rows].max(axis=0), kind="stable"):
                on = np.flatnonzero(able[rows, c] >= least)
                if not len(on):
                    continue
                own = np.flatnonzero(cluster == present[c])
                own = own[np.argsort(rank[own])]
                scores = q[rows[on]] @ bank[own].T
                kept = min(k, len(own))
                bound = np.partition(scores, scores.shape[1] - kept, axis=1)[:, scores.shape[1] - kept]
                # all that reach the k-th score of the cluster, cut to k in the order of keys
                r, col = np.nonzero(scores >= bound[:, None])
                by = np.lexsort((col, -scores[r, col], r))
                r, col = r[by], col[by]
                place = np.arange(len(r)) - np.searchsorted(r, np.arange(len(on)))[r]
                r, col, place = r[place < kept], col[place < kept], place[place < kept]
                new_score, new_rank = np.full((len(on), kept), -np.inf), np.full((len(on), kept), np.iinfo(np.int64).max)
                new_score[r, place], new_rank[r, place] = scores[r, col], rank[own[col]]
                both_score, both_rank = np.hstack([best_score[on], new_score]), np.hstack([best_rank[on], new_rank])
                by = np.lexsort((both_rank, -both_score), axis=1)[:, :k]
                best_score[on], best_rank[on] = np.take_along_axis(both_score, by, axis=1), np.take_along_axis(both_rank, by, axis=1)
                least[on] = np.maximum(least[on], best_score[on, -1])
            r, place = np.nonzero(best_rank < np.iinfo(np.int64).max)
            parts.append((rows[r], order[best_rank[r, place]], best_score[r, place]))
        row, col, found = (np.concatenate(c) for c in zip(*parts))
        return pa.table([left.column(names[0]).take(pa.array(row)).cast(types[0]), right.column(names[1]).take(pa.array(col)).cast(types[1]), pa.array(found)], schema=shape)

    return score


def nearest(
    queries: DataFrame, bank: DataFrame, k: int = 5, *, normalise: bool = False, query: str = "query_id", key: str = "bank_id", vector: str = "vector", block_bytes: int = BLOCK_BYTES, batch: int | None = None, report: list | None = None
) -> DataFrame:
    """(query, bank, score, rank): the k largest dot products, ties to the smaller bank key; fewer if the bank is.

    Keys are whole numbers, strings or structs of such; vectors have one length, other tables are refused. Rows without
    a vector or with a component that is NaN or infinite are left out. ``normalise``: unit vectors, so cosines.
    ``batch``: query vectors scored at once. ``report``: a list that gets (pairs to score, all pairs), at the cost of
    planning the queries once more.
    """
    if normalise:
        queries, bank = (df.withColumn(vector, vectors.normalised(F.col(vector))) for df in (queries, bank))
    finite = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    as_double = F.col(vector).cast("array<double>")
    q = queries.where(finite).select(F.col(query).alias("query"), as_double.alias("q"))
    b = bank.where(finite).select(F.col(key).alias("key"), as_double.alias("b"))
    spark = queries.sparkSession
    size = lambda df, c, n: df.agg(F.count("*").alias(f"n{n}"), F.min(F.size(c)).alias(f"low{n}"), F.max(F.size(c)).alias(f"high{n}"))
    sizes = size(q, "q", "q").crossJoin(size(b, "b", "b")).first()
    widths = {sizes[c] for c in ("lowq", "highq", "lowb", "highb")} - {None}
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(widths)}")
    width, nq, nb = max(widths, default=1) or 1, sizes["nq"], sizes["nb"]
    wanted = max(1, min(SAMPLE, block_bytes // (8 * width), max(4 * k, nb // 16)))
    sample = np.array([r["b"] for r in b.orderBy(F.xxhash64("key")).limit(wanted).select("b").collect()], dtype=np.float64).reshape(-1, width)
    centres = _centres(sample, max(1, min(CLUSTERS, math.isqrt(4 * len(sample))))) if len(sample) else np.zeros((1, width))

    kinds = [queries.schema[query].dataType.simpleString(), bank.schema[key].dataType.simpleString()]
    own = b.mapInArrow(_assigner(centres), f"key {kinds[1]}, b array<double>, cluster int, far double")
    stats = {r["cluster"]: r for r in own.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row a cluster
    counts = np.array([stats[c]["n"] if c in stats else 0 for c in range(len(centres))])
    radius = np.array([stats[c]["far"] if c in stats else -np.inf for c in range(len(centres))])
    # whole clusters share a block, and large ones have several
    most = max(1, block_bytes // (8 * width))
    blocks: list[list[int]] = []
    first, pieces, room = [0] * len(centres), [1] * len(centres), 0
    for c, n in enumerate(counts.tolist()):
        pieces[c] = max(1, math.ceil(n / most))
        if pieces[c] > 1:
            first[c] = len(blocks)
            blocks += [[c] for _ in range(pieces[c])]
            room = 0
        else:
            if n > room:
                blocks.append([])
                room = most
            first[c] = max(0, len(blocks) - 1)
            if n:
                blocks[-1].append(c)
                room -= n
    blocks = blocks or [[0]]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    query_blocks = max(1, math.ceil(nq / most), min(tasks // len(blocks), math.ceil(nq * width * 8 / 65536)))
    safe_radius = np.where(np.isfinite(radius), radius, 0.0)
    routed = q.mapInArrow(_router(k, sample, centres, safe_radius, counts, [np.array(x or [0]) for x in blocks]), f"query {kinds[0]}, q array<double>, least double, blocks array<int>, pairs long")
    if report is not None:
        report.append((routed.agg(F.sum("pairs")).first()[0] or 0, nq * nb))
    at = F.element_at(F.lit(first).cast("array<int>"), F.col("cluster") + 1) + F.pmod(F.xxhash64("key"), F.element_at(F.lit(pieces).cast("array<int>"), F.col("cluster") + 1)).cast("int")
    left = routed.select("query", "q", "least", F.explode("blocks").alias("block_b"), F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("block_q"))
    right = own.select("key", "b", "cluster", at.alias("block_b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block_q"))
    arrow = [spark.createDataFrame([], f"c {kind}").toArrow().schema.field(0).type for kind in kinds]
    near = left.groupBy("block_q", "block_b").cogroup(right.groupBy("block_q", "block_b")).applyInArrow(_scorer(k, centres, safe_radius, batch, ["query", "key"], arrow), f"query {kinds[0]}, key {kinds[1]}, score double")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("key").asc())
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").alias(query), F.col("key").alias(key), "score", "rank")
