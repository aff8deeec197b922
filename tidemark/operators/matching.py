"""Peaks of one series matched against whole clips by correlation of a clamped slice.

Clips of one length meet slices of that length as matrices in single precision, tile by tile; what may be the best
within its error is then multiplied out in double precision. Where means over a few parts of slices and clips bound most
correlations below the best, they take the matrix's place, and where a long series has many peaks, Fourier transforms do.
Equal clips are one clip. A slice that has found its like needs only clips that are as good as equal and come earlier;
those lie side by side in the order of one projection.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of clips that a task holds, and of slices that it makes at once; it holds a quarter as many of series.
BLOCK_BYTES = 64 << 20
#: Samples of a series in one piece, beside the longest clip's on either side; parts of a slice for the bound.
PIECE, PARTS = 1 << 16, 8
#: Digits of scores that count for a tie; what rounding may do to a bound.
DIGITS, SLACK = 10, 1e-9
#: Clips and pairs in one tile; pairs that wait for double precision; a bound that leaves more pairs is no help.
TILE_CLIPS, TILE, WAITING, LEFT = 1 << 10, 1 << 19, 1 << 20, 1 / 256
#: Unit vectors whose product rounds to 1 are no further apart.
ALIKE = 1.1 * math.sqrt(10.0**-DIGITS)

def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = column.combine_chunks()
    size = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False), np.cumsum(size) - size, size


class Slices:
    """Slices of one length of pieces of series, known by their places: no slice is built but for a product."""

    def __init__(self, x: np.ndarray, size: np.ndarray):
        ends = np.cumsum(size)
        totals = np.concatenate([[0.0], np.cumsum(x)])
        self.x = x - np.repeat((totals[ends] - totals[ends - size]) / np.maximum(size, 1), size)  # each piece by itself
        self.sums = np.concatenate([[0.0], np.cumsum(self.x)])
        self.squares = np.concatenate([[0.0], np.cumsum(self.x * self.x)])

    def moments(self, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and centred length of the slices that begin at ``at``."""
        mean = (self.sums[at + m] - self.sums[at]) / m
        spread = self.squares[at + m] - self.squares[at] - m * mean * mean
        # where most of the sums cancels, from the slice itself
        for k in np.flatnonzero(spread < 1e-7 * np.maximum(1.0, self.squares[-1])):
            own = self.x[at[k] : at[k] + m]
            mean[k] = own.mean()
            spread[k] = ((own - mean[k]) ** 2).sum()
        return mean, np.sqrt(np.maximum(spread, 0.0))

    def parts(self, at: np.ndarray, m: int, mean: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Coefficients of centred unit slices on the means of ``PARTS`` parts, an orthonormal family."""
        edges = np.unique(np.linspace(0, m, PARTS + 1).round().astype(int))
        width = np.diff(edges)
        sums = np.diff(self.sums[at[:, None] + edges], axis=1)
        return (sums - mean[:, None] * width) / np.sqrt(width) / length[:, None]


def _rest(coefficients: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1.0 - (coefficients * coefficients).sum(axis=1), 0.0))


class Bank:
    """Clips of one length m, in order: centred and of unit length, or even. ``at``: which of all clips they are."""

    def __init__(self, clips: np.ndarray, rank: np.ndarray, at: np.ndarray, least: float):
        order = np.argsort(rank, kind="stable")
        clips, rank, at = clips[order] - clips[order].mean(axis=1, keepdims=True), rank[order], at[order]
        length = np.sqrt((clips * clips).sum(axis=1))
        self.m, self.first = clips.shape[1], (rank[0], at[0])
        even = np.flatnonzero(length < least)
        self.even = (rank[even[0]], at[even[0]]) if len(even) else None
        some = np.flatnonzero(length >= least)
        self.unit = clips[some] / length[some, None]
        if self.m < PARTS:  # short clips differ in little but scale
            once = np.sort(np.unique(self.unit, axis=0, return_index=True)[1])
            self.unit, some = self.unit[once], some[once]
        self.rank, self.at, self.single = rank[some], at[some], self.unit.astype(np.float32)
        edges = np.unique(np.linspace(0, self.m, PARTS + 1).round().astype(int))
        parts = np.add.reduceat(self.unit, edges[:-1], axis=1) / np.sqrt(np.diff(edges))
        self.parts = np.column_stack([parts, _rest(parts)]).astype(np.float32)
        self.line = np.random.default_rng(self.m).normal(size=self.m)
        self.line /= np.linalg.norm(self.line)
        on_line = self.unit @ self.line
        self.along = np.argsort(on_line)
        self.on_line = on_line[self.along]
        #: what single precision may do to a product, or a bound, of unit vectors
        self.error = (self.m + PARTS) * 2.0**-23 + SLACK


def _centred(s: Slices, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    own = s.x[at[:, None] + np.arange(m)]
    own -= own.mean(axis=1, keepdims=True)
    return own, np.sqrt(np.einsum("ij,ij->i", own, own))


class Found:
    """The best clip of each slice so far, by score and then order, or a score that an earlier order must reach."""

    def __init__(self, score: np.ndarray, rank: np.ndarray):
        self.score, self.rank, self.at = score, rank, np.full(len(score), -1, dtype=np.int64)

    def offer(self, rows: np.ndarray, score: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """``rows`` are distinct."""
        better = (score > self.score[rows]) | (score == self.score[rows]) & (rank < self.rank[rows])
        rows = rows[better]
        self.score[rows], self.rank[rows], self.at[rows] = score[better], rank[better], at[better]


def _settle(s: Slices, at: np.ndarray, bank: Bank, found: Found, row: np.ndarray, column: np.ndarray) -> None:
    """Scores of pairs of slices and clips in double precision."""
    step = max(1, BLOCK_BYTES // 8 // bank.m)
    score = np.empty(len(row))
    for k in range(0, len(row), step):
        own, length = _centred(s, at[row[k : k + step]], bank.m)
        score[k : k + step] = np.einsum("ij,ij->i", own, bank.unit[column[k : k + step]]) / length
    score = score.round(DIGITS)
    order = np.lexsort((bank.rank[column], -score, row))
    order = order[np.r_[True, np.diff(row[order]) > 0]] if len(order) else order
    found.offer(row[order], score[order], bank.rank[column[order]], bank.at[column[order]])


def _alike(s: Slices, at: np.ndarray, bank: Bank, found: Found, rows: np.ndarray, place: np.ndarray) -> None:
    """Earlier clips for slices that have found a score of 1: those near their places on a line."""
    low, high = np.searchsorted(bank.on_line, place - ALIKE), np.searchsorted(bank.on_line, place + ALIKE, side="right")
    ends = np.cumsum(high - low)
    k = 0
    while k < len(rows):
        before = ends[k - 1] if k else 0
        to = max(k + 1, int(np.searchsorted(ends, before + WAITING, side="right")))
        count = (high - low)[k:to]
        row = np.repeat(np.arange(k, to), count)
        column = bank.along[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[k:to], count)]
        earlier = bank.rank[column] < found.rank[rows[row]]
        _settle(s, at, bank, found, rows[row[earlier]], column[earlier])
        k = to


def _tiles(s: Slices, at: np.ndarray, bank: Bank, found: Found, rows: np.ndarray, products, bounds) -> None:
    """``products`` and ``bounds``: of some of ``rows`` with a range of clips. Pairs that may be the best are settled."""
    reached = found.score[rows].astype(np.float32)
    waiting, count, retry = [], 0, 1

    def settle() -> None:
        nonlocal waiting, count
        row, column, about = (np.concatenate(c) for c in zip(*waiting, strict=True))
        still = about >= reached[row] - 2 * bank.error
        _settle(s, at, bank, found, rows[row[still]], column[still])
        reached[:] = np.maximum(reached, found.score[rows].astype(np.float32))
        waiting, count = [], 0

    for tile, k in enumerate(range(0, len(bank.rank), TILE_CLIPS)):
        # a score of 1 gives way only to an earlier clip
        open_ = np.flatnonzero((found.score[rows] < 1.0) | (found.rank[rows] > bank.rank[k]))
        if not len(open_):
            break
        if bounds is not None and tile >= retry:
            over = bounds(open_, k) >= reached[open_, None] - 2 * bank.error
            if np.count_nonzero(over) <= LEFT * over.size:
                row, column = np.nonzero(over)
                waiting.append((open_[row], column + k, np.full(len(row), np.inf, dtype=np.float32)))
                count += len(row)
                if count > WAITING:
                    settle()
                continue
            retry = tile + 16
        about = products(open_, k)
        top = about.max(axis=1)
        hit = np.flatnonzero(top >= reached[open_] - 2 * bank.error)
        reached[open_[hit]] = np.maximum(reached[open_[hit]], top[hit])
        if len(hit):
            row, column = np.nonzero(about[hit] >= reached[open_[hit], None] - 2 * bank.error)
            waiting.append((open_[hit[row]], column + k, about[hit[row], column]))
            count += len(row)
            if count > WAITING or top.max() >= 1.0 - 2 * bank.error:
                settle()
    if waiting:
        settle()


def _match_length(s: Slices, at: np.ndarray, piece: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], bank: Bank, found: Found, least: float) -> None:
    """Slices that begin at ``at``, in order, in the pieces ``piece``, against the clips of one length."""
    m = bank.m

    def even(rows: np.ndarray, length: np.ndarray) -> None:
        for clip, some in ((bank.first, rows[length < least]), (bank.even, rows[length >= least])):
            if clip is not None and len(some):
                found.offer(some, np.zeros(len(some)), np.full(len(some), clip[0]), np.full(len(some), clip[1]))

    often = np.zeros(len(at), dtype=bool)
    pieces, count = np.unique(piece, return_counts=True)
    least_n = bounds[1][pieces] - bounds[0][pieces] + m
    some = count * m > 2 * least_n * np.log2(least_n)
    for p, n_rows in zip(pieces[some].tolist(), count[some].tolist(), strict=True):
        low, high = (int(b[p]) for b in bounds)
        n = 1 << (high - low + m).bit_length()
        if n_rows * m <= 2 * n * math.log2(n):
            continue
        own = np.flatnonzero(piece == p)  # all places of the piece at once
        often[own] = True
        series = np.fft.rfft(s.x[low:high], n)
        length = s.moments(at[own], m)[1]
        even(own, length)
        rows = own[length >= least]
        step = max(1, BLOCK_BYTES // 8 // TILE_CLIPS)
        for k in range(0, len(rows), step):
            r, size = rows[k : k + step], length[length >= least][k : k + step]

            def transformed(some, c, r=r, size=size, series=series, n=n, low=low):
                clips = bank.unit[c : c + TILE_CLIPS]
                out = np.empty((len(some), len(clips)), dtype=np.float32)
                for j, clip in enumerate(clips):
                    out[:, j] = np.fft.irfft(series * np.conj(np.fft.rfft(clip, n)), n)[at[r[some]] - low] / size[some]
                return out

            _tiles(s, at, bank, found, r, transformed, None)
    others = np.flatnonzero(~often)
    step = max(1, min(TILE // min(TILE_CLIPS, max(1, len(bank.rank))), BLOCK_BYTES // 8 // m))
    for k in range(0, len(others), step):
        rows = others[k : k + step]
        own, length = _centred(s, at[rows], m)
        even(rows, length)
        full = (found.score[rows] >= 1.0) & (length >= least)
        _alike(s, at, bank, found, rows[full], (own @ bank.line)[full] / length[full])
        some = ~full & (length >= least)
        if not some.any():
            continue
        rows, own = rows[some], own[some] / length[some, None]
        single = own.astype(np.float32)
        edges = np.unique(np.linspace(0, m, PARTS + 1).round().astype(int))
        parts = np.add.reduceat(own, edges[:-1], axis=1) / np.sqrt(np.diff(edges))
        parts = np.column_stack([parts, _rest(parts)]).astype(np.float32)
        _tiles(s, at, bank, found, rows, lambda some, c, a=single: a[some] @ bank.single[c : c + TILE_CLIPS].T, (lambda some, c, a=parts: a[some] @ bank.parts[c : c + TILE_CLIPS].T) if m > 2 * PARTS else None)


def _matcher(least: float, names: list[pa.DataType]):
    shape = pa.schema([("video", names[0]), ("seg_start", pa.int64()), ("peak_pos", pa.int64()), ("clip", names[1]), ("clip_order", pa.int64()), ("score", pa.float64())])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        x, x_at, x_size = _ragged(left.column("x"))
        slices = Slices(x, x_size)
        peaks = left.column("peaks").combine_chunks()
        owner = np.repeat(np.arange(len(x_at)), peaks.value_lengths().to_numpy(zero_copy_only=False))
        seg, peak = (peaks.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        low, total = left.column("low").to_numpy(), left.column("n").to_numpy()
        y, y_at, y_size = _ragged(right.column("x"))
        rank = right.column("clip_order").to_numpy()
        # a series that is a clip reaches 1 with it, in whichever task that clip is; it, or an earlier one, has to come
        own_rank = left.column("own_order").to_numpy(zero_copy_only=False).astype(np.float64)
        raw, centred = np.add.reduceat(x * x, x_at), np.add.reduceat(slices.x * slices.x, x_at)
        known = ~np.isnan(own_rank) & (centred > 4 * least * least) & (centred > 1e-8 * raw)
        best_rank = np.zeros(len(x_at), dtype=np.int64)
        best_rank[known] = left.column("own_order").combine_chunks().filter(pa.array(known)).to_numpy() + 1
        best = Found(np.where(known, 1.0, -np.inf)[owner], best_rank[owner])
        bounds = x_at, x_at + x_size
        for m in np.unique(y_size[y_size > 0]).tolist():
            of_m = np.flatnonzero(y_size == m)
            able = np.flatnonzero(total[owner] >= m)
            if not len(able):
                continue
            bank = Bank(y[y_at[of_m][:, None] + np.arange(m)], rank[of_m], of_m, least)
            begin = x_at[owner[able]] + np.maximum(0, np.minimum(peak[able] - m // 2, total[owner[able]] - m)) - low[owner[able]]
            # peaks that share a slice: it has to reach what the least of them has
            order = np.lexsort((-best.rank[able], best.score[able], begin))
            lead = np.r_[True, np.diff(begin[order]) > 0]
            first = able[order[lead]]
            found = Found(best.score[first].copy(), best.rank[first].copy())
            _match_length(slices, begin[order[lead]], owner[first], bounds, bank, found, least)
            of = np.cumsum(lead) - 1
            new = found.at[of] >= 0
            best.offer(able[order[new]], found.score[of[new]], found.rank[of[new]], found.at[of[new]])
        done = np.flatnonzero(best.at >= 0)
        return pa.table([left.column("video").take(pa.array(owner[done])), pa.array(seg[done]), pa.array(peak[done]), right.column("clip").take(pa.array(best.at[done])), pa.array(best.rank[done]), pa.array(best.score[done])], schema=shape)

    return match


def match_peaks(segments: DataFrame, series: DataFrame, clips: DataFrame, *, least: float = 1e-6, piece: int = PIECE) -> DataFrame:
    """(video, seg_start, peak_pos, clip, score) of every peak's best clip, the first in ``clip_order`` on a tie.

    segments: video, seg_start, peak_pos. series: video, pos (0, 1, 2, ...), x. clips: clip, clip_order (whole numbers), pos,
    x. A slice as long as the clip is centred on the peak and kept inside the series; the score is the correlation, 0 if
    either side is constant. A clip longer than the series is no candidate; neither is an empty one. Null videos and
    clips, and series or clips with a null or NaN, match nothing there.

    Series are cut into pieces, which overlap by the longest clip, so that a long one is no single row; blocks of pieces
    meet blocks of clips. Of equal clips only the first takes part.
    """
    spark = segments.sparkSession
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x").cast("double").alias("x")))), lambda s: s["x"])
    right = clips.where("clip is not null").groupBy("clip", F.col("clip_order").cast("long").alias("clip_order")).agg(values.alias("x"))
    right = right.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    right = right.groupBy("x").agg(F.min(F.struct("clip_order", "clip")).alias("c")).select("x", "c.clip_order", "c.clip")
    sizes = clips.where("clip is not null").groupBy("clip", "clip_order").agg(F.count("*").alias("m"))
    points = series.agg(F.count("*").alias("n")).crossJoin(sizes.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.max("m"), F.lit(0)).alias("longest"))).first()
    size = max(piece, points["longest"])
    at = F.floor(F.col("pos") / size)
    near = F.array(at, F.when(F.col("pos") % size >= size - points["longest"], at + 1), F.when(F.col("pos") % size < points["longest"], at - 1))
    whole = series.where("video is not null").select("video", F.col("pos").cast("long").alias("pos"), "x")
    pieces = whole.withColumn("piece", F.explode(F.filter(near, lambda k: k.isNotNull()))).groupBy("video", "piece").agg(values.alias("x"), F.min("pos").alias("low"))
    lengths = whole.groupBy("video").agg(F.count("*").alias("n"))
    peaks = segments.groupBy("video", F.floor(F.col("peak_pos") / size).alias("piece")).agg(F.collect_list(F.struct(F.col("seg_start").cast("long").alias("seg_start"), F.col("peak_pos").cast("long").alias("peak"))).alias("peaks"))
    left = pieces.join(peaks, ["video", "piece"]).join(lengths, "video")
    left = left.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    left = left.join(right.select("x", F.col("clip_order").alias("own_order"), F.lit(0).cast("long").alias("low"), F.size("x").cast("long").alias("n")), ["x", "low", "n"], "left")
    clip_blocks = max(1, math.ceil(points["m"] * 8 / BLOCK_BYTES))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # every block of series has a copy of all clips: enough of them for all cores, not for all partitions
    cores = min(tasks, 2 * spark.sparkContext.defaultParallelism)
    series_blocks = max(1, math.ceil(points["n"] * 32 / BLOCK_BYTES), math.ceil(cores / clip_blocks))

    def dealt(df: DataFrame, by: list[str], blocks: int, others: int, own: str, other: str) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    a = dealt(left, ["video", "piece"], series_blocks, clip_blocks, "block_s", "block_c").select("block_s", "block_c", "video", "low", "n", "x", "own_order", "peaks").groupBy("block_s", "block_c")
    b = dealt(right, ["clip"], clip_blocks, series_blocks, "block_c", "block_s").select("block_s", "block_c", "x", "clip", "clip_order").groupBy("block_s", "block_c")
    names = [series.select("video"), clips.select("clip")]
    kinds = [n.schema[0].dataType.simpleString() for n in names]
    arrow = [n.limit(0).toArrow().schema.field(0).type for n in names]
    scores = a.cogroup(b).applyInArrow(_matcher(least, arrow), f"video {kinds[0]}, seg_start long, peak_pos long, clip {kinds[1]}, clip_order long, score double")
    best = F.max_by(F.struct("peak_pos", "clip", "score"), F.struct(F.col("score"), -F.col("clip_order"))).alias("b")
    return scores.groupBy("video", "seg_start").agg(best).select("video", "seg_start", "b.peak_pos", "b.clip", "b.score")
