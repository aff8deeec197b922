"""Votes over tumbling windows, and the two sequential folds: offset-consistent tracks and min-gap deduplication.

Rows that cannot belong together are separated first, by islands; the fold, a SQL ``aggregate`` over a sorted array,
then runs inside one island.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.series import tumbling


def vote_windows(frames: DataFrame, width: int | Column, video: str = "video") -> DataFrame:
    """One row a window of ``width`` samples, a number or a column that is the same in all of a video: the clip most voted for (the smaller name on a tie), its mean score
    and offset, the window's first time, last position and largest gate value.

    ``frames``: video, pos, ts, clip, clip_ts, score, gate (null: no gate curve).
    """
    f = frames.withColumn("win", tumbling(F.col("pos"), width))
    spans = f.groupBy(video, "win").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("ts", "pos").alias("t0"), F.max_by("ts", "pos").alias("t1"), F.max("gate").alias("gate"))
    votes = f.groupBy(video, "win", "clip").agg(F.count("*").alias("votes"), F.avg("score").alias("avg_score"), F.avg(F.col("ts") - F.col("clip_ts")).alias("avg_offset"))
    best = votes.withColumn("r", F.row_number().over(W.partitionBy(video, "win").orderBy(F.col("votes").desc(), F.col("clip").asc()))).where("r = 1").drop("r")
    return spans.join(best, [video, "win"])


def passing_windows(windows: DataFrame, *, gate_threshold: float | None, score_threshold: float) -> DataFrame:
    """Windows whose largest gate value and mean score reach their thresholds; no gate value passes, nor does NaN stop."""
    out = windows.where(~(F.col("avg_score") < score_threshold))
    if gate_threshold is not None:
        out = out.where(F.col("gate").isNull() | ~(F.col("gate") < gate_threshold))
    return out


def gate_counts(windows: DataFrame, *, gate_threshold: float, score_threshold: float) -> DataFrame:
    """One row: ``windows``, how many pass both thresholds (``passed``), how many the gate stops (``gated``)."""
    stopped = F.coalesce(F.col("gate") < gate_threshold, F.lit(False))
    return windows.agg(F.count("*").alias("windows"), F.count_if(~stopped & ~(F.col("avg_score") < score_threshold)).alias("passed"), F.count_if(stopped).alias("gated"))


TRACK = "array<struct<start_win:bigint,last_win:bigint,off:double,best:double,t0:double,t1:double,first_pos:bigint,last_pos:bigint>>"


def build_tracks(windows: DataFrame, tolerance: float, *, constant_shift: bool = False, video: str = "video") -> DataFrame:
    """Tracks of consecutive windows for one clip whose offset stays within ``tolerance`` of a running average.

    The offset is the estimated position inside the clip, t0 minus the mean offset; with ``constant_shift`` it is
    the mean offset itself. Each step halves the distance between the running value and the new one.
    """
    offset = F.col("avg_offset") if constant_shift else F.col("t0") - F.col("avg_offset")
    # one number for both kinds of break, a rejected window and another clip
    cut = windows.withColumn("o", offset).withColumn("island", F.col("win") - F.row_number().over(W.partitionBy(video, "clip").orderBy("win")))
    lists = cut.groupBy(video, "clip", "island").agg(F.array_sort(F.collect_list(F.struct("win", "o", "avg_score", "t0", "t1", F.col("first_pos").cast("long").alias("first_pos"), F.col("last_pos").cast("long").alias("last_pos")))).alias("steps"))
    fold = f"""inline(aggregate(steps, cast(array() as {TRACK}), (acc, x) ->
        case when size(acc) > 0 and abs(x.o - element_at(acc, -1).off) <= {float(tolerance)!r}D
             then concat(slice(acc, 1, size(acc) - 1), array(named_struct(
                    'start_win', element_at(acc, -1).start_win, 'last_win', x.win, 'off', 0.5D * (element_at(acc, -1).off + x.o),
                    'best', greatest(element_at(acc, -1).best, x.avg_score), 't0', element_at(acc, -1).t0, 't1', x.t1,
                    'first_pos', element_at(acc, -1).first_pos, 'last_pos', x.last_pos)))
             else concat(acc, array(named_struct('start_win', x.win, 'last_win', x.win, 'off', x.o, 'best', x.avg_score,
                    't0', x.t0, 't1', x.t1, 'first_pos', x.first_pos, 'last_pos', x.last_pos))) end))"""
    return lists.selectExpr(video, "clip", fold)


def finalise(
    tracks: DataFrame,
    clips: DataFrame,
    *,
    coverage: float = 0.6,
    coverage_short: float | None = None,
    coverage_long: float | None = None,
    min_frames: int = 3,
    min_frames_short: int | None = None,
    min_frames_long: int | None = None,
    duration_threshold: float = 20.0,
    video: str = "video",
) -> DataFrame:
    """Detections: tracks with enough samples and enough of their clip's duration.

    ``clips``: clip, duration. Clips up to ``duration_threshold`` are short and have limits of their own. A clip of
    unknown or zero duration counts by the observed length, from the first sample's time to the last one's. A detection starts where its track does and is as long
    as the whole clip.
    """
    t = tracks.join(clips.select("clip", F.col("duration").cast("double").alias("duration")), "clip", "left")
    frames = F.col("last_pos") - F.col("first_pos") + 1
    observed = F.greatest(F.col("t1") - F.col("t0"), F.lit(0.0))
    expected = F.when(F.coalesce(F.col("duration"), F.lit(0.0)) > 0, F.col("duration")).otherwise(observed)
    short = expected <= duration_threshold
    least = F.when(short, min_frames if min_frames_short is None else min_frames_short).otherwise(min_frames if min_frames_long is None else min_frames_long)
    ratio = F.when(short, coverage if coverage_short is None else coverage_short).otherwise(coverage if coverage_long is None else coverage_long)
    return t.where((frames >= least) & (observed >= expected * ratio)).select(video, F.col("t0").alias("start"), expected.alias("length"), "clip", F.col("best").alias("score"))


def min_gap(hits: DataFrame, gap: float, keys: list[str]) -> DataFrame:
    """Of hits of one key that start within ``gap`` of the last one kept, keep the better: a strictly higher score
    takes its place, and the comparison goes on from there. A gap of 0 or less keeps all. Columns: keys, start,
    length, score; ties in start go by length, then score."""
    if gap <= 0:
        return hits.select(*keys, "start", "length", "score")
    row = "struct<start:double,length:double,score:double>"
    hit = hits.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("start", "length", "score")])
    # a hit that begins ``gap`` or more behind the one before it is that far from any hit kept: the fold begins anew
    # there, so it runs inside such islands
    order = W.partitionBy(*keys).orderBy("start", "length", "score")
    cut = hit.withColumn("far", F.coalesce(F.col("start") - F.lag("start").over(order) >= gap, F.lit(True)))
    cut = cut.withColumn("island", F.sum(F.col("far").cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    lists = cut.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("start", "length", "score"))).alias("hits"))
    fold = f"""inline(aggregate(slice(hits, 2, size(hits)), named_struct('done', cast(array() as array<{row}>), 'last', hits[0]), (acc, x) ->
        case when x.start - acc.last.start < {float(gap)!r}D
             then named_struct('done', acc.done, 'last', case when x.score > acc.last.score then x else acc.last end)
             else named_struct('done', concat(acc.done, array(acc.last)), 'last', x) end,
        acc -> concat(acc.done, array(acc.last))))"""
    return lists.selectExpr(*keys, fold)
