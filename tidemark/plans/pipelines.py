"""Whole pipelines as plans: frames to curves, neighbours to detections, curves to detections, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.operators import evaluate, knn, matching, series, tracks
from tidemark.schema import CURVES


def frame_curves(frames: DataFrame, smooth: int = 0) -> DataFrame:
    """The twelve curves of every frame, smoothed by a centred average when asked."""
    values = vectors.curves(F.col("features"))
    out = frames.where(F.size("features") > 0).select("category", "video", "pos", "ts", *[values[c].alias(c) for c in CURVES])
    return series.edge_moving_averages(out, ["category", "video"], {c: c for c in CURVES}, smooth) if smooth > 1 else out


def neighbours(tv: DataFrame, bank: DataFrame, k: int = 5, *, normalise: bool = False, batch: int | None = None) -> DataFrame:
    """(video, pos, ts, rank, clip, clip_pos, clip_ts, score). tv: video, pos, ts, features; bank likewise.

    Ties go to the earlier clip and frame: a frame's key is the pair itself. ``batch``: query vectors scored at once.
    """
    tv = tv.where(F.size("features") > 0).select(F.struct("video", "pos", "ts").alias("query_id"), F.col("features").alias("vector"))
    bank = bank.where(F.size("features") > 0).select(F.struct("video", "pos", "ts").alias("bank_id"), F.col("features").alias("vector"))
    near = knn.nearest(tv, bank, k, normalise=normalise, batch=batch)
    return near.select("query_id.video", "query_id.pos", "query_id.ts", "rank", F.col("bank_id.video").alias("clip"), F.col("bank_id.pos").alias("clip_pos"), F.col("bank_id.ts").alias("clip_ts"), "score")


def neighbour_detections(
    near: DataFrame,
    clips: DataFrame,
    curves: DataFrame | None = None,
    *,
    fps: float = 3.0,
    rates: DataFrame | None = None,
    window_sec: float = 1.0,
    score_threshold: float = 0.5,
    offset_tolerance: float = 1.0,
    min_gap: float = 0.0,
    curve: str = "combined_activity",
    curve_threshold: float = 1.5,
    constant_shift: bool = False,
    **limits,
) -> DataFrame:
    """The nearest-neighbour detector: gate, vote, threshold, tracks, coverage, min-gap deduplication.

    A video without curves passes the gate; a sample without a curve value in a video that has some does not.
    ``rates``: video, sampled_fps, as a manifest has them; a video without a row there has ``fps``.
    """
    frames = near.where("rank = 1")
    if curves is None:
        frames = frames.withColumn("gate", F.lit(None).cast("double"))
    else:
        gate = curves.select("video", "pos", F.col(curve).cast("double").alias("gate_value"))
        known = gate.select(F.col("video").alias("known_video")).distinct()
        frames = frames.join(gate, ["video", "pos"], "left").join(known, F.col("video") == F.col("known_video"), "left")
        frames = frames.withColumn("gate", F.when(F.col("known_video").isNotNull(), F.coalesce("gate_value", F.lit(float("-inf"))))).drop("gate_value", "known_video")
    width = F.lit(series.window_width(window_sec, fps))
    if rates is not None:
        known = rates.select(F.col("video").alias("rate_video"), F.col("sampled_fps").cast("double").alias("rate_fps"))
        frames = frames.join(known, F.col("video") == F.col("rate_video"), "left")
        width = series.width_column(window_sec, F.coalesce("rate_fps", F.lit(float(fps))))
    windows = tracks.vote_windows(frames, width)
    passing = tracks.passing_windows(windows, gate_threshold=curve_threshold if curves is not None else None, score_threshold=score_threshold)
    found = tracks.finalise(tracks.build_tracks(passing, offset_tolerance, constant_shift=constant_shift), clips, **limits)
    return tracks.min_gap(found, min_gap, ["video", "clip"]).select(F.col("video").alias("tv"), F.round("start", 3).alias("start"), F.round("length", 3).alias("length"), "clip", F.round("score", 4).alias("score"))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def curve_detections(
    curves: DataFrame, clips: DataFrame, *, curve: str = "combined_activity", fps: float = 3.0, smooth_window: int = 30, z_threshold: float = 2.5, min_peak_sec: float = 4.0, match_threshold: float = 0.6, scratch: str | None = None
) -> DataFrame:
    """The curve detector: standard scores, runs above a threshold, correlation of their peaks with whole clips.

    curves: category, video, pos, ts and the curve; clips: clip, duration, clip_order. ``scratch``: a new folder, shared by
    driver and executors, to which the scores are written once; without it every plan that reads them makes them anew.
    """
    z = series.standard_scores(curves.select("category", "video", "pos", "ts", F.col(curve).alias("x")), ["category", "video"], "x", smooth_window)
    if scratch is not None:
        z = written(z, scratch)
    tv = z.where("category = 'tv'")
    segments = series.active_segments(tv, ["video"], "z", z_threshold, max(int(min_peak_sec * fps), 1))
    bank = z.where("category = 'commercials'").select(F.col("video").alias("clip"), "pos", F.col("z").alias("x")).join(clips.select("clip", "clip_order"), "clip")
    best = matching.match_peaks(segments, tv.select("video", "pos", F.col("z").alias("x")), bank).where(F.col("score") >= match_threshold)
    at = tv.select("video", F.col("pos").alias("seg_start"), "ts")
    return best.join(at, ["video", "seg_start"]).join(clips.select("clip", "duration"), "clip").select(F.col("video").alias("tv"), F.round("ts", 3).alias("start"), F.round("duration", 3).alias("length"), "clip", F.round("score", 4).alias("score"))


def evaluation(detections: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, metrics at all thresholds, the best point."""
    labels = evaluate.label(detections, truth)
    metrics = evaluate.sweep(labels, evaluate.total_truth(truth, detections), detections)
    return labels, metrics, evaluate.best_point(metrics)
