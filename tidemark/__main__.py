"""The stages from a shell: python -m tidemark STAGE ... ; tables are parquet folders, interval files tab-separated."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import scalars
from tidemark.operators import evaluate, topology
from tidemark.plans import pipelines
from tidemark.sources import tables, video


def _switch(p: argparse.ArgumentParser, *names: str) -> None:
    for n in names:
        p.add_argument(f"--{n}", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    stages = top.add_subparsers(dest="stage", required=True)

    p = stages.add_parser("preprocess", help="videos to frame vectors and a manifest")
    p.add_argument("--tv_dir", required=True)
    p.add_argument("--commercials_dir", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--decoder", default="tidemark.sources.video:opencv_decoder", help="module:function of a path")
    p.add_argument("--sample_fps", type=float, default=3.0)
    p.add_argument("--grid_size", type=int, default=48)
    p.add_argument("--min_persistence", type=float, default=0.005)
    _switch(p, "overwrite")

    p = stages.add_parser("curves", help="frame vectors to twelve curves")
    p.add_argument("--input_dir", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--smooth_window", type=int, default=0)
    _switch(p, "overwrite")

    p = stages.add_parser("knn", help="frame vectors to nearest neighbours in the clips")
    p.add_argument("--input_dir", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--batch_size", type=int, help="query vectors that one task holds at once")
    _switch(p, "normalize", "overwrite")

    p = stages.add_parser("detect_curves", help="curves to detections")
    p.add_argument("--curves_dir", required=True)
    p.add_argument("--preproc_manifest", required=True)
    p.add_argument("--output", required=True)
    for name, default in (("smooth_window", 30), ("z_threshold", 2.5), ("min_peak_sec", 4.0), ("match_threshold", 0.6)):
        p.add_argument(f"--{name}", type=type(default), default=default)

    p = stages.add_parser("detect_knn", help="neighbours to detections")
    p.add_argument("--knn_dir", required=True)
    p.add_argument("--manifest", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--curve_dir")
    defaults = (("score_threshold", 0.5), ("offset_tolerance", 1.0), ("coverage_ratio", 0.6), ("min_gap", 0.0), ("min_frames", 3), ("duration_threshold", 20.0), ("window_sec", 1.0), ("curve_threshold", 1.5))
    for name, default in defaults:
        p.add_argument(f"--{name}", type=type(default), default=default)
    for name, kind in (("coverage_ratio_short", float), ("coverage_ratio_long", float), ("min_frames_short", int), ("min_frames_long", int)):
        p.add_argument(f"--{name}", type=kind)
    _switch(p, "include_score")

    p = stages.add_parser("evaluate", help="detections against ground truth")
    p.add_argument("detections")
    p.add_argument("truth")
    return top


def _clips(manifest: DataFrame) -> DataFrame:
    """(clip, duration, clip_order) of a manifest's clips, ordered by their paths."""
    known = tables.latest(manifest.where("category = 'commercials'")).select(F.col("video").alias("clip"), F.col("duration_sec").alias("duration"), "source_path")
    return known.withColumn("clip_order", F.expr("row_number() over (order by source_path)")).drop("source_path")  # one row a clip


def preprocess(spark: SparkSession, a: argparse.Namespace) -> None:
    out, staged = f"{a.output_dir}/frames", f"{a.output_dir}/.frames-{uuid.uuid4().hex}"
    found = [tables.videos_in(spark, folder, category).withColumn("path", F.regexp_replace("path", "^file:/*", "/")) for category, folder in (("tv", a.tv_dir), ("commercials", a.commercials_dir))]
    videos = found[0].unionByName(found[1])
    if not a.overwrite:
        videos = tables.missing(videos, _written(spark, out, "category", "video"), ["category", "video"])
    frames = video.sampled_frames(videos, decoder=a.decoder, fps=a.sample_fps, grid=a.grid_size)
    features = topology.frame_vectors(topology.with_diagrams(frames, grid=a.grid_size), least=a.min_persistence)
    features.withColumn("readable", F.col("pixels").isNotNull()).drop("pixels", "cells", "height", "width").write.parquet(staged)
    rows = video.until_unreadable(spark.read.parquet(staged)).drop("video").join(videos.select("path", "category", "video"), "path")
    if not rows.isEmpty():
        tables.write_partitioned(rows.drop("path"), out)
        per = rows.groupBy("category", "video", F.col("path").alias("source_path")).agg(F.count("*").alias("num_frames"), F.max("native_fps").alias("native_fps"), F.max("total_frames").alias("total"), F.max(F.size("features")).cast("long").alias("feature_dim"))
        per = per.withColumns({
            "output_path": F.concat(F.lit("frames/category="), "category", F.lit("/video="), "video"), "sampled_fps": F.lit(a.sample_fps),
            "duration_sec": scalars.duration(F.col("total"), F.col("native_fps")), "sample_stride_frames": scalars.stride(F.col("native_fps"), F.lit(a.sample_fps)),
        })
        tables.merge_manifest(per.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.VIDEOS]), f"{a.output_dir}/manifest")
    tables.remove(spark, staged)


def _written(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """The folders of a partitioned table that are there, one row each."""
    if not tables.exists(spark, out):
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in keys))
    return spark.read.parquet(out).select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct()


def curves(spark: SparkSession, a: argparse.Namespace) -> None:
    frames = tables.read_frames(spark, f"{a.input_dir}/frames")
    if not a.overwrite:
        frames = tables.missing(frames, _written(spark, a.output_dir, "category", "video"), ["category", "video"])
    made = pipelines.frame_curves(frames, a.smooth_window)
    done = frames.where(F.size("features") > 0).groupBy("category", "video").agg(F.count("*").alias("frames"))
    entries = done.select("category", F.concat(F.lit(f"{a.input_dir}/frames/"), "category", F.lit("/"), "video", F.lit(".parquet")).alias("source_path"), F.concat(F.lit("category="), "category", F.lit("/video="), "video").alias("output_path"), "frames").collect()  # a row a video
    if entries:
        tables.write_partitioned(made, a.output_dir)
        _entered(spark, entries, schema.CURVE_FILES, a.output_dir, "source_path")
    _unmatched(spark, a)


def _entered(spark: SparkSession, entries: list, kind, folder: str, by: str) -> None:
    tables.merge_manifest(spark.createDataFrame([tuple(r[n] for n in kind.names) for r in entries], kind), tables.manifest_of(folder), kind, by)


def _unmatched(spark: SparkSession, a: argparse.Namespace) -> None:
    """A warning for each video with curves that the manifest of videos does not know."""
    if tables.exists(spark, f"{a.input_dir}/manifest"):
        known = tables.latest(tables.read_manifest(spark, f"{a.input_dir}/manifest"), "key").select("category", "video")
        for r in tables.missing(_written(spark, a.output_dir, "category", "video"), known, ["category", "video"]).toLocalIterator():
            print(f"no entry in the manifest: {r['category']} {r['video']}")


def knn(spark: SparkSession, a: argparse.Namespace) -> None:
    frames = tables.read_frames(spark, f"{a.input_dir}/frames")
    tv = frames.where("category = 'tv'")
    if not a.overwrite:
        tv = tables.missing(tv, _written(spark, a.output_dir, "video"), ["video"])
    entries = tv.where(F.size("features") > 0).select(F.col("video").alias("tv_video"), F.concat(F.lit("video="), "video").alias("output")).distinct().collect()  # a row a video
    if entries:
        near = pipelines.neighbours(tv, frames.where("category = 'commercials'"), a.k, normalise=a.normalize, batch=a.batch_size)
        tables.write_partitioned(near, a.output_dir, ("video",))
        _entered(spark, entries, schema.NEIGHBOUR_FILES, a.output_dir, "tv_video")


def detect_curves(spark: SparkSession, a: argparse.Namespace) -> None:
    clips = _clips(tables.read_manifest(spark, a.preproc_manifest))
    scratch = f"{a.output.rstrip('/')}.scores-{uuid.uuid4().hex}"
    found = pipelines.curve_detections(spark.read.parquet(a.curves_dir), clips, smooth_window=a.smooth_window, z_threshold=a.z_threshold, min_peak_sec=a.min_peak_sec, match_threshold=a.match_threshold, scratch=scratch)
    tables.write_intervals(found, a.output)
    tables.remove(spark, scratch)


def detect_knn(spark: SparkSession, a: argparse.Namespace) -> None:
    manifest = tables.read_manifest(spark, a.manifest)
    near = spark.read.parquet(a.knn_dir)
    gate = None
    if a.curve_dir:  # curves that the curve manifest names; a video without an entry passes the gate
        gate = spark.read.parquet(a.curve_dir).where("category = 'tv'").withColumn("video", F.col("video").cast("string"))
        named = tables.manifest_of(a.curve_dir)
        paths = tables.curve_paths(tables.read_manifest(spark, named, schema.CURVE_FILES)) if tables.exists(spark, named) else gate.select("video").distinct()
        gate = gate.join(paths.select("video"), "video", "left_semi")
        for r in tables.missing(near.select(F.col("video").cast("string").alias("video")).distinct(), paths, ["video"]).toLocalIterator():
            print(f"no curve, so no gate: {r['video']}")
    found = pipelines.neighbour_detections(
        near, _clips(manifest), gate, rates=tables.sampling_rates(manifest.where("category = 'tv'")), window_sec=a.window_sec, score_threshold=a.score_threshold, offset_tolerance=a.offset_tolerance,
        min_gap=a.min_gap, curve_threshold=a.curve_threshold, coverage=a.coverage_ratio, coverage_short=a.coverage_ratio_short, coverage_long=a.coverage_ratio_long, min_frames=a.min_frames, min_frames_short=a.min_frames_short,
        min_frames_long=a.min_frames_long, duration_threshold=a.duration_threshold,
    )
    tables.write_intervals(found, a.output, a.include_score)


def evaluation(spark: SparkSession, a: argparse.Namespace) -> None:
    detections = tables.read_intervals(spark, a.detections)[0].withColumnRenamed("line_no", "det_id")
    truth = tables.read_intervals(spark, a.truth, False)[0].withColumnRenamed("line_no", "gt_id").drop("score")
    detections = detections.withColumn("score", F.coalesce("score", F.lit(0.0)))
    labels, _, best = pipelines.evaluation(detections, truth)
    for r in evaluate.report_lines(labels, truth).toLocalIterator():
        print(r["line"])
    print(" ".join(f"{k}={v}" for k, v in evaluate.summary(best).first().asDict().items()))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    stages = {"preprocess": preprocess, "curves": curves, "knn": knn, "detect_curves": detect_curves, "detect_knn": detect_knn, "evaluate": evaluation}
    stages[a.stage](SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
