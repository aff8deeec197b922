"""Scans and sinks: video listings, frame tables, manifests, interval files, incremental writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema
from tidemark.functions import scalars

#: Suffixes of video files.
SUFFIXES = ("mp4", "mpg", "mpeg", "avi", "mkv", "mov")


def videos_in(spark: SparkSession, folder: str, category: str) -> DataFrame:
    """(category, path, video, file_order) of the video files right in ``folder``; content is not read.

    The order of full paths decides ties later on, so it is kept as a column. A folder that is not there has none.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], "category string, path string, video string, file_order int")
    files = spark.read.format("binaryFile").load(folder).select("path").where(F.col("path").rlike(rf"(?i)\.({'|'.join(SUFFIXES)})$"))
    numbered = files.withColumn("file_order", F.row_number().over(W.orderBy("path")))  # one row a file
    return numbered.select(F.lit(category).alias("category"), "path", scalars.stem(F.col("path")).alias("video"), "file_order")


def write_partitioned(df: DataFrame, path: str, keys: tuple[str, ...] = ("category", "video")) -> None:
    """Frames, curves or neighbours: one folder a video, columns readable on their own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_frames(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Only ``columns`` are read; a filter on category or video prunes folders."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def without_empty(df: DataFrame, vector: str = "features") -> DataFrame:
    return df.where(F.size(vector) > 0)


def curve_of(curves: DataFrame, name: str) -> DataFrame:
    """(category, video, pos, ts, gate) of one curve; an unknown name is an error at analysis."""
    return curves.select("category", "video", "pos", "ts", F.col(name).alias("gate"))


def manifest_of(folder: str) -> str:
    """Where the manifest of a folder of curves or neighbours lies: beside it, as the folder is a table."""
    return folder.rstrip("/") + ".manifest"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def write_manifest(df: DataFrame, path: str, *, even_empty: bool = True) -> bool:
    """One object a line. Without ``even_empty`` nothing is written, and an older manifest stays, when there are no rows."""
    if not even_empty and df.isEmpty():
        return False
    df.write.mode("overwrite").json(path)
    return True


def merge_manifest(df: DataFrame, path: str, kind: T.StructType = schema.VIDEOS, by: str = "key") -> None:
    """Entries of a run beside those that the manifest has already; of entries with the same ``by`` those of ``df`` stay.

    ``by``: ``key`` (category and stem of the source), ``video`` (stem) or a field. The whole is written next to the
    old manifest and then takes its place; a run that died in between is completed by the next one.
    """
    spark = df.sparkSession
    following = path.rstrip("/") + ".next"
    fs, old = _file_system(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(following)
    if not fs.exists(old) and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{following}/_SUCCESS")):
        fs.rename(new, old)
    rows = df.select(*kind.names)
    if fs.exists(old):
        known = latest(read_manifest(spark, path, kind), by)
        rows = missing(known, _named(rows, kind), [by]).select(*kind.names).unionByName(rows)
    rows.coalesce(1).write.mode("overwrite").json(following)  # a row a video
    fs.delete(old, True)
    fs.rename(new, old)


def _named(rows: DataFrame, kind: T.StructType) -> DataFrame:
    """``video`` (stem of the source path) and ``key`` (category::video), where there is a source path."""
    if "source_path" in kind.names:
        rows = rows.withColumn("video", scalars.stem(F.col("source_path")))
        if "category" in kind.names:
            rows = rows.withColumn("key", scalars.manifest_key(F.col("category"), F.col("video")))
    return rows


def parse_manifest(files: DataFrame, kind: T.StructType = schema.VIDEOS) -> DataFrame:
    """The objects of manifests, each file a row (``path``, ``value``, its whole text): an array of flat objects, or
    one object a line.

    Beside the fields: ``path`` and ``entry``, the place in the file, and where there is a source path ``video`` (its
    stem) and ``key`` (category::video).
    """
    objects = T.ArrayType(kind)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")
    is_array = F.col("value").rlike(r"\A[\s\x{feff}]*\[")
    # lines become an array too, so one parser reads both
    whole = F.when(is_array, F.col("value")).otherwise(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")))
    rows = files.select("path", F.posexplode(F.from_json(whole, objects)).alias("entry", "o")).select("o.*", "path", F.col("entry").cast("long").alias("entry"))
    return _named(rows, kind)


def read_manifest(spark: SparkSession, path: str, kind: T.StructType = schema.VIDEOS) -> DataFrame:
    """``parse_manifest`` of a file or of all files of a folder."""
    return parse_manifest(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"), kind)


def latest(manifest: DataFrame, by: str = "video") -> DataFrame:
    """One row for each value of ``by`` (``video`` or ``key``): the last of its entries, by file and place."""
    last = F.max_by(F.struct(*manifest.columns), F.struct("path", "entry"))
    return manifest.groupBy(F.col(by).alias("latest_by")).agg(last.alias("o")).select("o.*")


def sampling_rates(videos: DataFrame) -> DataFrame:
    """(video, sampled_fps) of a manifest of videos."""
    return latest(videos).where("sampled_fps is not null").select("video", "sampled_fps")


def curve_paths(curves: DataFrame, category: str = "tv") -> DataFrame:
    """(video, output_path) of a curve manifest's entries of one category."""
    return latest(curves.where(F.col("category") == category)).select("video", "output_path")


def missing(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` that ``known`` has nothing for: what an incremental run still has to do, or to warn about."""
    return wanted.join(known.select(*keys).distinct(), keys, "left_anti")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, or of the parts of a folder in order, counted from 1, blank and comment lines
    included.

    Rows are numbered inside the ranges of the files that tasks read, wherever Spark puts those, and shifted by the
    counts of the ranges before: one row a range.
    """
    at = F.struct(F.length("_metadata.file_path").alias("n"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = spark.read.text(path).select("value", at.alias("at"), F.monotonically_increasing_id().alias("mid"))
    ranges = lines.groupBy("at").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    before = ranges.select("at", "first", (F.sum("n").over(W.orderBy("at")) - F.col("n")).alias("before"))
    return lines.join(F.broadcast(before), "at").select((F.col("before") + F.col("mid") - F.col("first") + 1).alias("line_no"), F.regexp_replace("value", r"[\r\n]+$", "").alias("value"))


def _fields(with_score: bool | None) -> tuple[Column, list[Column]]:
    parts = F.split("value", "\t", -1)
    n = F.size(parts)
    at = lambda k: F.get(parts, F.lit(k))
    arity = n.isin(4, 5) if with_score is None else n == (5 if with_score else 4)
    start, length, score = (scalars.number(at(k)) for k in (1, 2, 4))
    names = [scalars.base_name(at(0)), scalars.base_name(at(3))]
    bad_score = (n == 5) & (score.isNull() | ~(F.isnan(score) | (score > 0))) if with_score is not False else F.lit(False)
    reason = (
        F.when(~arity, "wrong number of columns")
        .when((names[0] == "") | (names[1] == ""), "empty name")
        .when(start.isNull() | length.isNull(), "not a number")
        .when(start < 0, "start before zero")
        .when(~(F.isnan(length) | (length > 0)), "length not positive")
        .when(bad_score, "score not positive")
    )
    return reason, [names[0].alias("tv"), F.round(start, 3).alias("start"), F.round(length, 3).alias("length"), names[1].alias("clip"), score.alias("score")]


def parse_intervals(lines: DataFrame, with_score: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows (line_no, tv, start, length, clip, score) and rejects (line_no, value, reason).

    Tab-separated, four columns or five with a score (``None``: either). Blank lines and those that begin with #
    are neither. Line numbers are ids.
    """
    kept = lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))
    reason, columns = _fields(with_score)
    marked = kept.withColumn("reason", reason)
    return marked.where("reason is null").select("line_no", *columns), marked.where("reason is not null").select("line_no", "value", "reason")


def read_intervals(spark: SparkSession, path: str, with_score: bool | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_intervals(numbered_lines(spark, path), with_score)


def interval_lines(detections: DataFrame, with_score: bool = True, *beside: str) -> DataFrame:
    """Detections as lines, with the columns ``beside``: times to three digits, scores to four."""
    columns = [F.col("tv"), F.round("start", 3).cast("string"), F.round("length", 3).cast("string"), F.col("clip"), *([F.round("score", 4).cast("string")] if with_score else [])]
    return detections.select(F.concat_ws("\t", *columns).alias("value"), *beside)


def write_intervals(detections: DataFrame, path: str, with_score: bool = True) -> bool:
    """A header row and the lines in order of video, start and clip; nothing is written without detections.

    The lines are cut into ranges of that order, a part each, and the parts' names are in order too: put together they
    are the file, whose first line is the header.
    """
    if detections.isEmpty():
        return False
    names = ["tv", "start", "length", "clip", *(["score"] if with_score else [])]
    lines = interval_lines(detections.withColumn("o", F.lit(1)), with_score, "o", "tv", "start", "clip")
    head = detections.sparkSession.range(1).select(F.lit("# " + "\t".join(names)).alias("value"), F.lit(0).alias("o"))
    order = ["o", "tv", "start", "clip", "value"]
    parts = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = head.unionByName(lines, allowMissingColumns=True).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    whole.select("value").write.mode("overwrite").text(path)
    return True
