"""Frames of videos as a Spark data source, with the decoder left open.

``spark.read.format("frames")`` plans one partition a video and yields the frames of the sampling plan as arrays of
grey pixels, in Arrow batches of ``BATCH_BYTES``. Options: ``paths`` (a JSON array), ``fps``, ``decoder`` and ``grid``, to
which frames are reduced where they are read, so that whole frames leave no task. ``sampled_frames`` reads the same from a table of paths, with a
video cut into ranges of samples, so that a long one is many tasks. A decoder is a function ``module:name`` of a path that returns (fps, frame count, read), where
``read(index)`` gives a frame, rows of pixels in 0..255, or None when it cannot be read.
"""

from __future__ import annotations

import importlib
import json
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.topology import area_mean

BATCH_BYTES = 8 << 20
SHAPE = "video string, pos int, frame_idx long, ts double, height int, width int, pixels array<double>, native_fps double, total_frames long"
ARROW = pa.schema([("video", pa.string()), ("pos", pa.int32()), ("frame_idx", pa.int64()), ("ts", pa.float64()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.list_(pa.float64())), ("native_fps", pa.float64()), ("total_frames", pa.int64())])


def npz_decoder(path: str):
    """Frames kept as an array (frame, row, column) named ``frames`` with a number ``fps``."""
    data = np.load(path)
    frames = data["frames"]
    return float(data["fps"]), len(frames), lambda i: frames[i] if i < len(frames) else None


def opencv_decoder(path: str):
    """Frames of a video file by OpenCV, where that library is installed."""
    import cv2

    video = cv2.VideoCapture(path)
    if not video.isOpened():
        raise OSError(f"cannot open {path}")

    def read(index: int):
        video.set(cv2.CAP_PROP_POS_FRAMES, index)
        ok, frame = video.read()
        return cv2.cvtColor(frame, cv2.COLOR_BGR2GRAY) if ok else None

    return video.get(cv2.CAP_PROP_FPS), int(video.get(cv2.CAP_PROP_FRAME_COUNT)), read


def _opened(decoder: str, path: str, fps: float):
    """(native rate, frames, read), or None with a warning for a file that cannot be opened: the others go on."""
    module, _, name = decoder.partition(":")
    try:
        native, total, read = getattr(importlib.import_module(module), name)(path)
    except OSError as e:
        warnings.warn(f"skipped {path}: {e}", stacklevel=1)
        return None
    if native <= 0 or fps <= 0:
        raise ValueError("frame rates must be positive")
    return float(native), int(total), read


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _samples(path: str, native: float, total: int, read: Callable, fps: float, grid: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """Samples [first, last) of a video in batches. Where a frame cannot be read the video ends: a row without pixels
    says so, and nothing follows."""
    rows: list[tuple] = []
    pixels: list[np.ndarray | None] = []

    def batch() -> pa.RecordBatch:
        n = len(rows)
        ends = np.cumsum([0, *(0 if x is None else x.size for x in pixels)])
        values = np.concatenate([np.zeros(0), *(x for x in pixels if x is not None)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array([x is None for x in pixels]))
        columns = [[_stem(path)] * n, *zip(*rows), lists, [native] * n, [total] * n]
        rows.clear()
        pixels.clear()
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)

    for pos in range(first, last):
        index = round(pos * native / fps)
        frame = read(index) if index < total else None
        if frame is None:
            rows.append((pos, index, index / native, 0, 0))
            pixels.append(None)
            break
        frame = np.asarray(frame, dtype=np.float64)
        if grid:
            frame = area_mean(frame, grid)
        rows.append((pos, index, index / native, *frame.shape))
        pixels.append(frame.ravel())
        if frame.nbytes * len(pixels) >= BATCH_BYTES:
            yield batch()
    if rows:
        yield batch()


def sampled_frames(videos: DataFrame, *, decoder: str = f"{__name__}:opencv_decoder", fps: float = 3.0, grid: int = 0, samples: int = 1024) -> DataFrame:
    """The frames of ``videos`` (column ``path``), as the data source gives them, and ``path``; ``samples`` frames of a
    video are one row of work, spread over the tasks. Files that cannot be opened have none.

    A video ends where a frame cannot be read. Its range has a row without pixels there; ``until_unreadable`` drops
    what other ranges have behind it, once frames are small.
    """
    spark = videos.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if (found := _opened(decoder, path, fps)) is not None and (n := int(found[1] // (found[0] / fps))):
                    firsts = list(range(0, n, samples))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(firsts)), pa.array(firsts, pa.int64()), pa.array([min(n, x + samples) for x in firsts], pa.int64())], names=["path", "first", "last"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "last"))):
                if (found := _opened(decoder, path, fps)) is not None:
                    for rows in _samples(path, *found, fps, grid, first, last):
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([path] * len(rows))], names=[*ARROW.names, "path"])

    ranges = videos.select("path").repartition(tasks, "path").mapInArrow(planned, "path string, first long, last long")
    return ranges.repartition(tasks, "path", "first").mapInArrow(read, f"{SHAPE}, path string")


def until_unreadable(frames: DataFrame, readable: str = "readable") -> DataFrame:
    """Rows of each ``path`` before its first that is not ``readable``, a column that goes."""
    ends = frames.where(~F.col(readable)).groupBy(F.col("path").alias("end_path")).agg(F.min("pos").alias("end_pos"))  # a row a video
    return frames.where(readable).join(ends, F.col("path") == F.col("end_path"), "left").where(F.col("end_pos").isNull() | (F.col("pos") < F.col("end_pos"))).drop("end_path", "end_pos", readable)


class FramePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options.get("paths", "[]"))
        self.grid = int(options.get("grid", 0))
        self.fps = float(options.get("fps", 3.0))
        self.decoder = options.get("decoder", f"{__name__}:npz_decoder")

    def partitions(self) -> list[InputPartition]:
        return [FramePartition(p) for p in self.paths]

    def read(self, partition: FramePartition) -> Iterator[pa.RecordBatch]:
        if (found := _opened(self.decoder, partition.path, self.fps)) is not None:
            for rows in _samples(partition.path, *found, self.fps, self.grid, 0, int(found[1] // (found[0] / self.fps))):
                yield rows.filter(rows.column("pixels").is_valid())


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)
