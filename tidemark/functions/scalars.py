"""Scalar expressions: intervals, sampling, names, parsing, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2)


def hull(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(e1, e2) - F.least(s1, s2)


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Temporal intersection over union; 0 without overlap. Overlapping intervals' hull is their union."""
    both, all_ = overlap(s1, e1, s2, e2), hull(s1, e1, s2, e2)
    return F.when((both > 0) & (all_ > 0), both / all_).otherwise(F.lit(0.0))


def clamped_start(peak: Column, length: Column, total: Column) -> Column:
    """First position of a window of ``length`` centred on ``peak`` and kept inside [0, total)."""
    return F.greatest(F.lit(0), F.least(peak - F.floor(length / 2), total - length))


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash, lower case, without blanks around or a .mp4 or .mpg suffix."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(path)), r"^.*[/\\]", ""), r"\.(mp4|mpg)$", "")


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def manifest_key(category: Column, name: Column) -> Column:
    return F.concat_ws("::", category, name)


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def duration(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))


def stride(native_fps: Column, target_fps: Column) -> Column:
    """Native frames from one sample to the next; 0 without a target."""
    return F.when(target_fps > 0, native_fps / target_fps).otherwise(F.lit(0.0))


def sampling_plan(native_fps: Column, target_fps: Column, frames: Column) -> Column:
    """Array of (frame_idx, ts): every native/target-th frame, half-even, while inside the video."""
    bad = ~((native_fps > 0) & (target_fps > 0))
    stride = F.when(bad, F.raise_error(F.lit("frame rates must be positive")).cast("double")).otherwise(native_fps / target_fps)
    count = F.floor(frames / stride).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    picked = F.transform(steps, lambda i: F.bround(i * stride, 0).cast("long"))
    return F.transform(F.filter(picked, lambda x: x < frames), lambda x: F.struct(x.alias("frame_idx"), (x / native_fps).alias("ts")))
