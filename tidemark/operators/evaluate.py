"""Detections against ground truth: best overlap, one-to-one claims, threshold sweep, reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Intervals of one video and clip beyond which time is cut into cells; rows that may be broadcast; pairs in a batch.
CELL, FEW, PAIRS = 100_000, 100_000, 1 << 16
#: What a row is in its cell, in the order in which cells are read.
TRUTH_START, DETECTION, DETECTION_START, TRUTH = range(4)


def relevant(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Ground truth of the videos that have detections."""
    return truth.join(detections.select("tv").distinct(), "tv", "left_semi")


def _sweep_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of cells in order, each with starts before the intervals that they may lie in, pairs of ids and their overlap.

    Starts of a cell are held, sorted; intervals pass by, and the starts inside one are a range.
    """
    held: list[pa.RecordBatch] = []
    cell = None
    points = None

    def met(rows: pa.RecordBatch, kind: int) -> Iterator[pa.RecordBatch]:
        nonlocal points
        if points is None:
            whole = pa.Table.from_batches(held)
            points = whole.column("id").combine_chunks(), whole.column("s").to_numpy(), whole.column("e").to_numpy()
        ids, s, e = points
        own_s, own_e = rows.column("s").to_numpy(), rows.column("e").to_numpy()
        # a truth that begins with a detection counts here, a detection that begins with a truth does not again
        low = np.searchsorted(s, own_s, side="left" if kind == DETECTION else "right")
        ends = np.cumsum(np.maximum(np.searchsorted(s, own_e, side="left") - low, 0))
        for at in range(0, int(ends[-1]), PAIRS):
            n = np.arange(at, min(at + PAIRS, ends[-1]))
            row = np.searchsorted(ends, n, side="right")
            point = low[row] + n - np.where(row > 0, ends[row - 1], 0)
            both = np.minimum(e[point], own_e[row]) - np.maximum(s[point], own_s[row])
            iou = both / (np.maximum(e[point], own_e[row]) - np.minimum(s[point], own_s[row]))
            pair = ids.take(pa.array(point)), rows.column("id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*(pair[::-1] if kind == DETECTION else pair), pa.array(iou)], names=["det_id", "gt_id", "iou"])

    for batch in batches:
        if not len(batch):
            continue
        # rows of one cell and kind lie together
        changes = [pc.not_equal(c[1:], c[:-1]) for c in (batch.column(x) for x in ("tv", "clip", "cell", "kind"))]
        new = np.flatnonzero(np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in changes])) + 1 if len(batch) > 1 else []
        for a, b in zip([0, *new], [*new, len(batch)]):
            rows = batch.slice(a, b - a)
            kind = rows.column("kind")[0].as_py()
            here = (*(rows.column(x)[0].as_py() for x in ("tv", "clip", "cell")), kind // 2)
            if here != cell:
                cell, held, points = here, [], None
            if kind in (TRUTH_START, DETECTION_START):
                held.append(rows)
            elif held:
                yield from met(rows, kind)


def overlaps(detections: DataFrame, truth: DataFrame, cell: int = CELL) -> DataFrame:
    """(det_id, gt_id, iou): pairs of one video and clip that overlap.

    Of two intervals that overlap one begins inside the other. Starts and intervals meet by video and clip; where these
    have more than ``cell`` intervals also by cells of time, cut at quantiles of their starts, as many as there are
    shuffle partitions. An interval is copied into every cell that it touches, a start lies in one. Many equal
    starts are several cuts, and spread over the cells between those. Work follows intervals and pairs, however long
    intervals are or however many have the same video and clip.

    Intervals with a null, NaN or infinite start or length, and without a length above 0, overlap nothing: beside an
    infinite one the overlap's share would be 0 or undefined. Null videos and clips match nothing.
    """
    spark = detections.sparkSession
    end = F.col("start") + F.col("length")
    sides = []
    for df, key, kinds in ((detections, "det_id", (DETECTION_START, DETECTION)), (truth, "gt_id", (TRUTH_START, TRUTH))):
        own = df.select("tv", "clip", F.col(key).alias("id"), F.col("start").cast("double").alias("s"), end.cast("double").alias("e"))
        finite = (F.abs("s") < float("inf")) & (F.abs("e") < float("inf")) & (F.col("e") > F.col("s"))  # NaN is above all numbers
        sides.append((own.where(finite & F.col("tv").isNotNull() & F.col("clip").isNotNull()), kinds))
    every = sides[0][0].select("tv", "clip", "s").unionByName(sides[1][0].select("tv", "clip", "s"))
    large = every.groupBy("tv", "clip").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("tv", "clip")
    known = large.count()  # at most one for ``cell`` rows
    cuts: list[float] = []
    if known:
        large = F.broadcast(large) if known <= FEW else large.hint("merge")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cuts = every.join(large, ["tv", "clip"], "left_semi").agg(F.percentile_approx("s", [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("c")).first()["c"]
        marks = large.select("tv", "clip", F.lit(True).alias("large"))
        sides = [(df.join(F.broadcast(marks) if known <= FEW else marks.hint("merge"), ["tv", "clip"], "left"), kinds) for df, kinds in sides]
    at = F.lit(sorted(cuts)).cast("array<double>")
    below = lambda c: F.size(F.filter(at, lambda x: x < F.col(c)))
    upto = lambda c: F.size(F.filter(at, lambda x: x <= F.col(c)))
    rows = []
    for df, (start_kind, kind) in sides:
        one = below("s") + F.pmod(F.xxhash64("id"), upto("s") - below("s") + 1).cast("int")
        spans = F.sequence(below("s"), upto("e"))
        if known:
            one, spans = F.when(F.col("large"), one).otherwise(0), F.when(F.col("large"), spans).otherwise(F.array(F.lit(0)))
        else:
            one, spans = F.lit(0), F.array(F.lit(0))
        rows.append(df.select("tv", "clip", one.cast("int").alias("cell"), F.lit(start_kind).alias("kind"), "id", "s", "e"))
        rows.append(df.select("tv", "clip", F.explode(spans).alias("cell"), F.lit(kind).alias("kind"), "id", "s", "e"))
    both = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    cells = both.repartition("tv", "clip", "cell").sortWithinPartitions("tv", "clip", "cell", "kind", "s")
    kinds = [df.schema[k].dataType.simpleString() for df, k in ((detections, "det_id"), (truth, "gt_id"))]
    return cells.mapInArrow(_sweep_cells, f"det_id {kinds[0]}, gt_id {kinds[1]}, iou double").where("iou > 0")


def best_truth(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """(det_id, gt_id, iou): the largest overlap of each detection that has one, the smaller id on a tie."""
    best = overlaps(detections, truth).groupBy("det_id").agg(F.max_by(F.struct("gt_id", "iou"), F.struct(F.col("iou"), -F.col("gt_id"))).alias("b"))
    return best.select("det_id", "b.gt_id", "b.iou")


def label(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """Every detection with ``label`` ok, dup or bad, and gt_id and iou where it is not bad.

    The detection with the highest score of those whose best truth is the same is ok (the smaller id on a tie, a null
    score below all others). The winners are found by an aggregate: a truth that very many claim is no large group.
    """
    found = detections.join(best_truth(detections, relevant(truth, detections)), "det_id", "left")
    claims = found.where("gt_id is not null")
    winners = claims.groupBy("gt_id").agg(F.max_by("det_id", F.struct(F.col("score"), -F.col("det_id"))).alias("winner")).select("winner")
    return found.join(winners, F.col("det_id") == F.col("winner"), "left").withColumn("label", F.when(F.col("gt_id").isNull(), "bad").when(F.col("winner").isNull(), "dup").otherwise("ok")).drop("winner")


def sweep(labels: DataFrame, total_truth: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Metrics at each threshold: the scores of ok detections, and 0. ``total_truth``: one row, column ``total``.

    Duplicates do not lower the precision. Counts of each distinct score are made first. The running sums go over
    ranges of scores, each in a task of its own, behind the sums of the ranges above: the ranges are cut at quantiles,
    as many as there are shuffle partitions, and only those cuts reach the driver. ``scores``: a table with the same
    ``score`` column that is cheaper to read for the quantiles than the labels are to make, the detections; any cuts
    give the same rows. A null score is below all others.
    """
    at = labels.groupBy("score").agg(*[F.count_if(F.col("label") == x).alias(x) for x in ("ok", "bad", "dup")], F.sum(F.when(F.col("label") == "ok", F.col("iou")).otherwise(0.0)).alias("iou"))
    at = at.unionByName(at.sparkSession.range(1).select(F.lit(0.0).alias("score"), *[F.lit(0).cast("long").alias(x) for x in ("ok", "bad", "dup")], F.lit(0.0).alias("iou")))
    at = at.groupBy("score").agg(*[F.sum(x).alias(x) for x in ("ok", "bad", "dup", "iou")])
    parts = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = (labels if scores is None else scores).agg(F.percentile_approx(F.col("score").cast("double"), [k / parts for k in range(1, parts)], 100 * parts).alias("c")).first()["c"] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    at = at.withColumn("part", F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c >= F.col("score"))) + F.when(F.col("score").isNull(), len(cuts) + 1).otherwise(0))
    counts = ("ok", "bad", "dup", "iou")
    above = at.groupBy("part").agg(*[F.sum(x).alias(f"part_{x}") for x in counts])  # a row a range
    above = above.select("part", *[(F.sum(f"part_{x}").over(W.orderBy("part")) - F.col(f"part_{x}")).alias(f"above_{x}") for x in counts])
    down = W.partitionBy("part").orderBy(F.col("score").desc())
    run = at.join(F.broadcast(above), "part").select("score", (F.col("ok") > 0).alias("own"), *[(F.col(f"above_{x}") + F.sum(x).over(down)).alias(x) for x in counts]).where("own or score = 0")
    m = run.crossJoin(F.broadcast(total_truth))
    some = F.col("ok") > 0
    ratio = lambda a, b: F.when(some, F.try_divide(a, b)).otherwise(F.lit(0.0))
    m = m.withColumn("recall", ratio(F.col("ok"), F.col("total"))).withColumn("precision", ratio(F.col("ok"), F.col("ok") + F.col("bad")))
    f1 = F.when(some, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(F.lit(0.0))
    task = F.when(some, F.greatest(F.lit(0.0), (F.col("ok") - F.col("bad")) / F.col("total"))).otherwise(F.lit(0.0))
    return m.select(F.col("score").alias("threshold"), "ok", "bad", "dup", "total", "recall", "precision", f1.alias("f1"), ratio(F.col("iou"), F.col("ok")).alias("mean_iou"), task.alias("task"))


def best_point(metrics: DataFrame) -> DataFrame:
    """The row with the highest task score, the higher threshold on a tie."""
    return metrics.orderBy(F.col("task").desc(), F.col("threshold").desc()).limit(1)


def total_truth(truth: DataFrame, detections: DataFrame) -> DataFrame:
    return relevant(truth, detections).agg(F.count("*").alias("total"))


def report_lines(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(det_id, line) in order of the ids: a mark, the row, and for ok the overlap in percent, and start and length of
    the truth claimed."""
    text = lambda c: F.col(c).cast("string")
    mark = F.when(F.col("label") == "ok", "OK").when(F.col("label") == "dup", "dp").otherwise("--")
    row = F.concat_ws(" ", "tv", text("start"), text("length"), "clip", F.coalesce(text("score"), F.lit("None")))
    claimed = truth.select(F.col("gt_id").alias("claimed_id"), F.col("start").alias("gt_start"), F.col("length").alias("gt_length"))
    both = labels.join(claimed, (F.col("gt_id") == F.col("claimed_id")) & (F.col("label") == "ok"), "left")
    tail = F.when(F.col("label") == "ok", F.concat(F.lit("  //IoU="), F.bround(100 * F.col("iou")).cast("long").cast("string"), F.lit("% (gt="), text("gt_start"), F.lit(" "), text("gt_length"), F.lit(")"))).otherwise("")
    return both.select("det_id", F.concat(F.lit(" "), mark, F.lit(") "), row, tail).alias("line")).orderBy("det_id")


def summary(best: DataFrame) -> DataFrame:
    """One row of figures as reported: percent to one digit, the rest to three."""
    percent = lambda c: F.round(100 * F.col(c), 1).alias(c)
    return best.select(F.round("threshold", 4).alias("threshold"), percent("precision"), percent("recall"), F.round("f1", 3).alias("f1"), F.round("mean_iou", 3).alias("mean_iou"), "ok", "bad", "dup", "total", percent("task"))
