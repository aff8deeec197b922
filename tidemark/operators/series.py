"""Ordered series: centred moments with exact edge rules, standard scores, runs.

A series is cut into ranges, so that a long one is no single task. Rows are ranked by blocks of positions and one row a
block that says how many come before; then blocks of ranks get the samples beside them that their windows reach, as
copies that are dropped again. Runs are found by blocks of positions, and those that touch a block's edge are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions, and later rows, of a series that one group of a shuffle holds.
BLOCK = 1 << 16


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Number the rows of each series from 0."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def _ranked(df: DataFrame, keys: list[str], columns: list[str], pos: str, block: int) -> DataFrame:
    """``df`` with ``_rank``, from 0 within each series, and ``_all``: n of the series, and for each of the columns, by
    its number, first, last, mean and std.

    Positions are whole numbers, distinct within a series; they may have gaps and begin anywhere.
    """
    own = df.withColumn("_at", F.floor(F.col(pos) / block))
    stats = [F.count("*").alias("_n")]
    for k, c in enumerate(columns):
        x = F.col(c).cast("double")
        stats += [F.count(x).alias(f"_c{k}"), F.coalesce(F.avg(x), F.lit(0.0)).alias(f"_m{k}"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias(f"_v{k}"), F.min_by(x, pos).alias(f"_first{k}"), F.max_by(x, pos).alias(f"_last{k}")]
    # one row a block of positions; from here on a series is as long as it has blocks
    parts = own.groupBy(*keys, "_at").agg(*stats)
    series, ordered = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_at")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = parts.withColumns({"_before": F.sum("_n").over(ordered) - F.col("_n")} | {f"_mean{k}": F.try_divide(F.sum(F.col(f"_c{k}") * F.col(f"_m{k}")).over(series), F.sum(f"_c{k}").over(series)) for k in range(len(columns))})
    about = [F.col("_before").alias("before"), F.sum("_n").over(series).alias("n")]
    for k in range(len(columns)):
        n, m, mean = (F.col(f"_{c}{k}") for c in ("c", "m", "mean"))
        spread = F.sqrt(F.try_divide(F.sum(n * (F.col(f"_v{k}") + (m - mean) * (m - mean))).over(series), F.sum(n).over(series)))
        about += [F.first(f"_first{k}").over(whole).alias(f"first{k}"), F.last(f"_last{k}").over(whole).alias(f"last{k}"), mean.alias(f"mean{k}"), spread.alias(f"std{k}")]
    # each block's row goes along with its samples instead of a join, which would have to be null-safe
    marked = own.unionByName(parts.select(*keys, "_at", F.struct(*about).alias("_all")), allowMissingColumns=True)
    here = W.partitionBy(*keys, "_at")
    number, known = F.row_number().over(here.orderBy(F.col("_all").isNull(), pos)), F.first("_all", ignorenulls=True).over(here)
    ranked = marked.withColumns({"_number": number, "_known": known}).where(F.col("_all").isNull())
    return ranked.withColumn("_rank", F.col("_known.before") + F.col("_number") - 2).drop("_at", "_all", "_number").withColumnRenamed("_known", "_all")


def _with_halo(df: DataFrame, keys: list[str], columns: list[str], window: int, pos: str, block: int) -> tuple[DataFrame, W]:
    """Ranked rows in blocks, each with the rows beside it that a centred window reaches, and that window. Rows whose
    ``_block`` is not ``_own`` are copies."""
    left = window // 2
    right = window - left - 1
    size = max(block, window)
    ranked = _ranked(df, keys, columns, pos, block)
    own, at = F.floor(F.col("_rank") / size), F.col("_rank") % size
    last = F.floor((F.col("_all.n") - 1) / size)
    blocks = F.filter(F.array(F.col("_own"), F.when(at >= size - left, F.col("_own") + 1), F.when(at < right, F.col("_own") - 1)), lambda b: b.isNotNull() & (b >= 0) & (b <= last))
    spread = ranked.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    return spread, W.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(-left, right)


def _without_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col("_block") == F.col("_own")).drop("_rank", "_all", "_own", "_block")


def edge_moving_averages(df: DataFrame, keys: list[str], columns: dict[str, str], window: int, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Centred moving averages, under a new or the same name, whose ends repeat the first and last value. A window of at
    most 1 changes nothing.

    An even window keeps the first n of the n + 1 values that a padded convolution has. Windows count rows, not
    positions, which may have gaps.
    """
    if window <= 1:
        return df.withColumns({out: F.col(x).cast("double") for x, out in columns.items()})
    left = window // 2
    right = window - left - 1
    spread, frame = _with_halo(df, keys, list(columns), window, pos, block)
    before, after = F.greatest(F.lit(0), F.lit(left) - F.col("_rank")), F.greatest(F.lit(0), F.col("_rank") + right - (F.col("_all.n") - 1))
    summed = spread.withColumns({f"_sum{k}": F.sum(F.col(x).cast("double")).over(frame) for k, x in enumerate(columns)})
    # an end that a window does not reach counts for nothing, even if it is null
    end = lambda n, value: F.when(n > 0, n * F.col(value)).otherwise(0.0)
    means = {out: (F.col(f"_sum{k}") + end(before, f"_all.first{k}") + end(after, f"_all.last{k}")) / window for k, out in enumerate(columns.values())}
    return _without_halo(summed.withColumns(means).drop(*[f"_sum{k}" for k in range(len(columns))]))


def edge_moving_average(df: DataFrame, keys: list[str], x: str, window: int, out: str, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    return edge_moving_averages(df, keys, {x: out}, window, pos, block)


def moving_moments(df: DataFrame, keys: list[str], x: str, window: int, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """``mean`` and ``std`` of a centred window that reads zeros beyond the ends, and always divides by its width.

    A window of at most 1, or wider than the series, gives the moments of the whole series; a deviation up to 1e-6
    then counts as 1. Inside a window the variance is at least 1e-6.
    """
    spread, frame = _with_halo(df, keys, [x], max(1, window), pos, block)
    value = F.col(x).cast("double")
    all_mean, all_std = F.col("_all.mean0"), F.when(F.col("_all.std0") <= 1e-6, 1.0).otherwise(F.col("_all.std0"))
    if window <= 1:
        return _without_halo(spread.withColumns({"mean": all_mean, "std": all_std}))
    sums = spread.withColumns({"_mean": F.sum(value).over(frame) / window, "_square": F.sum(value * value).over(frame) / window})
    std = F.sqrt(F.greatest(F.col("_square") - F.col("_mean") * F.col("_mean"), F.lit(1e-6)))
    short = F.col("_all.n") < window
    return _without_halo(sums.withColumns({"mean": F.when(short, all_mean).otherwise(F.col("_mean")), "std": F.when(short, all_std).otherwise(std)}).drop("_mean", "_square"))


def standard_scores(df: DataFrame, keys: list[str], x: str, window: int, out: str = "z", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    return moving_moments(df, keys, x, window, pos, block).withColumn(out, (F.col(x) - F.col("mean")) / F.col("std"))


def islands(df: DataFrame, keys: list[str], pos: str, name: str = "island") -> DataFrame:
    """A number shared by rows of consecutive positions within a series."""
    return df.withColumn(name, F.col(pos) - F.row_number().over(W.partitionBy(*keys).orderBy(pos)))


def active_segments(df: DataFrame, keys: list[str], z: str, threshold: float, least: int, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Maximal runs of z > threshold of at least ``least`` samples: seg_start, seg_end (exclusive), peak_pos (first
    maximum), peak. NaN is never above a threshold.

    Runs inside a block of positions are whole. At most two runs a block touch its edges; only those are put in order
    by series and joined where one ends at the position at which the next begins.
    """
    above = df.where((F.col(z) > threshold) & ~F.isnan(z)).withColumn("_at", F.floor(F.col(pos) / block))
    runs = (
        islands(above, [*keys, "_at"], pos)
        .groupBy(*keys, "_at", "island")
        .agg(F.min(pos).alias("seg_start"), (F.max(pos) + 1).alias("seg_end"), F.max_by(pos, F.struct(F.col(z), -F.col(pos))).alias("peak_pos"), F.max(z).alias("peak"))
        .drop("_at", "island")
    )
    touches = (F.pmod("seg_start", F.lit(block)) == 0) | (F.pmod("seg_end", F.lit(block)) == 0)
    series = W.partitionBy(*keys).orderBy("seg_start")
    new = F.when(F.lag("seg_end").over(series) == F.col("seg_start"), 0).otherwise(1)
    chained = runs.where(touches).withColumn("_new", new).withColumn("_chain", F.sum("_new").over(series))
    joined = chained.groupBy(*keys, "_chain").agg(
        F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.max_by("peak_pos", F.struct(F.col("peak"), -F.col("peak_pos"))).alias("peak_pos"), F.max("peak").alias("peak")
    )
    return runs.where(~touches).unionByName(joined.drop("_chain")).where(F.col("seg_end") - F.col("seg_start") >= least)


def tumbling(pos: Column, width: int | Column) -> Column:
    return F.floor(pos / width).cast("long")


def window_width(seconds: float, fps: float) -> int:
    """Samples in a window: half-even rounding, at least one."""
    return max(1, round(seconds * fps))


def width_column(seconds: float, fps: Column) -> Column:
    """``window_width`` by a column of sampling rates."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(seconds)) * fps).cast("int"))
