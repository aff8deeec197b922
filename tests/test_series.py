"""Series in ranges: equal to plain windows over whole series, whatever the blocks, gaps in positions included."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import series


def plain_average(x, w):
    left = w // 2
    padded = np.pad(np.asarray(x, dtype=float), (left, w - left - 1), mode="edge")
    return np.array([padded[i : i + w].mean() for i in range(len(x))])


def plain_moments(x, w):
    x = np.asarray(x, dtype=float)
    if w <= 1 or len(x) < w:
        return np.full(len(x), x.mean()), np.full(len(x), x.std() if x.std() > 1e-6 else 1.0)
    padded = np.pad(x, (w // 2, w - w // 2 - 1))
    parts = np.array([padded[i : i + w] for i in range(len(x))])
    mean, square = parts.sum(axis=1) / w, (parts**2).sum(axis=1) / w
    return mean, np.sqrt(np.maximum(square - mean**2, 1e-6))


def made(rng):
    out = {}
    for key, n in (("a", 1), ("b", 5), ("c", 64), (None, 200), ("d", 37)):
        at = np.cumsum(rng.choice([1, 1, 1, 2, 30], n)) - rng.integers(0, 60)
        out[key] = (at.tolist(), rng.normal(2, 3, n).round(3).tolist())
    return out


@pytest.mark.parametrize("window", [1, 4, 5, 30])
@pytest.mark.parametrize("block", [7, 1 << 16])
def test_moments_and_averages_with_gaps(spark, window, block):
    data = made(np.random.default_rng(window))
    df = spark.createDataFrame([(k, p, x, f"{k}{p}") for k, (at, xs) in data.items() for p, x in zip(at, xs)], "k string, pos long, x double, other string").repartition(5)
    averages, moments = {}, {}
    for r in series.edge_moving_averages(df, ["k"], {"x": "s"}, window, block=block).collect():
        assert r["other"] == f"{r['k']}{r['pos']}"
        averages[r["k"], r["pos"]] = r["s"]
    for r in series.standard_scores(df, ["k"], "x", window, block=block).collect():
        moments[r["k"], r["pos"]] = (r["mean"], r["std"], r["z"])
    assert len(averages) == len(moments) == df.count()
    for k, (at, xs) in data.items():
        assert np.allclose([averages[k, p] for p in at], plain_average(xs, window) if window > 1 else xs)
        mean, std = plain_moments(xs, window)
        assert np.allclose([moments[k, p] for p in at], np.stack([mean, std, (np.array(xs) - mean) / std], axis=1))


def test_averages_of_the_first_and_last_of_ones_with_gaps(spark):
    df = spark.createDataFrame([(1, p, 1.0) for p in (3, 4, 5, 6, 9, 10, 11, 12)], "k int, pos long, x double")
    assert [r["s"] for r in series.edge_moving_average(df, ["k"], "x", 5, "s").collect()] == [1.0] * 8


@pytest.mark.parametrize("block", [1, 2, 5, 8, 1 << 16])
def test_runs_across_blocks(spark, block):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for k in (None, 1, 2):
        z = np.where(rng.random(120) < 0.7, rng.integers(3, 6, 120), 0).astype(float)
        z[rng.integers(0, 120, 4)] = np.nan
        z[40:70] = 5.0
        gone = set(rng.integers(0, 120, 5).tolist())
        run = []
        for p in range(-3, 118):
            v = z[p + 3] if p < 117 else 0.0
            if p < 117 and p not in gone:
                rows.append((k, p, float(v)))
            if p in gone or not v > 2.5:
                if len(run) >= 2:
                    peak = max(x for _, x in run)
                    want.add((k, run[0][0], run[-1][0] + 1, next(q for q, x in run if x == peak), peak))
                run = []
            else:
                run.append((p, v))
    df = spark.createDataFrame(rows, "k int, pos long, z double")
    got = [tuple(r) for r in series.active_segments(df, ["k"], "z", 2.5, 2, block=block).select("k", "seg_start", "seg_end", "peak_pos", "peak").collect()]
    assert set(got) == want and len(got) == len(want)
    assert series.active_segments(df.limit(0), ["k"], "z", 2.5, 2, block=block).count() == 0


def test_one_long_series_goes_to_all_tasks(spark):
    n = 400_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 2 + 5).alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("x"))
    out = series.standard_scores(df, ["k"], "x", 31, block=1 << 14)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be one task
    shares = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) > 1 and max(shares) < 0.7 * n
    frame = W.orderBy("pos").rowsBetween(-15, 15)
    whole = df.withColumn("m", F.sum("x").over(frame) / 31)
    assert out.join(whole.select("pos", "m"), "pos").where("abs(m - mean) > 1e-9").count() == 0 and out.count() == n
