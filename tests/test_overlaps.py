"""Overlapping intervals against the definition: hot keys, equal starts, long, infinite and NaN lengths."""

import math
import random

import pytest

from tidemark.operators import evaluate


def brute(det, gt):
    out = {}
    for i, tv, s1, n1, c, _ in det:
        for j, tv2, s2, n2, c2 in gt:
            if tv is not None and c is not None and (tv, c) == (tv2, c2) and all(x is not None and math.isfinite(x) for x in (s1, n1, s2, n2)) and n1 > 0 and n2 > 0:
                both = min(s1 + n1, s2 + n2) - max(s1, s2)
                if both > 0:
                    out[i, j] = both / (max(s1 + n1, s2 + n2) - min(s1, s2))
    return out


def made(rng, n):
    def one(k):
        hot = rng.random() < 0.6
        start = rng.choice([0.0, 5.0, float(rng.randrange(50)), rng.random() * 50, rng.random() * 50])
        length = rng.choice([1.0, 2.5, rng.random() * 3, rng.random() * 3, 1e300, float("inf"), float("nan"), 0.0, -1.0, None])
        return (k, "t" if hot else rng.choice(["u", "v", None]), None if rng.random() < 0.02 else start, length, "c" if hot else rng.choice(["c", "d", None]))

    return [one(k) for k in range(n)]


@pytest.mark.parametrize("cell, parts", [(100_000, "4"), (20, "4"), (20, "9"), (1, "3"), (20, "1")])
def test_pairs(spark, cell, parts):
    rng = random.Random(5)
    gt, det = made(rng, 220), [(*r, rng.random()) for r in made(rng, 300)]
    d = spark.createDataFrame(det, "det_id long, tv string, start double, length double, clip string, score double").repartition(3)
    g = spark.createDataFrame(gt, "gt_id long, tv string, start double, length double, clip string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = evaluate.overlaps(d, g, cell=cell).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute(det, gt)
    assert len(got) == len({(r["det_id"], r["gt_id"]) for r in got}) and len(want) > 1000
    assert {(r["det_id"], r["gt_id"]) for r in got} == {k for k, x in want.items() if x > 0}
    assert all(math.isclose(r["iou"], want[r["det_id"], r["gt_id"]]) for r in got)


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, "t", 0.0, 1.0, "c", 0.5)], "det_id long, tv string, start double, length double, clip string, score double")
    g = spark.createDataFrame([(1, "t", 0.0, 1.0, "c")], "gt_id long, tv string, start double, length double, clip string")
    assert evaluate.overlaps(d, g.limit(0)).count() == evaluate.overlaps(d.limit(0), g).count() == 0 and evaluate.overlaps(d, g).count() == 1


def test_many_pairs_leave_in_batches(spark, monkeypatch):
    n = 700
    d = spark.range(n).selectExpr("id as det_id", "'t' as tv", "double(id) / 1000 as start", "100.0D as length", "'c' as clip", "1.0D as score")
    g = spark.range(n).selectExpr("id as gt_id", "'t' as tv", "double(id) / 1000 as start", "100.0D as length", "'c' as clip")
    assert evaluate.overlaps(d, g, cell=100).count() == n * n
