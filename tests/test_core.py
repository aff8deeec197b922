import json
import math
import os
import random
import sys
import types
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import scalars, vectors
from tidemark.operators import evaluate, knn, matching, series, topology, tracks
from tidemark.plans import pipelines
from tidemark.sources import tables, video


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ---- series --------------------------------------------------------------------------------------------------------


def padded(x, w, mode):
    left = w // 2
    p = np.pad(x, (left, w - left - 1), mode=mode)
    return np.convolve(p, np.ones(w), "valid") / w


@pytest.mark.parametrize("w", [1, 2, 5, 30, 31])
def test_windows_equal_numpy(spark, w):
    rng = np.random.default_rng(w)
    data = {k: rng.normal(size=n) for k, n in (("a", 40), ("b", 7), ("c", 1))}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in data.items() for i, x in enumerate(v)], "k string, pos long, x double")
    smooth = series.edge_moving_average(df, ["k"], "x", w, "s")
    scores = series.standard_scores(df, ["k"], "x", w)
    for k, v in data.items():
        got = [r["s"] for r in smooth.where(F.col("k") == k).orderBy("pos").collect()]
        assert np.allclose(got, v if w <= 1 else padded(v, w, "edge"))
        if w <= 1 or len(v) < w:
            std = v.std()
            want = (v - v.mean()) / (1.0 if std <= 1e-6 else std)
        else:
            m, q = padded(v, w, "constant"), padded(v * v, w, "constant")
            want = (v - m) / np.sqrt(np.maximum(q - m * m, 1e-6))
        assert np.allclose([r["z"] for r in scores.where(F.col("k") == k).orderBy("pos").collect()], want)


def test_segments(spark):
    z = [0, 3, 4, 4, 0, 5, float("nan"), 3, 3, 0]
    df = spark.createDataFrame([("v", i, float(x)) for i, x in enumerate(z)], "k string, pos long, z double")
    assert rows(series.active_segments(df, ["k"], "z", 2.5, 2), "seg_start", "seg_end", "peak_pos") == [(1, 4, 2), (7, 9, 7)]
    assert series.active_segments(df.limit(0), ["k"], "z", 2.5, 2).count() == 0
    assert [series.window_width(s, 3.0) for s in (1.0, 0.667, 0.1, 0.5)] == [3, 2, 1, 2]


# ---- neighbours ----------------------------------------------------------------------------------------------------


def test_nearest_equals_a_plain_sort(spark):
    rng = np.random.default_rng(0)
    data = {name: [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(n)] for name, n in (("query_id", 40), ("bank_id", 23))}
    q, b = (spark.createDataFrame(data[name] + [(99, None)], f"{name} long, vector array<double>") for name in ("query_id", "bank_id"))
    want = []
    for i, x in data["query_id"]:
        scores = sorted((-float(np.dot(x, y)), j) for j, y in data["bank_id"])
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:5])]
    for block in (1 << 20, 400, 8):
        assert rows(knn.nearest(q, b, 5, block_bytes=block), "query_id", "rank", "bank_id", "score") == want
    assert knn.nearest(q, b, 50).count() == 40 * 23
    assert knn.nearest(q, b.limit(0), 3).count() == 0 and knn.nearest(q.limit(0), b, 3).count() == 0


def test_clusters_are_skipped_and_ties_go_by_key(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 5
    vector = lambda: (centres[rng.integers(12)] + rng.normal(size=8) / 10).tolist()
    bank = [((f"c{i % 7}", i), vector()) for i in range(1500)]
    bank += [((f"a{i}", 0), bank[5][1]) for i in range(20)]  # copies under smaller keys
    asked = [(i, bank[5 * i][1] if i % 2 else vector()) for i in range(120)] + [(500, [float("nan")] * 8), (501, [float("inf")] + [0.0] * 7)]
    q = spark.createDataFrame(asked, "query_id long, vector array<double>")
    b = spark.createDataFrame(bank + [(("n", 1), [float("nan")] * 8)], "bank_id struct<clip:string,pos:int>, vector array<double>").repartition(3)
    for block, batch in ((64 << 20, None), (4000, 9)):
        report = []
        got = {}
        for r in knn.nearest(q, b, 4, block_bytes=block, batch=batch, report=report).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], tuple(r["bank_id"]), r["score"]))
        assert set(got) == set(range(120)) and report[0][0] < 0.5 * report[0][1] == 0.5 * 120 * 1520
        for i, x in asked[:120]:
            scores = np.array([v for _, v in bank]) @ np.array(x)
            want = sorted(zip((-scores).round(9).tolist(), (k for k, _ in bank)))[:4]
            have = sorted(got[i])
            assert np.allclose([s for _, _, s in have], [-s for s, _ in want]) and [k for _, k, _ in have] == [k for _, k in want], i
    with pytest.raises(ValueError, match="lengths"):
        knn.nearest(q, spark.createDataFrame([(1, [1.0])], "bank_id long, vector array<double>"), 1)


# ---- votes, tracks, folds ------------------------------------------------------------------------------------------


def fold_tracks(windows, tolerance):
    out, now = [], None
    for w in windows:
        if not w["pass"]:
            now = None
            continue
        o = w["t0"] - w["off"]
        if now and now["clip"] == w["clip"] and abs(o - now["off"]) <= tolerance:
            now.update(last=w["win"], off=0.5 * (now["off"] + o), best=max(now["best"], w["score"]))
        else:
            now = {"clip": w["clip"], "first": w["win"], "last": w["win"], "off": o, "best": w["score"]}
            out.append(now)
    return [(t["clip"], t["first"], t["last"], round(t["off"], 9), t["best"]) for t in out]


def test_tracks_equal_a_plain_fold(spark):
    rng = random.Random(4)
    data, want = [], []
    for v in range(8):
        windows = [{"win": i, "t0": i * 0.7, "off": rng.choice([0.0, 0.5, 2.0]) + rng.random(), "clip": rng.choice("aab"), "score": rng.random(), "pass": rng.random() < 0.8} for i in range(50)]
        want += [(v, *t) for t in fold_tracks(windows, 1.0)]
        data += [(v, w["win"], w["clip"], w["score"], w["off"], w["t0"], w["t0"] + 0.5, w["win"] * 2, w["win"] * 2 + 1) for w in windows if w["pass"]]
    df = spark.createDataFrame(data, "video long, win long, clip string, avg_score double, avg_offset double, t0 double, t1 double, first_pos long, last_pos long")
    got = tracks.build_tracks(df, 1.0).withColumn("off", F.round("off", 9))
    assert rows(got, "video", "clip", "start_win", "last_win", "off", "best") == sorted(want)


@pytest.mark.parametrize("step,tolerance,count", [(2 / 3, 2.0, 1), (1.0, 1.0, 15)])
def test_a_perfect_run(spark, step, tolerance, count):
    data = [("v", i, "c", 0.9, 0.0, i * step, i * step, i, i) for i in range(30)]
    df = spark.createDataFrame(data, "video string, win long, clip string, avg_score double, avg_offset double, t0 double, t1 double, first_pos long, last_pos long")
    assert tracks.build_tracks(df, tolerance).count() == count
    assert tracks.build_tracks(df, tolerance, constant_shift=True).count() == 1


def test_votes_and_gate(spark):
    f = [("v", 0, 0.0, "b", 1.0, 0.5, 2.0), ("v", 1, 0.3, "a", 2.0, 0.7, 1.0), ("v", 2, 0.6, "c", 0.0, 0.1, 0.5), ("w", 0, 0.0, "z", 0.0, 0.9, None)]
    w = tracks.vote_windows(spark.createDataFrame(f, "video string, pos long, ts double, clip string, clip_ts double, score double, gate double"), 2)
    assert rows(w, "video", "win", "clip", "votes", "gate") == [("v", 0, "a", 1, 2.0), ("v", 1, "c", 1, 0.5), ("w", 0, "z", 1, None)]
    assert rows(tracks.passing_windows(w, gate_threshold=1.5, score_threshold=0.2), "video", "win") == [("v", 0), ("w", 0)]
    assert tuple(tracks.gate_counts(w, gate_threshold=1.5, score_threshold=0.2).first()) == (3, 2, 1)


def test_min_gap(spark):
    hits = spark.createDataFrame([("t", "c", 0.0, 1.0, 0.1), ("t", "c", 3.0, 1.0, 0.2), ("t", "c", 6.0, 1.0, 0.3), ("t", "d", 0.0, 1.0, 0.5), ("t", "d", 3.9, 1.0, 0.5), ("t", "d", 4.0, 1.0, 0.4)], "tv string, clip string, start double, length double, score double")
    assert rows(tracks.min_gap(hits, 4.0, ["tv", "clip"]), "clip", "start") == [("c", 6.0), ("d", 0.0), ("d", 4.0)]
    assert tracks.min_gap(hits, 0.0, ["tv", "clip"]).count() == 6


def test_min_gap_equals_a_plain_fold(spark):
    rng = random.Random(12)
    data = [(rng.choice("tu"), rng.choice("cd"), float(rng.choice([rng.randrange(60), rng.randrange(400)])), 1.0, rng.randrange(9) / 8) for _ in range(300)]
    want = []
    for key in sorted({x[:2] for x in data}):
        kept = []
        for hit in sorted(x[2:] for x in data if x[:2] == key):
            if kept and hit[0] - kept[-1][0] < 4.0:
                kept[-1] = hit if hit[2] > kept[-1][2] else kept[-1]
            else:
                kept.append(hit)
        want += [(*key, *x) for x in kept]
    hits = spark.createDataFrame(data, "tv string, clip string, start double, length double, score double")
    assert rows(tracks.min_gap(hits, 4.0, ["tv", "clip"]), "tv", "clip", "start", "length", "score") == sorted(want)


def test_finalise(spark):
    t = spark.createDataFrame([("v", "s", 0, 9, 0.0), ("v", "l", 0, 20, 5.0), ("v", "u", 0, 4, 9.0), ("v", "l", 0, 90, 1.0), ("v", "s", 0, 8, 2.0)], "video string, clip string, first_pos long, last_pos long, t0 double")
    # observed is from the first sample's time to the last one's: nine samples at 3 a second are 8/3 seconds
    t = t.withColumn("best", F.lit(0.9)).withColumn("t1", F.col("t0") + F.col("last_pos") / 3)
    clips = spark.createDataFrame([("s", 5.0), ("l", 30.0), ("u", 0.0)], "clip string, duration double")
    got = tracks.finalise(t, clips, coverage=0.6, coverage_long=0.9, min_frames=3, min_frames_long=40)
    assert [(c, s, round(n, 4)) for c, s, n in rows(got, "clip", "start", "length")] == [("l", 1.0, 30.0), ("s", 0.0, 5.0), ("u", 9.0, 1.3333)]


# ---- matching and pipelines ----------------------------------------------------------------------------------------


def test_peak_match(spark):
    rng = np.random.default_rng(2)
    clip, other, flat = rng.normal(size=12), rng.normal(size=12), np.ones(5)
    tv = rng.normal(size=60) * 0.1
    tv[20:32] += clip
    s = spark.createDataFrame([("v", i, float(x)) for i, x in enumerate(tv)], "video string, pos long, x double")
    bank = [(n, o, i, float(x)) for n, o, v in (("flat", 0, flat), ("clip", 1, clip), ("other", 2, other), ("long", 3, np.ones(90))) for i, x in enumerate(v)]
    c = spark.createDataFrame(bank, "clip string, clip_order int, pos long, x double")
    segments = spark.createDataFrame([("v", 25, 26), ("v", 58, 59)], "video string, seg_start long, peak_pos long")
    got = {r["seg_start"]: r for r in matching.match_peaks(segments, s, c).collect()}
    best = {n: np.corrcoef(tv[20:32], v)[0, 1] for n, v in (("clip", clip), ("other", other))}
    assert got[25]["clip"] == "clip" and math.isclose(got[25]["score"], best["clip"], abs_tol=1e-9)
    edge = {n: np.corrcoef(tv[48:60], v)[0, 1] for n, v in (("clip", clip), ("other", other))} | {"flat": 0.0}
    assert math.isclose(got[58]["score"], max(edge.values()), abs_tol=1e-9)


def test_detectors_end_to_end(spark):
    rng = np.random.default_rng(8)
    clip = {n: rng.normal(size=(30, 20)) for n in ("one", "two")}
    tv = rng.normal(size=(120, 20))
    tv[40:70] = clip["one"] + 0.01 * rng.normal(size=(30, 20))
    frame = lambda c, v, m: [(c, v, i, i / 3, x.tolist()) for i, x in enumerate(m)]
    kind = "category string, video string, pos long, ts double, features array<double>"
    near = pipelines.neighbours(spark.createDataFrame(frame("tv", "t", tv), kind), spark.createDataFrame([r for n, m in clip.items() for r in frame("commercials", n, m)], kind), 3, normalise=True)
    assert near.count() == 360
    clips = spark.createDataFrame([("one", 10.0, 1), ("two", 10.0, 2)], "clip string, duration double, clip_order int")
    got = pipelines.neighbour_detections(near, clips, window_sec=2 / 3, score_threshold=0.8, offset_tolerance=2.0, min_gap=4.0).collect()
    assert [(r["tv"], r["clip"], r["length"]) for r in got] == [("t", "one", 10.0)] and abs(got[0]["start"] - 40 / 3) < 0.5
    for rate, same in ((3.0, True), (30.0, False), (None, True)):  # at 30 a second a window has 20 samples
        rates = spark.createDataFrame([("t", rate), ("other", 99.0)], "video string, sampled_fps double")
        own = pipelines.neighbour_detections(near, clips, rates=rates, fps=3.0, window_sec=2 / 3, score_threshold=0.8, offset_tolerance=2.0, min_gap=4.0).collect()
        assert (own == got) == same
    curve = spark.createDataFrame([("t", i, 5.0 if i < 20 else 0.0) for i in range(120)], "video string, pos long, combined_activity double")
    assert pipelines.neighbour_detections(near, clips, curve, window_sec=2 / 3, score_threshold=0.8, offset_tolerance=2.0).count() == 0
    frames = spark.createDataFrame(frame("tv", "t", tv), kind)
    assert pipelines.frame_curves(frames, 3).columns == ["category", "video", "pos", "ts", *schema.CURVES]
    bump = 8 * np.exp(-((np.arange(30) - 15) ** 2) / 30)
    signal = np.concatenate([rng.normal(size=100) * 0.1, bump, rng.normal(size=100) * 0.1])
    curves = [("tv", "t", i, i / 3, float(x)) for i, x in enumerate(signal)] + [("commercials", "one", i, i / 3, float(x)) for i, x in enumerate(bump)]
    found = pipelines.curve_detections(spark.createDataFrame(curves, "category string, video string, pos long, ts double, combined_activity double"), clips, smooth_window=300, z_threshold=1.0, min_peak_sec=0.3, match_threshold=0.5).collect()
    assert found and all(r["clip"] == "one" for r in found)


# ---- evaluation ----------------------------------------------------------------------------------------------------


def test_evaluation(spark):
    det = spark.createDataFrame([(1, "t", 0.0, 10.0, "c", 0.9), (2, "t", 1.0, 10.0, "c", 0.9), (3, "t", 50.0, 5.0, "c", 0.8), (4, "t", 0.0, 10.0, "d", 0.7), (5, "t", 10.0, 5.0, "c", 0.95)], schema.DETECTIONS)
    gt = spark.createDataFrame([(1, "t", 0.0, 10.0, "c"), (2, "t", 5.0, 10.0, "d"), (3, "t", 5.0, 10.0, "d"), (4, "other", 0.0, 1.0, "c")], schema.TRUTH)
    labels, metrics, best = pipelines.evaluation(det, gt)
    assert rows(labels.na.fill(-1, ["gt_id"]), "det_id", "label", "gt_id") == [(1, "ok", 1), (2, "dup", 1), (3, "bad", -1), (4, "ok", 2), (5, "bad", -1)]
    m = {r["threshold"]: r for r in metrics.collect()}
    assert set(m) == {0.9, 0.7, 0.0} and (m[0.9]["ok"], m[0.9]["bad"], m[0.9]["dup"], m[0.9]["total"]) == (1, 1, 1, 3)
    assert m[0.7]["recall"] == 2 / 3 and m[0.7]["precision"] == 0.5 and m[0.9]["task"] == 0.0
    assert best.first()["threshold"] == 0.9
    lines = [r["line"] for r in evaluate.report_lines(labels, gt).collect()]
    assert lines[:3] == [" OK) t 0.0 10.0 c 0.9  //IoU=100% (gt=0.0 10.0)", " dp) t 1.0 10.0 c 0.9", " --) t 50.0 5.0 c 0.8"]
    assert evaluate.summary(best).first()["precision"] == 50.0
    nothing = pipelines.evaluation(det, gt.limit(0))[1].collect()
    assert [(r["threshold"], r["ok"], r["bad"], r["task"]) for r in nothing] == [(0.0, 0, 5, 0.0)]


def test_sweep_is_the_same_over_any_ranges(spark):
    rng = random.Random(3)
    data = [(rng.choice([0.0, 0.5, round(rng.random(), 3)]), rng.choice(["ok", "bad", "dup"]), rng.random()) for _ in range(400)]
    labels = spark.createDataFrame(data, "score double, label string, iou double")
    total = spark.createDataFrame([(500,)], "total long")
    want = {}
    for t in {0.0, *(s for s, x, _ in data if x == "ok")}:
        want[t] = tuple(sum(s >= t and x == kind for s, x, _ in data) for kind in ("ok", "bad", "dup"))
    for n in ("1", "2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = evaluate.sweep(labels, total).collect()
        for other in (spark.createDataFrame([(0.2,), (0.7,)], "score double"), labels.select("score").limit(0)):  # cuts from elsewhere
            assert {tuple(r)[:5] for r in evaluate.sweep(labels, total, other).collect()} == {tuple(r)[:5] for r in got}
        assert {r["threshold"]: (r["ok"], r["bad"], r["dup"]) for r in got} == want
        assert all(math.isclose(r["mean_iou"], sum(i for s, x, i in data if x == "ok" and s >= r["threshold"]) / r["ok"]) for r in got if r["ok"])
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.skipif("EVALUATION_DATA" not in os.environ, reason="set EVALUATION_DATA to a folder with published detections and their ground truth")
def test_published_evaluation(spark):
    """The published operating point from the published files: the only ones below the folder whose lines all have
    four columns (truth), or five with most rows (detections)."""
    found = {}
    for path in sorted(Path(os.environ["EVALUATION_DATA"]).rglob("*.txt")):
        lines = [x for x in path.read_text(errors="replace").splitlines() if x and not x.startswith("#")]
        kinds = {x.count("\t") for x in lines}
        if kinds in ({3}, {4}) and len(lines) > found.get(min(kinds), (0, ""))[0]:
            found[min(kinds)] = (len(lines), str(path))
    truth = tables.read_intervals(spark, found[3][1], False)[0].withColumnRenamed("line_no", "gt_id").drop("score")
    detections = tables.read_intervals(spark, found[4][1], True)[0].withColumnRenamed("line_no", "det_id")
    labels, metrics, best = pipelines.evaluation(detections, truth)
    got = evaluate.summary(best).first().asDict()
    assert got == {"threshold": 0.9924, "precision": 89.0, "recall": 78.6, "f1": 0.835, "mean_iou": 0.397, "ok": 81, "bad": 10, "dup": 61, "total": 103, "task": 68.9}
    assert {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()} == {"ok": 92, "bad": 298, "dup": 148}


# ---- sources -------------------------------------------------------------------------------------------------------


def test_interval_files(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_bytes("# tv\tstart\r\n\r\nC:\\d\\X.MPG\t1\t2.0005\t a b (2) \t0.5\r\na\t-1\t2\tb\t1\na\t1\t0\tb\t1\na\t1\t2\tb\t0\na\tx\t2\tb\t1\na\t1\t2\na\t1\t2\tb\n/v/y.mp4\t3\t4\tz.mpg\tnan".encode())
    good, bad = tables.read_intervals(spark, str(path), True)
    assert rows(good.drop("score"), "line_no", "tv", "start", "length", "clip") == [(3, "x", 1.0, 2.001, "a b (2)"), (10, "y", 3.0, 4.0, "z")]
    assert rows(bad, "line_no", "reason") == [(4, "start before zero"), (5, "length not positive"), (6, "score not positive"), (7, "not a number"), (8, "wrong number of columns"), (9, "wrong number of columns")]
    either, _ = tables.read_intervals(spark, str(path))
    assert 9 in [r["line_no"] for r in either.collect()]
    det = spark.createDataFrame([(1, "t", 1.23456, 2.0, "c", 0.987654)], schema.DETECTIONS)
    assert tables.write_intervals(det, f"{tmp_path}/out") and not tables.write_intervals(det.limit(0), f"{tmp_path}/none")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["# tv\tstart\tlength\tclip\tscore", "t\t1.235\t2.0\tc\t0.9877"]


def test_manifests_and_scans(spark, tmp_path):
    for name in ("b.MP4", "a (2).mov", "x.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert rows(tables.videos_in(spark, str(tmp_path), "tv"), "video", "file_order") == [("a (2)", 1), ("b", 2)]
    v = spark.createDataFrame([("tv", "/v/a.mp4", "o", 3, 30.0, 3.0, 1.0, 10.0, 268)], schema.VIDEOS)
    tables.write_manifest(v, f"{tmp_path}/m")
    (tmp_path / "array.json").write_text('[{"category": "tv", "source_path": "/v/b.c.mp4", "num_frames": 4}]')
    assert rows(tables.read_manifest(spark, f"{tmp_path}/m"), "key", "num_frames") == [("tv::a", 3)]
    assert rows(tables.read_manifest(spark, f"{tmp_path}/array.json"), "key", "num_frames") == [("tv::b.c", 4)]
    many = spark.createDataFrame([("tv" if i % 2 else "commercials", f"/v/clip{i % 4}.mp4", "o", i, 30.0, 1.0 + i, 1.0, 10.0, 268) for i in range(12)], schema.VIDEOS)
    tables.write_manifest(many.coalesce(1), f"{tmp_path}/many")
    back = tables.read_manifest(spark, f"{tmp_path}/many")
    assert rows(back, "num_frames") == [(i,) for i in range(12)]
    assert rows(tables.latest(back), "video", "num_frames") == [(f"clip{i}", 8 + i) for i in range(4)]
    assert rows(tables.latest(back, "key"), "key") == [("commercials::clip0",), ("commercials::clip2",), ("tv::clip1",), ("tv::clip3",)]
    assert rows(tables.sampling_rates(back), "video", "sampled_fps") == [(f"clip{i}", 9.0 + i) for i in range(4)]
    (tmp_path / "curves.json").write_text('\n [\n {"category": "tv", "source_path": "x/a.npz",\n "output_path": "one"},\n {"category": "commercials", "source_path": "x/b.npz", "output_path": "two"},\n {"category": "tv", "source_path": "y/a.npz", "output_path": "three"}]')
    assert rows(tables.curve_paths(tables.read_manifest(spark, f"{tmp_path}/curves.json", schema.CURVE_FILES)), "video", "output_path") == [("a", "three")]
    (tmp_path / "empty.json").write_text("[]")
    assert tables.read_manifest(spark, f"{tmp_path}/empty.json").count() == 0
    assert not tables.write_manifest(many.limit(0), f"{tmp_path}/many", even_empty=False) and tables.read_manifest(spark, f"{tmp_path}/many").count() == 12
    assert tables.write_manifest(many.limit(0), f"{tmp_path}/none") and tables.videos_in(spark, f"{tmp_path}/nowhere", "tv").count() == 0
    f = spark.createDataFrame([("tv", "a", 0, 1.0), ("tv", "b", 0, 2.0)], "category string, video string, pos int, ts double")
    tables.write_partitioned(f, f"{tmp_path}/frames")
    tables.write_partitioned(f.where("video = 'a'").withColumn("ts", F.lit(9.0)), f"{tmp_path}/frames")
    assert rows(tables.read_frames(spark, f"{tmp_path}/frames", "video", "ts"), "video", "ts") == [("a", 9.0), ("b", 2.0)]
    assert rows(tables.missing(f, f.where("video = 'a'"), ["category", "video"]), "video") == [("b",)]


def test_video_source_to_vectors(spark, tmp_path):
    np.savez(tmp_path / "clip.npz", fps=6.0, frames=np.random.default_rng(0).integers(0, 255, (9, 10, 14)))
    spark.dataSource.register(video.FrameSource)
    # a file that cannot be opened is skipped
    frames = spark.read.format("frames").option("paths", json.dumps([str(tmp_path / "clip.npz"), str(tmp_path / "absent.npz")])).load()
    assert rows(frames, "video", "pos", "frame_idx", "ts") == [("clip", i, 2 * i, i / 3) for i in range(4)]
    v = topology.frame_vectors(topology.with_diagrams(frames, grid=12)).select("features", "h0").collect()
    assert all(len(r["features"]) == 268 and r["features"][0] == len(r["h0"]) for r in v)
    with pytest.raises(ValueError):
        topology.with_diagrams(frames.withColumn("cells", F.lit(1)))
    # reduced by the reader: the same vectors
    small = spark.read.format("frames").option("paths", json.dumps([str(tmp_path / "clip.npz")])).option("grid", 12).load()
    assert {(r["height"], len(r["pixels"])) for r in small.collect()} == {(12, 144)}
    assert [r["features"] for r in topology.frame_vectors(topology.with_diagrams(small, grid=12)).collect()] == [r["features"] for r in v]


def test_a_video_in_ranges_of_samples(spark, tmp_path):
    rng = np.random.default_rng(0)
    for name, n in (("long, one", 200), ("short", 3), ("broken", 60)):
        np.savez(tmp_path / f"{name}.npz", fps=6.0, frames=rng.integers(0, 255, (n, 6, 8)))
    paths = spark.createDataFrame([(str(tmp_path / f"{n}.npz"),) for n in ("long, one", "short", "broken", "absent")], "path string")
    whole = video.sampled_frames(paths, decoder="tests.test_core:stopping_decoder", samples=1000)
    cut = video.sampled_frames(paths, decoder="tests.test_core:stopping_decoder", samples=7)
    assert cut.groupBy(F.spark_partition_id()).count().count() > 1
    got = [video.until_unreadable(df.withColumn("readable", F.col("pixels").isNotNull())) for df in (whole, cut)]
    a, b = (rows(df, "video", "pos", "frame_idx", "ts", "pixels") for df in got)
    assert a == b and [sum(x[0] == n for x in a) for n in ("long, one", "short", "broken")] == [100, 1, 11]
    assert rows(cut.where("pixels is null"), "video", "pos") == [("broken", 11)]


def stopping_decoder(path):
    """A decoder of arrays that cannot read frame 22 of one of them."""
    native, total, read = video.npz_decoder(path)
    return native, total, lambda i: None if "broken" in path and i == 22 else read(i)


def test_video_files_by_a_library(monkeypatch):
    class Video:
        def __init__(self, path):
            self.path, self.at = path, 0

        def isOpened(self):  # noqa: N802
            return self.path == "good.mp4"

        def get(self, what):
            return {"fps": 6.0, "count": 9.0}[what]

        def set(self, what, index):
            self.at = index

        def read(self):
            return self.at < 7, [[self.at]]

    fake = types.SimpleNamespace(VideoCapture=Video, CAP_PROP_POS_FRAMES="pos", CAP_PROP_FPS="fps", CAP_PROP_FRAME_COUNT="count", COLOR_BGR2GRAY=0, cvtColor=lambda frame, kind: frame)
    monkeypatch.setitem(sys.modules, "cv2", fake)
    reader = video.FrameReader({"paths": '["good.mp4"]', "fps": "3", "decoder": "tidemark.sources.video:opencv_decoder"})
    assert [(r["pos"], r["frame_idx"], r["pixels"]) for batch in reader.read(reader.partitions()[0]) for r in batch.to_pylist()] == [(0, 0, [0.0]), (1, 2, [2.0]), (2, 4, [4.0]), (3, 6, [6.0])]
    with pytest.warns(UserWarning, match="skipped"):
        assert list(reader.read(video.FramePartition("bad.mp4"))) == []


def test_scalars(spark):
    plan = spark.range(1).select(scalars.sampling_plan(F.lit(29.97), F.lit(3.0), F.lit(100)).alias("p")).first()["p"]
    assert [x["frame_idx"] for x in plan] == [round(i * 9.99) for i in range(10)]
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(scalars.sampling_plan(F.lit(0.0), F.lit(3.0), F.lit(9))).collect()
    got = spark.range(1).select(scalars.base_name(F.lit("/a/b\\C d.MPG")).alias("b"), scalars.stem(F.lit("x/y.tar.gz")).alias("s"), scalars.number(F.lit(" 1.5 ")).alias("n"), scalars.number(F.lit("1_0")).alias("m"), scalars.duration(F.lit(9), F.lit(0.0)).alias("d"), scalars.stride(F.lit(30.0), F.lit(3.0)).alias("t"), scalars.stride(F.lit(30.0), F.lit(0.0)).alias("z")).first()
    assert tuple(got) == ("c d", "y.tar", 1.5, None, 0.0, 10.0, 0.0)


# ---- topology ------------------------------------------------------------------------------------------------------


def test_known_diagrams():
    ring = np.zeros((5, 5))
    ring[1:4, 1:4] = 1
    ring[2, 2] = 0.2
    dark = 1 - np.where(ring == 0.2, 0, ring)
    dark = np.ones((5, 5))
    dark[1:4, 1:4] = 0
    dark[2, 2] = 0.8
    assert topology.diagrams(np.ones((4, 4))) == ([], [])
    assert topology.diagrams(np.array([[0.2, 0.7, 0.0]])) == ([(0.2, 0.7)], [])
    assert topology.diagrams(dark) == ([], [(0.0, 0.8)])
    assert topology.diagrams(ring) == ([(0.2, 1.0)], [(0.0, 1.0)])
    assert topology.diagrams(np.zeros((0, 0))) == ([], [])
    assert np.allclose(topology.area_mean(np.arange(16.0).reshape(4, 4), 2), [[2.5, 4.5], [10.5, 12.5]])
    assert np.isclose(topology.area_mean(np.ones((5, 7)), 3), 1).all()


def parts(mask, eight):
    """Components of the true cells by spreading labels until nothing changes: a label of each."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y or x) and (eight or not (y and x))]
    while True:
        ring = np.pad(label, 1)
        new = label.copy()
        for y, x in steps:
            new = np.where(mask, np.maximum(new, ring[1 + y : 1 + y + mask.shape[0], 1 + x : 1 + x + mask.shape[1]]), 0)
        if (new == label).all():
            return set(label[mask].tolist())
        label = new


def test_diagrams_equal_counts_of_parts_and_holes():
    """At every threshold: dark parts, and bright parts shut in by dark ones, counted on the whole image."""
    rng = np.random.default_rng(4)
    for shape in ((1, 9), (6, 7), (8, 8), (12, 5)):
        for levels in (3, 6, 1000):
            image = rng.integers(0, levels, shape) / levels
            h0, h1 = topology.diagrams(image)
            for t in np.unique(image):
                dark = image <= t
                bright = np.pad(~dark, 1, constant_values=True)  # all that lies outside is one bright part
                alive = lambda d: sum(b <= t < e for b, e in d)  # noqa: B023, E731
                assert alive(h0) + 1 == len(parts(dark, True)) and alive(h1) + 1 == len(parts(bright, False))


def test_persistence_image(spark):
    dgm = [(0.1, 0.4), (0.2, 0.9)]
    df = spark.createDataFrame([([{"birth": b, "death": d} for b, d in dgm],), ([],), (None,)], "d array<struct<birth:double,death:double>>")
    got = [r[0] for r in df.select(vectors.persistence_image(F.col("d"))).collect()]
    assert got.pop() is None
    grid = np.linspace(0, 1, 16)
    want = sum((d - b) * np.exp(-((b - grid[None, :]) ** 2 + (d - b - grid[:, None]) ** 2) / (2 * 0.05**2)) for b, d in dgm).ravel()
    assert np.allclose(got[0], want) and got[1] == [0.0] * 256
    stats = df.limit(2).select(vectors.moments(vectors.lifetimes(F.col("d"))).alias("m")).select("m.*").collect()
    assert np.allclose(tuple(stats[0]), (2, 1.0, 0.7, 0.5, 0.2)) and tuple(stats[1]) == (0.0,) * 5
