"""Peaks against clips by the definition: pieces of series, short and long clips, ties, constants, nulls."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import matching


def correlation(a, b):
    a, b = a - a.mean(), b - b.mean()
    size = np.sqrt((a * a).sum()), np.sqrt((b * b).sum())
    return 0.0 if min(size) < 1e-6 else float((a * b).sum() / (size[0] * size[1]))


def brute(series, peaks, clips):
    out = {}
    for video, at in peaks:
        x = series[video]
        found = []
        for order, (clip, y) in enumerate(clips.items()):
            if len(y) <= len(x):
                first = max(0, min(at - len(y) // 2, len(x) - len(y)))
                found.append((-round(correlation(x[first : first + len(y)], y), 9), order, clip))
        if found:
            score, _, clip = min(found)
            out[video, at] = (clip, -score)
    return out


def got(spark, series, peaks, clips, **more):
    s = spark.createDataFrame([(v, p, float(x)) for v, xs in series.items() for p, x in enumerate(xs)], "video string, pos long, x double").repartition(4)
    c = spark.createDataFrame([(n, k, p, float(x)) for k, (n, xs) in enumerate(clips.items()) for p, x in enumerate(xs)], "clip string, clip_order long, pos long, x double")
    g = spark.createDataFrame([(v, at, at) for v, at in peaks], "video string, seg_start long, peak_pos long")
    return {(r["video"], r["peak_pos"]): (r["clip"], r["score"]) for r in matching.match_peaks(g, s, c, **more).collect()}


def same(have, want):
    assert set(have) == set(want)
    for k, (clip, score) in want.items():
        assert have[k][0] == clip and abs(have[k][1] - score) < 1e-8, k


@pytest.mark.parametrize("piece", [40, 1 << 16])
def test_pieces_and_clamped_slices(spark, piece):
    rng = np.random.default_rng(piece)
    series = {"a": rng.normal(size=700).cumsum(), "b": np.concatenate([np.ones(60), rng.normal(size=200)]) + 1e4, "c": rng.normal(size=9), "flat": np.full(50, 3.0)}
    clips = {f"k{n}{i}": rng.normal(size=n).cumsum() for n in (1, 5, 7, 8, 33, 90) for i in range(3)}
    clips |= {"part": series["a"][300:333].copy(), "twin": series["a"][300:333] * 2 + 1, "even": np.ones(33), "huge": rng.normal(size=5000)}
    peaks = [(v, int(p)) for v, xs in series.items() for p in {0, len(xs) - 1, *rng.integers(0, len(xs), 40)}]
    want = brute(series, peaks, clips)
    same(got(spark, series, peaks, clips, piece=piece), want)
    assert got(spark, series, [("a", 316)], clips, piece=piece)["a", 316][0] == "part"


def test_long_clips_by_transform(spark):
    rng = np.random.default_rng(5)
    series = {"a": rng.normal(size=4000), "b": rng.normal(size=900)}
    clips = {f"k{i}": rng.normal(size=700) for i in range(4)}
    peaks = [("a", int(p)) for p in range(0, 4000, 9)] + [("b", 5), ("b", 899)]
    same(got(spark, series, peaks, clips), brute(series, peaks, clips))


def test_nothing_to_match(spark):
    assert got(spark, {"a": np.arange(5.0)}, [("a", 2)], {"k": np.arange(9.0)}) == {}
    have = got(spark, {"a": np.arange(9.0), "bad": np.array([1.0, np.nan, 2.0, 3.0])}, [("a", 2), ("bad", 1), ("gone", 0)], {"bad": np.array([1.0, np.nan]), "k": np.arange(3.0)})
    assert have == {("a", 2): ("k", 1.0)}


def test_bounds_are_above_all_correlations():
    rng = np.random.default_rng(7)
    s = matching.Slices(rng.normal(size=500).cumsum() + 100, np.array([300, 200]))
    for m in (1, 2, 5, 8, 40):
        at = rng.integers(0, 300 - m, 30)
        mean, length = s.moments(at, m)
        own = np.array([s.x[k : k + m] for k in at])
        assert np.allclose(mean, own.mean(axis=1)) and np.allclose(length, np.sqrt(((own - own.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)), atol=1e-7)
        if m > 1:
            unit = (own - own.mean(axis=1, keepdims=True)) / length[:, None]
            parts = s.parts(at, m, mean, length)
            bound = parts @ parts.T + matching._rest(parts)[:, None] * matching._rest(parts)
            assert (bound + 1e-9 >= unit @ unit.T).all()


def in_process(series, peaks, clips, own=None):
    """The task itself on whole series, without Spark."""
    places = [[{"seg_start": p, "peak": p} for v, p in peaks if v == name] for name in series]
    left = pa.table({
        "video": list(series), "low": pa.array([0] * len(series), pa.int64()), "n": pa.array([len(x) for x in series.values()], pa.int64()), "x": [x.tolist() for x in series.values()],
        "own_order": pa.array([(own or {}).get(v) for v in series], pa.int64()), "peaks": pa.array(places, pa.list_(pa.struct([("seg_start", pa.int64()), ("peak", pa.int64())]))),
    })
    right = pa.table({"x": [y.tolist() for y in clips.values()], "clip": list(clips), "clip_order": pa.array(range(len(clips)), pa.int64())})
    out = matching._matcher(1e-6, [pa.string(), pa.string()])(left, right).to_pylist()
    return {(r["video"], r["peak_pos"]): (r["clip"], r["score"]) for r in out}


@pytest.mark.parametrize("smooth", [False, True])
def test_few_pairs_take_double_precision(monkeypatch, smooth):
    rng = np.random.default_rng(11)
    make = (lambda n: rng.normal(size=n).cumsum()) if smooth else (lambda n: rng.normal(size=n))
    series = {f"s{i}": make(int(rng.integers(40, 70))) for i in range(30)}
    clips = {f"k{i}": make((33, 45)[i % 2]) for i in range(1200)} | {"flat": np.ones(33), "late": series["s3"][:33] * 3 - 1, "later": series["s3"][:33] + 2}
    peaks = [(v, int(p)) for v, x in series.items() for p in rng.choice(len(x), 6, replace=False)] + [("s3", 0)]
    peaks = sorted(set(peaks))
    pairs, settle = [], matching._settle
    monkeypatch.setattr(matching, "TILE_CLIPS", 32)
    monkeypatch.setattr(matching, "WAITING", 400)
    monkeypatch.setattr(matching, "_settle", lambda *a: (pairs.append(len(a[4])), settle(*a)))
    have = in_process(series, peaks, clips)
    same(have, brute(series, peaks, clips))
    assert have["s3", 0][0] == "late"
    assert sum(pairs) < len(peaks) * len(clips) / 20


def test_bounds_take_the_place_of_products(monkeypatch):
    rng = np.random.default_rng(13)
    series = {f"s{i}": np.sin(np.arange(64) / 9 + i) + rng.normal(size=64) / 50 for i in range(8)}
    clips = {f"k{i}": np.sin(np.arange(40) / (3 + i % 40) + i) + rng.normal(size=40) / 50 for i in range(640)}
    peaks = [(v, p) for v in series for p in (5, 20, 30, 44)]
    want, tiles = brute(series, peaks, clips), []
    monkeypatch.setattr(matching, "TILE_CLIPS", 16)
    monkeypatch.setattr(matching, "LEFT", 0.5)
    run = matching._tiles
    monkeypatch.setattr(matching, "_tiles", lambda *a: run(*a[:5], lambda some, k: (tiles.append(k), a[5](some, k))[1], a[6]))
    same(in_process(series, peaks, clips), want)
    assert len(tiles) < 20  # of 40


def test_copies_of_clips(spark):
    rng = np.random.default_rng(17)
    made = {f"a{i}": rng.normal(size=(20, 25, 25, 31)[i % 4]) for i in range(8)}
    clips = {f"{v}c{k}": y for k in range(5) for v, y in made.items()}
    series = {f"{v}s": np.concatenate([y, rng.normal(size=12)]) for v, y in made.items()} | {"a5 itself": made["a5"]}
    peaks = [(v, p) for v, x in series.items() for p in range(0, len(x), 4)]
    have = got(spark, series, peaks, clips)
    same(have, brute(series, peaks, clips))
    assert {clip[-2:] for clip, _ in have.values()} == {"c0"} and have["a5 itself", 8] == ("a5c0", 1.0)


def test_a_series_that_is_a_clip_needs_no_products(monkeypatch):
    rng = np.random.default_rng(19)
    series = {f"s{i}": rng.normal(size=(30, 31, 36)[i % 3]) for i in range(60)}
    clips = {"earlier": series["s7"] * 2 - 5, "part": series["s8"][3:34] + 1} | series | {"later": series["s9"] * 4}
    peaks = [(v, p) for v in series for p in (0, 9, 18, 29)]
    want, own = brute(series, peaks, clips), {v: k for k, v in enumerate(clips)}
    same(in_process(series, peaks, clips), want)
    same(in_process({"flat": np.ones(30)}, [("flat", 3)], clips | {"flat": np.ones(30)}, {"flat": len(clips)}), {("flat", 3): ("s0", 0.0)})
    monkeypatch.setattr(matching, "_tiles", None)
    same(in_process(series, peaks, clips, own), want)
    assert want["s7", 9][0] == "earlier" and want["s8", 18][0] == "part" and want["s9", 9][0] == "s9"
    # the clip itself in another task: nothing here is as good, but for the earlier ones
    others = {v: y for v, y in clips.items() if v not in series}
    assert {v for v, _ in in_process(series, peaks, others, {v: 3 for v in series})} == {"s7", "s8", "s9"}
