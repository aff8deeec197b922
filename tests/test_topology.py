"""Diagrams of stacks of images against a plain union-find, image by image."""

import numpy as np
import pytest

from tidemark.operators import topology


def plain_merges(image, eight):
    """Deaths by the elder rule, with sets of pixels."""
    h, w = image.shape
    order = sorted((float(image[r, c]), r, c) for r in range(h) for c in range(w))
    parts, out = [], []
    for step, (x, r, c) in enumerate(order):
        touching = [p for p in parts if any(max(abs(r - y), abs(c - z)) == 1 if eight else abs(r - y) + abs(c - z) == 1 for _, y, z in p["cells"])]
        touching.sort(key=lambda p: p["step"])
        merged = {"step": step, "birth": x, "cells": {(x, r, c)}}
        for p in touching:
            parts.remove(p)
        if touching:
            out += [(p["birth"], x) for p in touching[1:] if p["birth"] < x]
            merged = {"step": touching[0]["step"], "birth": touching[0]["birth"], "cells": {(x, r, c)}.union(*(p["cells"] for p in touching))}
        parts.append(merged)
    return sorted(out)


def plain(image):
    ring = np.pad(image, 1, constant_values=np.inf)
    low = -image.max() - 1.0
    upside = np.where(np.isinf(ring), low, -ring)
    return plain_merges(image, True), sorted((-d, -b) for b, d in plain_merges(upside, False) if b > low)


@pytest.mark.parametrize("shape", [(1, 1), (1, 6), (3, 4), (6, 6)])
def test_stacks(shape):
    rng = np.random.default_rng(sum(shape))
    for images in (rng.random((12, *shape)), rng.integers(0, 3, (12, *shape)).astype(float), np.ones((2, *shape))):
        sides = topology.stacked_diagrams(images)
        for k, image in enumerate(images):
            assert tuple([(b, d) for i, b, d in zip(*side) if i == k] for side in sides) == plain(image)


def test_tables_with_images_of_several_sizes_and_none(spark):
    rng = np.random.default_rng(1)
    images = [rng.random((h, w)) for h, w in ((3, 4), (5, 2), (3, 4), (1, 1), (6, 6)) * 5]
    rows = [(k, x.ravel().tolist(), *x.shape, "x") for k, x in enumerate(images)] + [(100, None, None, None, "x"), (101, [], 0, 0, "x")]
    df = spark.createDataFrame(rows, "key long, pixels array<double>, height int, width int, birth string").repartition(3)
    got = {r["key"]: r for r in topology.with_diagrams(df, grid=None).collect()}
    for k, x in enumerate(images):
        assert tuple([tuple(p) for p in got[k][h]] for h in ("h0", "h1")) == plain(x) and got[k]["cells"] == x.ravel().tolist() and got[k]["birth"] == "x"
    assert all(got[k][c] == [] for k in (100, 101) for c in ("h0", "h1", "cells"))
    small = {r["key"]: r["cells"] for r in topology.with_diagrams(df, grid=2).collect()}
    assert all(np.allclose(small[k], topology.scaled(topology.area_mean(x, 2)).ravel()) for k, x in enumerate(images))
    assert topology.with_diagrams(df.limit(0), grid=2).count() == 0
