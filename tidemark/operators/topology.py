"""Sublevel persistent homology of grey images, and the frame vectors made of it.

Pixels are closed top cells, so dark components join across corners. Dimension 0 is a union-find over pixels in order
of brightness, the younger component dying at a merge; all images of a batch go step by step together, a pixel of each. Dimension 1 follows by duality: holes are components of the
bright side, joined across edges only, with everything outside the image as the component that never dies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import vectors
from tidemark.schema import INTERVAL


def _neighbours(rows: int, cols: int, eight: bool) -> np.ndarray:
    """For every pixel those beside it, -1 outside the image."""
    r, c = np.divmod(np.arange(rows * cols), cols)
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if eight else [])
    return np.stack([np.where((r + y >= 0) & (r + y < rows) & (c + x >= 0) & (c + x < cols), (r + y) * cols + c + x, -1) for y, x in steps])


def _merges(values: np.ndarray, eight: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, birth, death) of all components that die as pixels enter by ascending value, of a stack of images; births
    equal to deaths excluded."""
    images, rows, cols = values.shape
    n = rows * cols
    flat = values.reshape(-1)
    order = np.argsort(values.reshape(images, n), axis=1, kind="stable")
    base = np.arange(images) * n
    rank = np.empty(images * n, dtype=np.int64)
    rank[(order + base[:, None]).ravel()] = np.tile(np.arange(n), images)
    near = _neighbours(rows, cols, eight)
    parent = np.full(images * n, -1)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def roots(nodes: np.ndarray) -> np.ndarray:
        up = parent[nodes]
        while (moving := up != nodes).any():
            parent[nodes[moving]] = parent[up[moving]]  # halves the way
            nodes = np.where(moving, parent[nodes], nodes)
            up = parent[nodes]
        return nodes

    for step in range(n):
        local = order[:, step]
        entering = local + base
        parent[entering] = entering
        own = entering.copy()
        for beside in near:
            other = beside[local]
            on = np.flatnonzero((other >= 0) & (parent[np.maximum(other, 0) + base] >= 0))
            if not len(on):
                continue
            a, b = own[on], roots(other[on] + base[on])
            apart = a != b
            on, a, b = on[apart], a[apart], b[apart]
            first = rank[a] < rank[b]
            old, young = np.where(first, a, b), np.where(first, b, a)
            lasting = flat[young] < flat[entering[on]]
            found.append((young[lasting], entering[on][lasting]))
            parent[young] = old
            own[on] = old
    young, at = (np.concatenate(x) if found else np.zeros(0, dtype=np.int64) for x in (list(zip(*found)) or [[], []]))
    return young // n, flat[young], flat[at]


def stacked_diagrams(images: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(image, birth, death) of the finite intervals of dimension 0 and 1 of a stack of images, sorted."""
    images = np.asarray(images, dtype=float)
    ring = np.pad(images, ((0, 0), (1, 1), (1, 1)), constant_values=np.inf)
    low = -images.max(axis=(1, 2)) - 1.0
    upside = np.where(np.isinf(ring), low[:, None, None], -ring)  # the outside enters first and never dies
    zero = _merges(images, True)
    image, birth, death = _merges(upside, False)
    inner = birth > low[image]
    one = image[inner], -death[inner], -birth[inner]
    return tuple(tuple(x[order] for x in side) for side in (zero, one) for order in [np.lexsort((side[2], side[1], side[0]))])


def diagrams(image: np.ndarray) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
    """Finite intervals of dimension 0 and 1."""
    image = np.asarray(image, dtype=float)
    if not image.size:
        return [], []
    return tuple(list(zip(birth.tolist(), death.tolist())) for _, birth, death in stacked_diagrams(image[None]))


def area_mean(image: np.ndarray, size: int) -> np.ndarray:
    """One image or a stack, resized to size x size by the mean of the area that each cell covers."""

    def weights(n: int) -> np.ndarray:
        edges = np.linspace(0, n, size + 1)
        w = np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, None)
        return w / w.sum(axis=1, keepdims=True)

    return weights(image.shape[-2]) @ image @ weights(image.shape[-1]).T


def scaled(image: np.ndarray, guard: float = 1e-6) -> np.ndarray:
    low, high = image.min(axis=(-2, -1), keepdims=True), image.max(axis=(-2, -1), keepdims=True)
    return (image - low) / (high - low + guard)


#: Pixels of images that go through the union-find together.
TOGETHER = 1 << 20
PAIR = pa.struct([("birth", pa.float64()), ("death", pa.float64())])


def with_diagrams(frames: DataFrame, pixels: str = "pixels", height: str = "height", width: str = "width", *, grid: int | None = 48) -> DataFrame:
    """Adds ``h0`` and ``h1``, and ``cells``, the scaled grid they come from; columns of these names are refused.
    Without ``grid`` the pixels are taken as they are. Null and empty images have no intervals and no cells."""
    if clash := {"h0", "h1", "cells"} & {c.lower() for c in frames.columns}:
        raise ValueError(f"columns with names of the result: {sorted(clash)}")
    shape = T.StructType([*frames.schema.fields, T.StructField("h0", INTERVAL), T.StructField("h1", INTERVAL), T.StructField("cells", T.ArrayType(T.DoubleType()))])

    def lists(parts: list[tuple[np.ndarray, pa.Array]], n: int) -> pa.ListArray:
        """A list for each of n rows, from (row of each value, values)."""
        rows = np.concatenate([np.zeros(0, dtype=np.int64), *(r for r, _ in parts)])
        values = pa.concat_arrays([v for _, v in parts])
        order = np.argsort(rows, kind="stable")
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order], np.arange(n + 1)), pa.int32()), values.take(pa.array(order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(pixels))
            high, wide = (np.asarray(batch.column(batch.schema.get_field_index(c)).to_pylist(), dtype=object) for c in (height, width))
            flat = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.array([x or 0 for x in column.value_lengths().to_pylist()], dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            found = {"h0": [(np.zeros(0, dtype=np.int64), pa.array([], PAIR))], "h1": [(np.zeros(0, dtype=np.int64), pa.array([], PAIR))], "cells": [(np.zeros(0, dtype=np.int64), pa.array([], pa.float64()))]}
            kinds: dict[tuple[int, int], list[int]] = {}
            for k, size in enumerate(sizes.tolist()):
                if size:
                    kinds.setdefault((int(high[k]), int(wide[k])), []).append(k)
            for (h, w), rows in kinds.items():
                step = max(1, TOGETHER // max(h * w, (grid or 0) ** 2))
                for at in range(0, len(rows), step):
                    own = np.array(rows[at : at + step])
                    images = flat[starts[own][:, None] + np.arange(h * w)].astype(float).reshape(-1, h, w)
                    images = images if grid is None else scaled(area_mean(images, grid))
                    for name, (image, birth, death) in zip(("h0", "h1"), stacked_diagrams(images)):
                        found[name].append((own[image], pa.StructArray.from_arrays([pa.array(birth), pa.array(death)], fields=list(PAIR))))
                    found["cells"].append((np.repeat(own, images[0].size), pa.array(images.ravel())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(lists(found[c], len(batch)) for c in ("h0", "h1", "cells"))], names=[*batch.schema.names, "h0", "h1", "cells"])

    return frames.mapInArrow(run, shape)


def frame_vectors(frames: DataFrame, *, least: float = 0.005, weight: str = "persistence") -> DataFrame:
    """``features``: five statistics of either diagram, brightness mean and deviation, the image of both diagrams."""
    kept = {h: vectors.persistent(F.col(h), least) for h in ("h0", "h1")}
    stats = {h: vectors.moments(vectors.lifetimes(v)) for h, v in kept.items()}
    bright = vectors.moments(F.col("cells"))
    named = frames.withColumns({**{h: v for h, v in kept.items()}, "s0": stats["h0"], "s1": stats["h1"], "bright": bright})
    image = vectors.persistence_image(F.concat("h0", "h1"), weight=weight)
    five = [F.array(*[F.col(s)[k] for k in ("count", "sum", "max", "mean", "std")]) for s in ("s0", "s1")]
    return named.withColumn("features", F.concat(*five, F.array(F.col("bright.mean"), F.col("bright.std")), image).cast("array<float>")).drop("s0", "s1", "bright")
