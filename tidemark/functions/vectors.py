"""Array-valued columns: linear algebra, scaling and statistics with higher-order functions, in double precision;
persistence images in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column, f=lambda x: x) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(v, lambda x: x * x))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda an outer expression would be computed each time."""
    return F.transform(F.array(value), use)[0]


def normalised(v: Column, least: float = 1e-9) -> Column:
    """Unit length; a vector shorter than ``least`` is left as it is."""
    return bound(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n < least, 1.0).otherwise(n)))


def centred_unit(v: Column, least: float = 1e-6) -> Column:
    """Mean-centred and of unit length; a constant vector gives zeros."""

    def scaled(c: Column) -> Column:
        return bound(norm(c), lambda n: F.transform(c, lambda x: F.when(n < least, 0.0).otherwise(x / n)))

    return bound(bound(_sum(v) / F.nullif(F.size(v), F.lit(0)), lambda m: F.transform(v, lambda x: x.cast("double") - m)), scaled)


def min_max_scaled(v: Column, guard: float = 1e-6) -> Column:
    """(x - min) / (max - min + guard)."""
    ends = F.struct(F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high"))
    return bound(ends, lambda e: F.transform(v, lambda x: (x.cast("double") - e["low"]) / (e["high"] - e["low"] + guard)))


def moments(v: Column) -> Column:
    """Struct of count, sum, max, mean and population deviation; zeros for an empty array."""

    def spread(s: Column) -> Column:
        n, mean, zero = F.size(v), s["mean"], F.lit(0.0)
        some = n > 0
        return F.struct(
            n.cast("double").alias("count"),
            F.when(some, s["sum"]).otherwise(zero).alias("sum"),
            F.when(some, F.array_max(v).cast("double")).otherwise(zero).alias("max"),
            F.when(some, mean).otherwise(zero).alias("mean"),
            F.when(some, F.sqrt(_sum(v, lambda x: (x - mean) * (x - mean)) / n)).otherwise(zero).alias("std"),
        )

    return bound(F.struct(_sum(v).alias("sum"), F.try_divide(_sum(v), F.size(v)).alias("mean")), spread)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def lifetimes(diagram: Column) -> Column:
    """max(death - birth, 0) of the finite intervals; the essential class drops out."""
    kept = F.filter(diagram, lambda p: finite(p["birth"]) & finite(p["death"]))
    return F.transform(kept, lambda p: F.greatest(p["death"] - p["birth"], F.lit(0.0)))


def persistent(diagram: Column, least: float) -> Column:
    """Finite intervals that live longer than ``least``."""
    return F.filter(diagram, lambda p: finite(p["birth"]) & finite(p["death"]) & (p["death"] - p["birth"] > least))


def parts(v: Column) -> dict[str, Column]:
    """The four parts of a frame vector: two sets of five statistics, brightness, image."""
    return {"h0": F.slice(v, 1, 5), "h1": F.slice(v, 6, 5), "brightness": F.slice(v, 11, 2), "image": F.slice(v, 13, F.greatest(F.size(v) - 12, F.lit(0)))}


def curves(v: Column) -> dict[str, Column]:
    """The twelve curve values of a frame vector, by name."""
    p = parts(v)
    out = {f"{h}_{name}": p[h][k].cast("double") for h in ("h0", "h1") for k, name in ((0, "count"), (1, "sum"), (2, "max"), (4, "std"))}
    out |= {"brightness_mean": p["brightness"][0].cast("double"), "brightness_std": p["brightness"][1].cast("double"), "pi_energy": norm(p["image"])}
    return out | {"combined_activity": out["h1_sum"] + out["pi_energy"]}


def persistence_image(diagram: Column, *, bandwidth: float = 0.05, resolution: int = 16, low: float = 0.0, high: float = 1.0, weight: str = "persistence") -> Column:
    """Weighted Gaussians on a grid over (birth, persistence), birth running fastest.

    weight: ``persistence``, or ``difference`` for persistence minus birth. A null diagram gives null. A Gaussian is
    the product of one along each axis, so an image is a product of two small matrices: in Arrow batches that takes
    32 exponentials a pair, where an expression over all cells takes 256.
    """
    axis = low + np.arange(resolution) * ((high - low) / (resolution - 1))
    share = 1.0 / (2.0 * bandwidth * bandwidth)

    @F.arrow_udf("array<double>")
    def image(births: pa.Array, deaths: pa.Array) -> pa.Array:
        size = births.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        b, d = (x.flatten().to_numpy(zero_copy_only=False) for x in (births, deaths))
        life = d - b
        along_birth = np.exp(-((b[:, None] - axis) ** 2) * share)
        along_life = np.exp(-((life[:, None] - axis) ** 2) * share) * (life if weight == "persistence" else life - b)[:, None]
        ends = np.cumsum(size)
        out = np.zeros((len(size), resolution * resolution))
        for k, (x, y) in enumerate(zip((ends - size).tolist(), ends.tolist())):
            if x < y:
                out[k] = (along_life[x:y].T @ along_birth[x:y]).ravel()
        offsets = pa.array(np.arange(len(size) + 1, dtype=np.int32) * resolution * resolution)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=births.is_null())

    return image(F.transform(diagram, lambda p: p["birth"].cast("double")), F.transform(diagram, lambda p: p["death"].cast("double")))
