"""Neighbourhood operators: separable taps, medians, differences.

Linear taps scatter: each voxel sends its weighted value to the voxels that read it, and one group-by for each axis adds
up. No join is needed, and partial sums are made before the shuffle. A voxel at an end also stands for those beyond.
Rank filters work on blocks (operators.blocks).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES, VECTOR
from voxframe.operators.blocks import ranked


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised taps within truncate * sigma."""
    r = int(truncate * sigma + 0.5)
    taps = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [t / sum(taps) for t in taps]


def convolve_axis(voxels: DataFrame, axis: str, size: int, kernel: list[float], values: tuple[str, ...] = ("v",), keys: tuple[str, ...] = (), edge: str = "nearest") -> DataFrame:
    """One axis of a separable filter with odd, symmetric taps; edge: nearest repeats the ends, constant takes 0 beyond."""
    r = len(kernel) // 2
    tails = [sum(kernel[: i + 1]) for i in range(len(kernel))]  # taps up to and with i
    z, t = F.col(axis), F.col("_t")
    taps, sums = F.array(*map(F.lit, kernel)), F.array(*map(F.lit, tails))
    plain = F.when(F.abs(z - t) <= r, F.element_at(taps, (z - t + r + 1).cast("int"))).otherwise(0.0)
    weight = plain
    if edge == "nearest" and size > 1:
        low = F.when(t <= r, F.element_at(sums, (r - t + 1).cast("int"))).otherwise(0.0)
        high = F.when(size - 1 - t <= r, F.element_at(sums, (r - (size - 1 - t) + 1).cast("int"))).otherwise(0.0)
        weight = F.when(z == 0, low).when(z == size - 1, high).otherwise(plain)
    elif edge == "nearest":
        weight = F.lit(1.0)
    others = [a for a in AXES if a != axis]
    sent = voxels.withColumn("_t", F.explode(F.sequence(F.greatest(z - r, F.lit(0)), F.least(z + r, F.lit(size - 1))))).withColumn("_w", weight)
    return sent.groupBy(*keys, *others, t.alias(axis)).agg(*[F.sum(F.col(v) * F.col("_w")).alias(v) for v in values]).select(*keys, *AXES, *values)


def gaussian(voxels: DataFrame, sigma: float, shape: tuple[int, int, int], values: tuple[str, ...] = ("v",), keys: tuple[str, ...] = (), edge: str = "nearest") -> DataFrame:
    """A separable Gaussian; sigma 0 or less leaves the volume as it is."""
    if sigma <= 0:
        return voxels.select(*keys, *AXES, *values)
    for axis, n in zip(AXES, shape, strict=True):
        voxels = convolve_axis(voxels, axis, n, gaussian_kernel(sigma), values, keys, edge)
    return voxels


def box_mean(voxels: DataFrame, radius: int, shape: tuple[int, int, int], values: tuple[str, ...] = ("v",), keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over cubes of 2 * radius + 1 voxels, ends repeated."""
    k = 2 * radius + 1
    for axis, n in zip(AXES, shape, strict=True):
        voxels = convolve_axis(voxels, axis, n, [1.0 / k] * k, values, keys)
    return voxels


def local_normalise(voxels: DataFrame, radius: int, shape: tuple[int, int, int], value: str = "v", keys: tuple[str, ...] = (), eps: float = 1e-6) -> DataFrame:
    """Value less the local mean, over the local standard deviation plus eps."""
    squares = voxels.withColumn("_m", F.col(value)).withColumn("_s", F.col(value) * F.col(value))
    means = box_mean(squares, radius, shape, ("_m", "_s"), keys)
    sd = F.sqrt(F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    return voxels.join(means, [*keys, *AXES]).select(*keys, *AXES, ((F.col(value) - F.col("_m")) / (sd + eps)).alias(value))


def unsharp(voxels: DataFrame, shape: tuple[int, int, int], amount: float = 0.5, sigma: float = 1.0, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """max(0, v + amount * (v - blurred v))."""
    soft = gaussian(voxels, sigma, shape, (value,), keys).withColumnRenamed(value, "_g")
    out = F.greatest(F.col(value) + amount * (F.col(value) - F.col("_g")), F.lit(0.0))
    return voxels.join(soft, [*keys, *AXES]).select(*keys, *AXES, out.alias(value))


def decimate(voxels: DataFrame, factor: int, shape: tuple[int, int, int], values: tuple[str, ...] = ("v",), keys: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian of half the factor, then every factor-th voxel."""
    soft = gaussian(voxels, 0.5 * factor, shape, values, keys)
    there = [F.col(a) % factor == 0 for a in AXES]
    return soft.where(there[0] & there[1] & there[2]).select(*keys, *[(F.col(a) / factor).cast("int").alias(a) for a in AXES], *values)


def median(voxels: DataFrame, window: int, shape: tuple[int, int, int], value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """The median over cubes of `window` voxels, ends mirrored; the upper one of an even number. Needs size >= window."""
    return ranked(voxels, window, shape, value, keys)


def median_ball(voxels: DataFrame, shape: tuple[int, int, int], value: str = "v", keys: tuple[str, ...] = (), square: int = 2) -> DataFrame:
    """The median over the voxels no farther than the root of `square` (19 of them for 2), ends mirrored."""
    r = math.isqrt(square)
    d = np.indices((2 * r + 1,) * 3) - r
    return ranked(voxels, 2 * r + 1, shape, value, keys, (d * d).sum(0) <= square)


def gradient(voxels: DataFrame, axis: str, spacing: float, values: tuple[str, ...], keys: tuple[str, ...] = (), prefix: str = "d") -> DataFrame:
    """Adds d<axis>_<value>: central differences, one-sided at the ends. A dense axis of two voxels or more."""
    order = Window.partitionBy(*keys, *[a for a in AXES if a != axis]).orderBy(axis)
    out = {}
    for v in values:
        before, after = F.lag(v).over(order), F.lead(v).over(order)
        out[f"{prefix}{axis}_{v}"] = F.when(before.isNull(), (after - F.col(v)) / spacing).when(after.isNull(), (F.col(v) - before) / spacing).otherwise((after - before) / (2 * spacing))
    return voxels.withColumns(out)


def jacobian(field: DataFrame, spacing: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, z, y, x, det): the determinant of the identity plus the displacement's gradient."""
    g = field
    for axis in AXES:
        g = gradient(g, axis, spacing, VECTOR, keys)
    m = [[F.col(f"d{a}_{u}") + (1.0 if i == j else 0.0) for j, a in enumerate(AXES)] for i, u in enumerate(VECTOR)]
    det = (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))
    return g.select(*keys, *AXES, det.alias("det"))


def folds(determinants: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, folds): the share of voxels whose determinant is not positive."""
    return determinants.groupBy(*keys).agg(F.avg((F.col("det") <= 0).cast("double")).alias("folds"))


def shift(voxels: DataFrame, offset: tuple[int, int, int], shape: tuple[int, int, int], values: tuple[str, ...] = ("v",), keys: tuple[str, ...] = ()) -> DataFrame:
    """out[i] = v[i + offset], ends repeated: key arithmetic, the end voxels copied to those that read past them."""
    out = voxels
    for a, k, n in zip(AXES, offset, shape, strict=True):
        z = F.col(a)
        if k >= 0:
            first = F.greatest(z - k, F.lit(0))
            last = F.when(z == n - 1, F.lit(n - 1)).otherwise(z - k)
        else:
            first = F.when(z == 0, F.lit(0)).otherwise(z - k)
            last = F.least(z - k, F.lit(n - 1))
        out = out.where(first <= last).withColumn(a, F.explode(F.sequence(first, last)))
    return out.select(*keys, *AXES, *values)
