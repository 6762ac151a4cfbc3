"""Sampling volumes at fractional places: warps, compositions and resampling.

A place meets the block of voxels around it (operators.blocks); values are interpolated there on arrays, all columns
at once, and places come back with what they carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES, VECTOR
from voxframe.operators.blocks import interpolated, snapped
from voxframe.operators.tiling import Grid

PLACES = ("cz", "cy", "cx")


def sample(places: DataFrame, volume: DataFrame, shape: tuple[int, int, int], values: tuple[str, ...], boundary: str = "constant", cval: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """places (any columns, with cz, cy, cx) and the interpolated values of volume (keys, z, y, x, values).

    boundary: constant gives cval wherever an axis lies outside [0, n - 1]; nearest clamps to the ends; fade
    takes 0 for voxels beyond, so that a place less than a voxel outside keeps part of the value. Voxels
    without a row count as 0. Columns of places must identify its rows; keys are in both.
    """
    at, inside = places.columns, F.lit(True)
    moved = places.withColumns({"_" + p: snapped(F.col(p)) for p in PLACES})
    for p, n in zip(PLACES, shape, strict=True):
        if boundary == "nearest":
            moved = moved.withColumn("_" + p, F.least(F.greatest(F.col("_" + p), F.lit(0.0)), F.lit(n - 1.0)))
        elif boundary == "constant":
            inside = inside & (F.col("_" + p) >= 0) & (F.col("_" + p) <= n - 1)
    got = interpolated(moved, volume, shape, values, tuple("_" + p for p in PLACES), inside, float(cval), keys)
    return got.select(*[c for c in at if c not in values], *values)


def displaced(field: DataFrame, spacing: float, vector: tuple[str, ...] = VECTOR) -> DataFrame:
    """field with the place, in voxels, that each voxel's displacement (mm) points to."""
    return field.withColumns({p: F.col(a) + F.col(u) / spacing for p, a, u in zip(PLACES, AXES, vector, strict=True)})


def warp(image: DataFrame, field: DataFrame, shape: tuple[int, int, int], spacing: float, values: tuple[str, ...] = ("v",), keys: tuple[str, ...] = (), image_keys: tuple[str, ...] = (), cval: float = 0.0) -> DataFrame:
    """image(x + u(x)) for each voxel of the field; cval outside. image_keys: keys that the image has too."""
    return sample(displaced(field, spacing), image, shape, values, "constant", cval, image_keys).select(*keys, *AXES, *values)


def compose(inner: DataFrame, outer: DataFrame, shape: tuple[int, int, int], spacing: float, keys: tuple[str, ...] = (), outer_keys: tuple[str, ...] = ()) -> DataFrame:
    """inner(x) + outer(x + inner(x)), the displacement of going through inner, then outer; ends clamp."""
    names = {u: "i" + u for u in VECTOR}
    places = displaced(inner, spacing).withColumnsRenamed(names)
    met = sample(places, outer, shape, VECTOR, "nearest", keys=outer_keys)
    return met.select(*keys, *AXES, *[(F.col("i" + u) + F.col(u)).alias(u) for u in VECTOR])


def dense(spark, shape: tuple[int, int, int]) -> DataFrame:
    """Every voxel of a grid."""
    z, y, x = shape
    i = F.col("id")
    return spark.range(z * y * x).select(F.floor(i / (y * x)).cast("int").alias("z"), (F.floor(i / x) % y).cast("int").alias("y"), (i % x).cast("int").alias("x"))


def resample(volume: DataFrame, source: Grid, target: Grid, values: tuple[str, ...] = ("v",), boundary: str = "nearest") -> DataFrame:
    """Values of a volume (or a field, in mm) on another grid, by world position."""
    places = dense(volume.sparkSession, target.shape)
    places = places.withColumns({p: (F.col(a) * target.spacing + t - s) / source.spacing for p, a, s, t in zip(PLACES, AXES, source.origin, target.origin, strict=True)})
    return sample(places, volume, source.shape, values, boundary).select(*AXES, *values)


def affine(volume: DataFrame, shape: tuple[int, int, int], matrix: list[list[float]], target: tuple[int, int, int], background: float = 0.0, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """A view of a volume through a 3x4 matrix from target voxels to its own; background outside."""
    places = dense(volume.sparkSession, target)
    places = places.withColumns({p: row[0] * F.col("z") + row[1] * F.col("y") + row[2] * F.col("x") + F.lit(float(row[3])) for p, row in zip(PLACES, matrix, strict=True)})
    return sample(places, volume, shape, values, "constant", background).select(*AXES, *values)
