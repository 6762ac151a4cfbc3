"""Mean pooling and pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES


def pool(voxels: DataFrame, factor: int, values: tuple[str, ...] = ("v",), keys: tuple[str, ...] = (), shape: tuple[int, int, int] | None = None, integer: bool = False) -> DataFrame:
    """Means over cubes of factor voxels an axis: one group-by, partially aggregated before its shuffle.

    A ragged end is padded with its last plane: with `shape` given, voxels of a last plane that stands for
    the missing ones weigh more. Without it the mean is over the voxels there are (the same for factor 2).
    integer: results are cut to whole numbers, as stored levels of an integer volume are.
    """
    weight = F.lit(1.0)
    for axis, n in zip(AXES, shape or (), strict=False):
        rest = n % factor
        if rest:
            weight = weight * F.when(F.col(axis) == n - 1, float(factor - rest + 1)).otherwise(1.0)
    cube = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]
    means = [(F.sum(F.col(v) * weight) / F.sum(weight)).alias(v) for v in values]
    if integer:
        means = [F.floor(m).cast("long").alias(v) for m, v in zip(means, values, strict=True)]
    return voxels.groupBy(*keys, *cube).agg(*means)


def pyramid(voxels: DataFrame, levels: int, values: tuple[str, ...] = ("v",), keys: tuple[str, ...] = (), integer: bool = False) -> DataFrame:
    """All levels with a column `level`; each pools the one below. Level 0 is the input."""
    out, now = voxels.select(F.lit(0).alias("level"), *keys, *AXES, *values), voxels
    for level in range(1, levels + 1):
        now = pool(now, 2, values, keys, integer=integer)
        out = out.unionByName(now.select(F.lit(level).alias("level"), *keys, *AXES, *values))
    return out


def upsample_nearest(lattice: DataFrame, factor: int, shape: tuple[int, int, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """Each lattice voxel repeated factor times an axis, cut to shape; no join, the copies are generated."""
    out = lattice
    for axis, n in zip(AXES, shape, strict=True):
        first = F.col(axis) * factor
        out = out.where(first < n).withColumn(axis, F.explode(F.sequence(first, F.least(first + factor - 1, F.lit(n - 1)))))
    return out
