"""From overlapping chunk results to one field, and from fields to a template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES, VECTOR
from voxframe.operators.gather import compose, warp
from voxframe.operators.stencil import gaussian, unsharp
from voxframe.operators.tiling import window


def blend(parts: DataFrame, shape: tuple[int, int, int], core: int, halo: int, values: tuple[str, ...] = VECTOR, keys: tuple[str, ...] = (), kind: str = "hann", sigma: float = 0.0) -> DataFrame:
    """Weighted means of chunk results where padded boxes overlap (parts: keys, iz, iy, ix, z, y, x, values).

    Weights are 1 on a chunk's core and fall to 0 through its halo, so the sum of weights is 1 or more on
    every voxel that a core holds. sigma smooths the result, ends repeated.
    """
    w = window(shape, core, halo, kind)
    weighed = parts.withColumn("_w", w).where("_w > 0")
    out = weighed.groupBy(*keys, *AXES).agg(*[(F.sum(F.col("_w") * F.col(v)) / F.sum("_w")).alias(v) for v in values])
    return gaussian(out, sigma, shape, values, keys)


def accumulate(warped: DataFrame, fields: DataFrame) -> DataFrame:
    """(z, y, x, isum, sz, sy, sx, n): sums over subjects of warped intensity and of displacement."""
    a = warped.groupBy(*AXES).agg(F.sum("v").alias("isum"), F.count(F.lit(1)).alias("n"))
    b = fields.groupBy(*AXES).agg(*[F.sum(u).alias("s" + u[1]) for u in VECTOR])
    return a.join(b, list(AXES))


def mean_template(voxels: DataFrame) -> DataFrame:
    """The voxelwise mean over subjects."""
    return voxels.groupBy(*AXES).agg(F.avg("v").alias("v"))


def mean_motion(sums: DataFrame, n: int, eps: float = 0.25) -> DataFrame:
    """-eps times the mean displacement: the step that takes a template's bias out."""
    return sums.select(*AXES, *[(F.col("s" + u[1]) * (-eps / n)).alias(u) for u in VECTOR])


def update(sums: DataFrame, shape: tuple[int, int, int], spacing: float, n: int, eps: float = 0.25, sharpen: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(template, motion): the mean image warped by the motion, sharpened if asked."""
    motion = mean_motion(sums, n, eps)
    template = warp(sums.select(*AXES, (F.col("isum") / n).alias("v")), motion, shape, spacing)
    return (unsharp(template, shape, sharpen) if sharpen else template), motion


def settled(fields: DataFrame, motion: DataFrame, shape: tuple[int, int, int], spacing: float, keys: tuple[str, ...]) -> DataFrame:
    """Fields with the template's last motion composed in."""
    subjects = fields.select(*keys).distinct()
    return compose(motion.crossJoin(F.broadcast(subjects)), fields, shape, spacing, keys, keys)
