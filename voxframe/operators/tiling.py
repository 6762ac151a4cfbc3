"""Chunk geometry: cores tile a grid exactly, padded boxes reach a halo beyond; all of it arithmetic on keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES


@dataclass(frozen=True)
class Grid:
    """An isotropic, axis-aligned sampling grid: world = origin + spacing * voxel."""

    shape: tuple[int, int, int]
    spacing: float
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def coarsened(self, factor: int) -> Grid:
        """The grid of voxels pooled by factor."""
        shift = self.spacing * (factor - 1) / 2
        return Grid(tuple(-(-n // factor) for n in self.shape), self.spacing * factor, tuple(o + shift for o in self.origin))

    def same(self, other: Grid) -> bool:
        near = lambda a, b: math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
        return self.shape == other.shape and near(self.spacing, other.spacing) and all(map(near, self.origin, other.origin))


def depth(shape: tuple[int, int, int], core: int) -> int:
    """Levels above the full resolution until the grid fits into one core."""
    return max(0, math.ceil(math.log2(max(shape) / core)))


def grids(spark: SparkSession, grid: Grid, core: int) -> DataFrame:
    """(level, nz, ny, nx, spacing_mm, oz, oy, ox) of every pyramid level."""
    level, two = F.col("level"), F.pow(F.lit(2.0), F.col("level"))
    sizes = [F.ceil(F.lit(float(n)) / two).cast("int").alias("n" + a) for a, n in zip(AXES, grid.shape, strict=True)]
    origins = [(F.lit(float(o)) + grid.spacing * (two - 1) / 2).alias("o" + a) for a, o in zip(AXES, grid.origin, strict=True)]
    return spark.range(depth(grid.shape, core) + 1).select(F.col("id").cast("int").alias("level")).select(level, *sizes, (grid.spacing * two).alias("spacing_mm"), *origins)


def tile(spark: SparkSession, shape: tuple[int, int, int], core: int, halo: int) -> DataFrame:
    """One row a chunk: id (lexicographic), index, core box and padded box, both cut at the grid's ends."""
    n = [-(-s // core) for s in shape]
    rows = spark.range(n[0] * n[1] * n[2]).select(F.col("id").cast("int").alias("chunk_id"))
    index = {"z": F.floor(F.col("chunk_id") / (n[1] * n[2])), "y": F.floor(F.col("chunk_id") / n[2]) % n[1], "x": F.col("chunk_id") % n[2]}
    rows = rows.select("chunk_id", *[c.cast("int").alias("i" + a) for a, c in index.items()])
    for a, s in zip(AXES, shape, strict=True):
        low = F.col("i" + a) * core
        high = F.least(low + core, F.lit(s))
        start = F.greatest(low - halo, F.lit(0))
        rows = rows.withColumns({f"core_{a}0": low, f"core_n{a}": high - low, f"pad_{a}0": start, f"pad_n{a}": F.least(high + halo, F.lit(s)) - start})
    return rows


def halo_expand(voxels: DataFrame, shape: tuple[int, int, int], core: int, halo: int) -> DataFrame:
    """Each voxel once for every chunk whose padded box holds it, with the chunk's index and id; no join."""
    out = voxels
    n = [-(-s // core) for s in shape]
    for a, k in zip(AXES, n, strict=True):
        first = F.greatest(F.ceil((F.col(a) - halo - core + 1) / core), F.lit(0))
        last = F.least(F.floor((F.col(a) + halo) / core), F.lit(k - 1))
        out = out.withColumn("i" + a, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return out.withColumn("chunk_id", (F.col("iz") * n[1] + F.col("iy")) * n[2] + F.col("ix"))


def touching(chunks: DataFrame, boxes: DataFrame, core: int, halo: int, margin: int = 0) -> DataFrame:
    """Chunks whose padded box meets a box (box_id, iz, iy, ix of its home chunk, box_{a}0, box_n{a}).

    An interval join as an equi-join: boxes are repeated to the home keys in reach, the exact test follows.
    """
    reach = math.ceil((halo + margin) / core)
    near = boxes
    for a in AXES:
        near = near.withColumn("k" + a, F.explode(F.sequence(F.col("i" + a) - reach, F.col("i" + a) + reach))).drop("i" + a)
    keyed = chunks.withColumnsRenamed({"i" + a: "k" + a for a in AXES})
    meet = None
    for a in AXES:
        low, high = F.greatest(f"pad_{a}0", f"box_{a}0"), F.least(F.col(f"pad_{a}0") + F.col(f"pad_n{a}"), F.col(f"box_{a}0") + F.col(f"box_n{a}"))
        meet = high > low if meet is None else meet & (high > low)
    return keyed.join(near, ["kz", "ky", "kx"]).where(meet).withColumnsRenamed({"k" + a: "i" + a for a in AXES})


def blend_boxes(chunks: DataFrame, shape: tuple[int, int, int], margin: int) -> DataFrame:
    """The box of each chunk that its blend reads: the core and a margin, cut at the grid's ends."""
    out = chunks.select(F.col("chunk_id").alias("box_id"), "iz", "iy", "ix", *[f"core_{p}{a}{q}" for a in AXES for p, q in (("", "0"), ("n", ""))])
    for a, s in zip(AXES, shape, strict=True):
        start = F.greatest(F.col(f"core_{a}0") - margin, F.lit(0))
        out = out.withColumns({f"box_{a}0": start, f"box_n{a}": F.least(F.col(f"core_{a}0") + F.col(f"core_n{a}") + margin, F.lit(s)) - start})
    return out.drop(*[f"core_{p}{a}{q}" for a in AXES for p, q in (("", "0"), ("n", ""))])


def taper(position: Column, n: Column, kind: str) -> Column:
    """The weight at a place of a taper of n voxels that rises from 0 to 1."""
    at = (position + 0.5) / n
    return at if kind == "trapezoid" else 0.5 - 0.5 * F.cos(F.lit(math.pi) * at)


def axis_weight(axis: str, size: int, core: int, halo: int, width: int | None = None, kind: str = "hann") -> Column:
    """A chunk's weight along one axis for voxel `axis` and chunk index `i<axis>`: 1 on the core, tapers in the halo."""
    z, low = F.col(axis), F.col("i" + axis) * core
    high = F.least(low + core, F.lit(size))
    below = F.least(F.lit(width or halo), low - F.greatest(low - halo, F.lit(0)))
    above = F.least(F.lit(width or halo), F.least(high + halo, F.lit(size)) - high)
    return (F.when((z >= low) & (z < high), 1.0)
            .when((z < low) & (z >= low - below), taper(z - low + below, below, kind))
            .when((z >= high) & (z < high + above), taper(above - 1 - (z - high), above, kind)).otherwise(0.0))


def window(shape: tuple[int, int, int], core: int, halo: int, kind: str = "hann") -> Column:
    """The product of the three axis weights."""
    z, y, x = (axis_weight(a, s, core, halo, None, kind) for a, s in zip(AXES, shape, strict=True))
    return z * y * x


def lattice_box(low: Column, size: Column, factor: int) -> tuple[Column, Column]:
    """First lattice voxel and extent on a lattice factor times coarser that cover an interval."""
    first = F.floor(low / factor).cast("int")
    return first, (F.ceil((low + size) / factor) - first).cast("int")


def anchored_windows(chunks: DataFrame, size: int, stride: int) -> DataFrame:
    """Spatial hopping windows: for each chunk the starts, multiples of stride, of windows that meet its padded box."""
    out = chunks.select("chunk_id", *[f"pad_{p}{a}{q}" for a in AXES for p, q in (("", "0"), ("n", ""))])
    for a in AXES:
        first = F.ceil((F.col(f"pad_{a}0") - size + 1) / stride)
        last = F.floor((F.col(f"pad_{a}0") + F.col(f"pad_n{a}") - 1) / stride)
        out = out.withColumn("w" + a, F.explode(F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda k: k * stride)))
    return out.select("chunk_id", "wz", "wy", "wx")


def tasks(chunks: DataFrame, subjects: DataFrame, per_task: int) -> DataFrame:
    """The work of a pass: (task_id, place, chunk_id, subject), chunk by chunk, per_task entries a task.

    subjects has (subject, rank) with ranks from 0; the entry number is arithmetic, so nothing is sorted.
    """
    n = subjects.agg(F.count(F.lit(1)).alias("n"))
    entry = F.col("chunk_id") * F.col("n") + F.col("rank")
    return chunks.select("chunk_id").join(F.broadcast(subjects.crossJoin(n))).select(F.floor(entry / per_task).cast("int").alias("task_id"), (entry % per_task).cast("int").alias("place"), "chunk_id", "subject")
