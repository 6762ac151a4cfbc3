"""The grid of a run, where each scan lies on it, and scans read on it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES
from voxframe.operators.gather import PLACES, sample
from voxframe.operators.pooling import pool
from voxframe.operators.stencil import gaussian
from voxframe.operators.tiling import Grid


@dataclass(frozen=True)
class Scan:
    """A scan's own lattice: size and voxel (mm) an axis."""

    name: str
    shape: tuple[int, int, int]
    voxel: tuple[float, float, float]


@dataclass(frozen=True)
class Placement:
    """Where a scan lies in the run's frame, and how it is read there."""

    scan: Scan
    origin: tuple[float, float, float]
    pool: tuple[int, int, int]
    sigma: tuple[float, float, float]
    copied: bool


def _chosen(scans: list[Scan], spacing: str | float, reference: str | None) -> float:
    if reference is not None:
        voxel = next(s.voxel for s in scans if s.name == reference)
        if max(voxel) - min(voxel) > 1e-3 * max(voxel):
            raise ValueError("the reference scan is not isotropic")
        return voxel[0]
    if spacing == "finest":
        return min(min(s.voxel) for s in scans)
    if spacing == "coarsest":
        return max(max(s.voxel) for s in scans)
    return float(spacing)


def resolve(scans: list[Scan], spacing: str | float = "finest", shape: tuple[int, int, int] | None = None, align: str = "centre", reference: str | None = None) -> tuple[Grid, list[Placement]]:
    """The run grid, centred on the world's origin, and each scan's placement.

    A scan whose voxel divides the run's is moved by half a run voxel at most, so that its pooled voxels lie
    on run voxels and need no interpolation.
    """
    if reference is not None and (shape is not None or spacing != "finest"):
        raise ValueError("a reference scan sets spacing and shape itself")
    s = _chosen(scans, spacing, reference)
    if shape is None:
        shape = tuple(math.ceil(max(c.shape[d] * c.voxel[d] for c in scans) / s - 1e-6) for d in range(3))
    origin = tuple(-s * (n - 1) / 2 for n in shape)
    return Grid(shape, s, origin), [_placed(c, s, origin, align) for c in scans]


def _placed(scan: Scan, s: float, origin: tuple[float, ...], align: str) -> Placement:
    start, factors, sigmas, whole = [], [], [], True
    for n, v, o in zip(scan.shape, scan.voxel, origin, strict=True):
        at = -v * (n - 1) / 2 if align == "centre" else o - s / 2 + v / 2
        ratio = s / v
        f = max(1, math.floor(ratio + 1e-9))
        exact = abs(ratio - round(ratio)) < 1e-6 * ratio and round(ratio) >= 1
        if exact:
            f = round(ratio)
            first = at + v * (f - 1) / 2
            at += o + math.floor((first - o) / s + 0.5) * s - first
        start.append(at)
        factors.append(f)
        sigmas.append(max(0.0, (ratio / f - 1) / 2))
        whole = whole and exact and f == 1
    return Placement(scan, tuple(start), tuple(factors), tuple(sigmas), whole)


def resampled(volume: DataFrame, shape: tuple[int, int, int], places: DataFrame, factor: int, sigma: float, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """A scan at places in its own voxels: pooled over the voxels there are, blurred, interpolated; fades to 0 outside."""
    small = tuple(-(-n // factor) for n in shape)
    soft = gaussian(pool(volume, factor, values), sigma, small, values)
    moved = places.withColumns({p: (F.col(p) - (factor - 1) / 2) / factor for p in PLACES})
    return sample(moved, soft, small, values, "fade").select(*AXES, *values)


def read_on(volume: DataFrame, placement: Placement, target: Grid) -> DataFrame:
    """A scan's values on the run grid: copied by a shift of keys where its voxels are the run's, else resampled."""
    scan, t = placement.scan, target
    if placement.copied:
        move = [round((o - g) / t.spacing) for o, g in zip(placement.origin, t.origin, strict=True)]
        out = volume.withColumns({a: F.col(a) + k for a, k in zip(AXES, move, strict=True)})
        for a, n in zip(AXES, t.shape, strict=True):
            out = out.where((F.col(a) >= 0) & (F.col(a) < n))
        return out.select(*AXES, "v")
    from voxframe.operators.gather import dense

    places = dense(volume.sparkSession, t.shape)
    places = places.withColumns({p: (F.col(a) * t.spacing + g - o) / v for p, a, g, o, v in zip(PLACES, AXES, t.origin, placement.origin, scan.voxel, strict=True)})
    if len(set(placement.pool)) == 1 and len(set(placement.sigma)) == 1:
        return resampled(volume, scan.shape, places, placement.pool[0], placement.sigma[0])
    small, soft = [], volume
    cube = [F.floor(F.col(a) / f).cast("int").alias(a) for a, f in zip(AXES, placement.pool, strict=True)]
    soft = soft.groupBy(*cube).agg(F.avg("v").alias("v"))
    small = tuple(-(-n // f) for n, f in zip(scan.shape, placement.pool, strict=True))
    from voxframe.operators.stencil import convolve_axis, gaussian_kernel

    for a, n, sg in zip(AXES, small, placement.sigma, strict=True):
        soft = convolve_axis(soft, a, n, gaussian_kernel(sg)) if sg > 0 else soft
    moved = places.withColumns({p: (F.col(p) - (f - 1) / 2) / f for p, f in zip(PLACES, placement.pool, strict=True)})
    return sample(moved, soft, small, ("v",), "fade").select(*AXES, "v")
