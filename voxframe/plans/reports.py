"""Looking at a run: convention checks, a probe of the cohort's spread, feature metrics, a sheet of slices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.engines import arrays as A
from voxframe.engines.demons import Demons, Engine, Stage
from voxframe.engines.features import Extractor, principal
from voxframe.functions.scalar import AXES, VECTOR, magnitude
from voxframe.operators import gather, stats
from voxframe.sources import formats


def selftest(solver: Engine | None = None) -> dict[str, bool]:
    """Conventions that everything rests on, on small arrays: what a field means, its units, and how fields compose."""
    solver = solver or Demons()
    a = A.smooth(np.random.default_rng(0).random((16, 14, 18)), 2.0)
    shift = np.zeros((3, *a.shape))
    shift[0] = 0.2
    moved = A.warp(a[None], shift, 0.1)[0]
    u = solver.solve(a[None], a[None], 0.1, [Stage()]).u
    b = np.roll(a, 1, 0)
    v = solver.solve(a[None], b[None], 0.1, [Stage(scales=(2, 1), iterations=(30, 20))]).u
    core = (slice(3, -3),) * 3
    return {
        "a field points from the fixed to the moving voxel": bool(np.allclose(moved[:-2], a[2:])),
        "fields are in millimetres": bool(np.allclose(A.warp(a[None], 2 * shift, 0.2)[0], moved)),
        "equal images need no field": bool(np.abs(u).max() < 1e-6),
        "a shift is found with its sign": bool(v[(0, *core)].mean() > 0),
        "composing with its inverse undoes a shift": bool(np.allclose(A.compose(shift, -shift, 0.1), 0)),
        "no field, no folds": A.fold_fraction(np.zeros((3, 4, 4, 4)), 0.1) == 0.0,
    }


def probe(fields: DataFrame, q: float = 99.0) -> DataFrame:
    """(bin, value) of the cohort's displacement: the merged histogram of some fields, one percentile of it."""
    return stats.percentile(stats.histogram(fields, magnitude(*VECTOR)), q)


def feature_metrics(make: Extractor, patch: np.ndarray) -> dict[str, float]:
    """Channels that take part, contrast of gradients, share of variance in three directions, share of tissue."""
    f = make(patch)
    x = f.reshape(f.shape[0], -1)
    cov = np.atleast_2d(np.cov(x, bias=True))
    values = np.linalg.eigvalsh(cov)
    g = np.sqrt((A.gradients(f, 1.0) ** 2).sum((0, 1)))
    return {"participation": float(values.sum() ** 2 / max((values**2).sum(), 1e-30)), "contrast": float(np.percentile(g, 99) / max(np.median(g), 1e-12)),
            "explained": float(principal(cov, 3)[1].sum()), "tissue": A.tissue_fraction(patch)}


def mid_planes(voxels: DataFrame, shape: tuple[int, int, int], value: str = "v") -> list[np.ndarray]:
    """The three mid-planes as arrays; only their rows reach the driver."""
    out = []
    for d, n in enumerate(shape):
        rest = [i for i in range(3) if i != d]
        image = np.zeros([shape[i] for i in rest])
        for r in voxels.where(F.col(AXES[d]) == n // 2).select(*[AXES[i] for i in rest], value).collect():
            image[r[0], r[1]] = r[2]
        out.append(image)
    return out


def sheet(template: DataFrame, subject: DataFrame, field: DataFrame, shape: tuple[int, int, int], spacing: float, most: float) -> bytes:
    """A PNG: template, warped subject and displacement on the mid-planes, a row each."""
    warped = gather.warp(subject, field, shape, spacing)
    size = field.select(*AXES, magnitude(*VECTOR).alias("v"))
    rows: list[list[np.ndarray]] = []
    for voxels, paint in ((template, _grey), (warped, _grey), (size, lambda image: formats.heat(image, most))):
        rows.append([paint(p) for p in mid_planes(voxels, shape)])
    height = [max(r[i].shape[0] for r in rows) for i in range(3)]
    width = [max(r[i].shape[1] for r in rows) for i in range(3)]
    out = np.zeros((max(height) * len(rows), sum(width), 3), np.uint8)
    for i, r in enumerate(rows):
        for j, image in enumerate(r):
            out[i * max(height) : i * max(height) + image.shape[0], sum(width[:j]) : sum(width[:j]) + image.shape[1]] = image
    return formats.write_png(out)


def _grey(image: np.ndarray) -> np.ndarray:
    low, high = np.percentile(image, (0.5, 99.5))
    return np.repeat(formats.grey(image, low, high)[..., None], 3, 2)


def chunk_counts(voxels: DataFrame, core: int, limit: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, chunks, tissue_chunks): how many cores there are and how many have a mean at the limit or above."""
    cores = voxels.groupBy(*keys, *[F.floor(F.col(a) / core).alias("i" + a) for a in AXES]).agg(F.avg("v").alias("mean"))
    return cores.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("mean") >= limit).alias("tissue_chunks"))


def calibrate(make: Extractor, solve: Callable[[int], object], size: int = 24) -> dict[str, float]:
    """Seconds for a patch of `size` voxels an axis and the rate in channel-voxels, from one timed call."""
    import time

    began = time.perf_counter()
    solve(size)
    seconds = time.perf_counter() - began
    return {"seconds": seconds, "rate": size**3 * make.channels / max(seconds, 1e-9)}
