"""Features as colours: a projection on three directions, its range, and nearest-neighbour tiles for sheets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.engines.features import principal
from voxframe.operators.stats import covariance, exact_quantiles

GUNS = ("r", "g", "b")


def projected(rows: DataFrame, column: str, basis: Sequence[Sequence[float]], mean: Sequence[float] | None = None) -> DataFrame:
    """rows with r, g, b: the vector, less a mean, on three directions."""
    out = {}
    for name, direction in zip(GUNS, basis, strict=True):
        weights = F.array(*[F.lit(float(w)) for w in direction])
        shift = float(np.dot(direction, mean)) if mean is not None else 0.0
        product = F.zip_with(F.col(column), weights, lambda a, b: a.cast("double") * b)
        out[name] = F.aggregate(product, F.lit(0.0), lambda s, v: s + v) - shift
    return rows.withColumns(out)


def ranged(rows: DataFrame, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """rows with r, g, b scaled from their percentiles low to high to [0, 1], clipped: one range for all rows."""
    out = rows
    for g in GUNS:
        p = exact_quantiles(rows, g, (low / 100, high / 100)).select(F.col("p")[0].alias("_l"), F.col("p")[1].alias("_h"))
        scaled = (F.col(g) - F.col("_l")) / F.greatest(F.col("_h") - F.col("_l"), F.lit(1e-8))
        out = out.crossJoin(F.broadcast(p)).withColumn(g, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_l", "_h")
    return out


def colour_basis(rows: DataFrame, column: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(basis, mean, shares): the three main directions of all rows' n channels, from one pass of sums; one channel is grey."""
    means = rows.select(F.posexplode(column).alias("c", "v")).groupBy("c").agg(F.avg(F.col("v").cast("double")).alias("m")).orderBy("c").collect()  # a row a channel
    mean = np.array([r["m"] for r in means])
    if n == 1:
        return np.ones((3, 1)), mean, np.array([1.0])
    cov = np.zeros((n, n))
    for r in covariance(rows, column, n).collect():  # n * (n + 1) / 2 rows
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
    basis, shares = principal(cov, min(3, n))
    return np.vstack([basis, np.zeros((3 - len(basis), n))]), mean, shares


def tile(plane: DataFrame, shape: tuple[int, int], size: int, axes: tuple[str, str] = ("y", "x"), values: tuple[str, ...] = ("v",)) -> DataFrame:
    """A plane as a square of size pixels (i, j, values), nearest neighbour: coarse levels look coarse."""
    at = {a: F.floor(F.col(k) * n / size).cast("int") for a, n, k in zip(axes, shape, ("i", "j"), strict=True)}
    spots = plane.sparkSession.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("i"), (F.col("id") % size).cast("int").alias("j"))
    return spots.withColumns(at).join(plane.select(*axes, *values), list(axes)).select("i", "j", *values)


def contact_sheet(tiles: dict[tuple[str, int], np.ndarray], gap: int = 2) -> np.ndarray:
    """Square RGB tiles by (subject, level) as one image: a row a subject, a column a level; what is missing stays black."""
    subjects, levels = sorted({s for s, _ in tiles}), sorted({k for _, k in tiles})
    size = next(iter(tiles.values())).shape[0]
    out = np.zeros((len(subjects) * (size + gap) - gap, len(levels) * (size + gap) - gap, 3), np.uint8)
    for (s, k), image in tiles.items():
        y, x = subjects.index(s) * (size + gap), levels.index(k) * (size + gap)
        out[y : y + size, x : x + size] = image
    return out
