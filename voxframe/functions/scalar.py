"""Column expressions over voxels and vectors; all of them stay inside whole-stage code generation."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
VECTOR = ("uz", "uy", "ux")
#: Histogram bins: bin 0 holds values under LEAST, bins 1 to 255 are spaced evenly in the logarithm up to MOST.
BINS, LEAST, MOST = 256, 1e-6, 1e3
#: Micrometres in a unit of length.
MICROMETRES = {"nm": 1e-3, "um": 1.0, "µm": 1.0, "mm": 1e3, "cm": 1e4, "m": 1e6, "nanometer": 1e-3, "micrometer": 1.0, "millimeter": 1e3, "centimeter": 1e4, "meter": 1e6}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def world(voxel: Column | str, spacing: float, origin: float) -> Column:
    """World position of a voxel index."""
    return col(voxel) * spacing + origin


def voxel(position: Column | str, spacing: float, origin: float) -> Column:
    """Voxel index of a world position."""
    return (col(position) - origin) / spacing


def normalise(value: Column | str, low: Column | float, high: Column | float) -> Column:
    """Value mapped from [low, high] to [0, 1], clipped."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.least(F.greatest((col(value) - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def as_integer(value: Column | str, low: int, high: int) -> Column:
    """Rounds half to even and clips, as an ingest into an integer volume does."""
    return F.least(F.greatest(F.rint(col(value)), F.lit(float(low))), F.lit(float(high))).cast("long")


def magnitude(*parts: Column | str) -> Column:
    """Euclidean length of a vector."""
    return F.sqrt(sum((col(p) * col(p) for p in parts[1:]), col(parts[0]) * col(parts[0])))


def clamp(parts: tuple[str, ...], most: float | None) -> list[Column]:
    """A vector scaled to a length of `most` at most, its direction kept; None or 0 leaves it."""
    if not most or most <= 0:
        return [F.col(p).alias(p) for p in parts]
    size = magnitude(*parts)
    return [F.when(size > most, F.col(p) * (F.lit(float(most)) / size)).otherwise(F.col(p)).alias(p) for p in parts]


def grid_to_mm(value: Column | str, n: int, spacing: float) -> Column:
    """A displacement in [-1, 1] grid units (ends on the corner voxels' centres) in millimetres."""
    return col(value) * ((n - 1) / 2.0) * spacing


def mm_to_grid(value: Column | str, n: int, spacing: float) -> Column:
    """The inverse of grid_to_mm; 0 on an axis of one voxel."""
    return col(value) / (((n - 1) / 2.0) * spacing) if n > 1 else F.lit(0.0)


def log_bin(value: Column | str) -> Column:
    """The histogram bin of a value that is not negative."""
    v = col(value)
    step = (BINS - 2) / (math.log10(MOST) - math.log10(LEAST))
    return F.when(v < LEAST, 0).otherwise(F.least(F.lit(BINS - 1), (F.lit(1) + F.floor((F.log10(v) - math.log10(LEAST)) * step)).cast("int")))


def upper_edge(bin_: Column | str) -> Column:
    """The upper edge of a bin; the last bin's is MOST."""
    low, high = math.log10(LEAST), math.log10(MOST)
    return F.least(F.pow(F.lit(10.0), F.lit(low) + F.lit(high - low) * col(bin_) / (BINS - 2)), F.lit(MOST))


def spacing_agrees(a: Column | str, b: Column | str, rel: float = 1e-3) -> Column:
    """Whether two voxel sizes are equal but for rounding."""
    return F.abs(col(a) - col(b)) <= rel * F.greatest(F.abs(col(a)), F.abs(col(b)))


def overlaps(low_a: str, size_a: str, low_b: str, size_b: str) -> Column:
    """Whether two half-open intervals share a voxel."""
    return F.least(F.col(low_a) + F.col(size_a), F.col(low_b) + F.col(size_b)) > F.greatest(F.col(low_a), F.col(low_b))


def l2_channels(channels: Column | str) -> Column:
    """A feature vector divided by its length, which counts as 1e-6 at least."""
    x = col(channels)
    size = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))), F.lit(1e-6))
    return F.transform(x, lambda v: v.cast("double") / size)


def standard_channels(channels: Column | str) -> Column:
    """A feature vector less its mean, divided by its population standard deviation (1e-6 at least)."""
    x, n = col(channels), F.size(col(channels))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / n
    sd = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v.cast("double") - mean) * (v.cast("double") - mean)) / n), F.lit(1e-6))
    return F.transform(x, lambda v: (v.cast("double") - mean) / sd)


def length_in_um(text: str) -> float:
    """Micrometres of a length with its unit, such as 200um or 0.2 mm."""
    m = re.fullmatch(r"\s*([0-9.]+(?:[eE][-+]?[0-9]+)?)\s*([a-zµ]+)\s*", text)
    if not m or m[2] not in MICROMETRES:
        raise ValueError(f"no length with a unit: {text!r}")
    return float(m[1]) * MICROMETRES[m[2]]
