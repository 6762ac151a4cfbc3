"""Frames, levels and layouts: how lattices lie in each other, which levels run, and how much a task holds.

What is said of one run is plain Python over a few numbers; what is said of each chunk, scan or level is a column.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES, VECTOR, spacing_agrees
from voxframe.operators.tiling import Grid, grids

# Digits that a 32-bit header holds, how far voxels may differ and count as isotropic, extra voxels of a margin,
# the full scale of 16-bit exports, and the share of a device's memory that tasks may fill.
DIGITS, ISOTROPIC, EXTRA, SCALE, USABLE = 7, 1e-3, 2, 65535, 0.8


# --- voxel sizes and types --------------------------------------------------------------------------------------


def significant(value: Column | str, digits: int = DIGITS) -> Column:
    """A number rounded to so many significant digits; 0 stays."""
    v = F.col(value) if isinstance(value, str) else value
    unit = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.rint(v * unit) / unit)


def canonical(z: str, y: str, x: str) -> list[Column]:
    """(iso, vz, vy, vx): voxel sizes without the noise of headers; all three their mean, and iso, if they agree."""
    v = [significant(c) for c in (z, y, x)]
    iso = F.greatest(*v) <= F.least(*v) * (1 + ISOTROPIC)
    mean = (v[0] + v[1] + v[2]) / 3
    return [iso.alias("iso"), *[F.when(iso, mean).otherwise(c).alias("v" + a) for c, a in zip(v, AXES, strict=True)]]


def spacing_of(voxel: Sequence[float]) -> float | tuple[float, float, float]:
    """The same for one scan: a number if its voxels are isotropic, else the three sizes."""
    v = tuple(float(f"{x:.{DIGITS}g}") for x in voxel)
    return sum(v) / 3 if max(v) <= min(v) * (1 + ISOTROPIC) else v


def stored_type(requested: str, source: np.dtype | str) -> np.dtype:
    """The type a store takes: the one asked for, or with "auto" the source's, reals as 32-bit, truth values as bytes."""
    if requested != "auto":
        return np.dtype(requested)
    kind = np.dtype(source)
    return {"b": np.dtype("u1"), "i": kind, "u": kind}.get(kind.kind, np.dtype("f4"))


def scaled_16bit(value: str, low: Column | float, high: Column | float) -> Column:
    """A value through its window on the scale of 16-bit exports."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.rint(F.least(F.greatest((F.col(value) - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * SCALE).cast("int")


def margins(fields: DataFrame, spacing: float, keys: tuple[str, ...] = (), extra: int = EXTRA) -> DataFrame:
    """(keys, margin): voxels around a box that a warp through its field may read; `extra` for a field without voxels."""
    far = F.max(F.greatest(*[F.abs(F.col(u)) for u in VECTOR]))
    return fields.groupBy(*keys).agg((F.coalesce(F.ceil(far / spacing), F.lit(0)) + extra).cast("int").alias("margin"))


# --- boxes ------------------------------------------------------------------------------------------------------


def box_of(key: object, shape: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The half-open box that an index expression asks for: integers, slices without a step, and an ellipsis."""
    parts = list(key) if isinstance(key, tuple) else [key]
    if Ellipsis in parts:
        at = parts.index(Ellipsis)
        parts[at : at + 1] = [slice(None)] * (len(shape) - len(parts) + 1)
    if len(parts) > len(shape):
        raise IndexError(f"{len(parts)} indices for {len(shape)} axes")
    parts += [slice(None)] * (len(shape) - len(parts))
    low, high = [], []
    for p, n in zip(parts, shape, strict=True):
        if isinstance(p, slice):
            if p.step not in (None, 1):
                raise IndexError("boxes have no step")
            a, b, _ = p.indices(n)
        else:
            a = int(p) + (n if p < 0 else 0)
            b = a + 1
            if not 0 <= a < n:
                raise IndexError(f"index {p} of {n}")
        low.append(a)
        high.append(max(a, b))
    return tuple(low), tuple(high)


def plane_box(shape: tuple[int, int, int], axis: str, index: int | None = None, thickness: int = 1) -> Column:
    """Which voxels lie in a thin box across an axis; its middle by default."""
    n = shape[AXES.index(axis)]
    start = min(max(0, n // 2 if index is None else index), n - 1)
    return (F.col(axis) >= start) & (F.col(axis) < start + thickness)


def in_box(low: Sequence[int], high: Sequence[int]) -> Column:
    """Which voxels lie in [low, high)."""
    out = F.lit(True)
    for a, b, h in zip(AXES, low, high, strict=True):
        out = out & (F.col(a) >= int(b)) & (F.col(a) < int(h))
    return out


def split(low: Sequence[int], high: Sequence[int], fits) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Boxes that cover [low, high), each halved along its longest axis until fits(size) or a single voxel is left."""
    size = [h - b for b, h in zip(low, high, strict=True)]
    if any(n <= 0 for n in size):
        return []
    if fits(tuple(size)) or max(size) == 1:
        return [(tuple(low), tuple(high))]
    d = size.index(max(size))
    middle = low[d] + size[d] // 2
    first, second = list(high), list(low)
    first[d] = second[d] = middle
    return split(low, first, fits) + split(second, high, fits)


def source_boxes(boxes: DataFrame, matrix: Sequence[Sequence[float]], shape: tuple[int, int, int], origin: str = "pad_{}0", size: str = "pad_n{}") -> DataFrame:
    """boxes with src_<a>0 and src_<a>1: what of a source their voxels read through a 3x4 matrix, a voxel more on each side, cut at its ends.

    The extremes of a linear map over a box lie at corners, and there each term is extreme by itself.
    """
    columns = {}
    for row, a, n in zip(matrix, AXES, shape, strict=True):
        least = most = F.lit(float(row[3]))
        for k, b in zip(row, AXES, strict=False):
            p = F.col(origin.format(b)) * float(k)
            q = (F.col(origin.format(b)) + F.col(size.format(b)) - 1) * float(k)
            least, most = least + F.least(p, q), most + F.greatest(p, q)
        cut = lambda v, n=n: F.least(F.greatest(v, F.lit(0)), F.lit(n)).cast("int")
        columns |= {f"src_{a}0": cut(F.floor(least) - 1), f"src_{a}1": cut(F.ceil(most) + 2)}
    return boxes.withColumns(columns)


# --- affine maps ------------------------------------------------------------------------------------------------


def square(matrix: Sequence) -> np.ndarray:
    """A 4x4 matrix from 4x4 or 3x4 numbers."""
    a = np.asarray(matrix, float)
    if a.shape not in ((3, 4), (4, 4)):
        raise ValueError(f"an affine map has 3 or 4 rows of 4 numbers, not {a.shape}")
    return np.vstack([a, [0.0, 0.0, 0.0, 1.0]])[:4] if a.shape == (3, 4) else a


def matrix_in(value: object) -> np.ndarray:
    """An affine map from numbers, or from a JSON text: the first value in it that has the form of one."""
    if not isinstance(value, str):
        return square(value)
    told = json.loads(value)
    for entry in told.values() if isinstance(told, dict) else [told]:
        try:
            return square(entry)
        except (TypeError, ValueError):
            continue
    raise ValueError("no affine map in this text")


def scaling(scale: Sequence[float], shift: Sequence[float]) -> np.ndarray:
    """x -> scale * x + shift as a 4x4 matrix."""
    out = np.diag([*map(float, scale), 1.0])
    out[:3, 3] = shift
    return out


def world_to_source(grid: Grid, fixed_scale_um: Sequence[float], fixed_shift_um: Sequence[float], source_to_fixed_um: Sequence) -> np.ndarray:
    """From the run's world (mm) to a source's physical frame (um), given the map from source to fixed scan.

    World to the fixed scan's voxels (the run grid's), to its physical frame, then back through the map.
    """
    to_voxels = np.linalg.inv(scaling([grid.spacing] * 3, grid.origin))
    return np.linalg.solve(square(source_to_fixed_um), scaling(fixed_scale_um, fixed_shift_um) @ to_voxels)


def voxel_matrix(grid: Grid, world_to_source_um: Sequence, scale_um: Sequence[float], shift_um: Sequence[float]) -> np.ndarray:
    """From a run grid's voxels to a source dataset's voxels, 3x4."""
    return (np.linalg.inv(scaling(scale_um, shift_um)) @ square(world_to_source_um) @ scaling([grid.spacing] * 3, grid.origin))[:3]


def physical_frame(grid: Grid, datasets: Sequence[tuple[tuple[int, int, int], Sequence[float], Sequence[float]]] = ()) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(scale, shift) in um of a fixed scan: its finest dataset's (shape, scale, shift) if that is the run grid, else voxel times spacing."""
    finest = min(datasets, key=lambda d: max(d[1]), default=None)
    if finest is not None and tuple(finest[0]) == tuple(grid.shape):
        return tuple(finest[1]), tuple(finest[2])
    return (grid.spacing * 1000.0,) * 3, (0.0, 0.0, 0.0)


def affine_spec(source: str, datasets: Sequence[dict], world_to_source_um: Sequence, background: tuple[float, float] | None = None, only: Sequence[str] | None = None) -> dict:
    """What a store needs to know to read a source through an affine map: isotropic datasets, the map, the background's threshold and value."""
    some = [dict(d) for d in datasets if only is None or d["path"] in only]
    if not some:
        raise ValueError("no dataset to read")
    if any(isinstance(spacing_of(d["scale_um"]), tuple) for d in some):
        raise ValueError("datasets read through an affine map are isotropic")
    return {"source": source, "datasets": some, "world_to_source_um": square(world_to_source_um).tolist(), "background": list(background) if background else None}


def same_world_box(a: Grid, b: Grid, tolerance: float) -> bool:
    """Whether two grids cover the same part of the world, within a tolerance (mm) at each end."""
    for na, oa, nb, ob in zip(a.shape, a.origin, b.shape, b.origin, strict=True):
        low = abs((oa - a.spacing / 2) - (ob - b.spacing / 2))
        high = abs((oa + a.spacing * (na - 0.5)) - (ob + b.spacing * (nb - 0.5)))
        if max(low, high) > tolerance:
            return False
    return True


def warm_start(field: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """A field (mm) from another run as the seed of this one: read on the target grid, ends clamped.

    Its grid must cover the target's box, within one of its own voxels: a field of another frame is refused.
    """
    from voxframe.operators.gather import resample

    if not same_world_box(source, target, source.spacing):
        raise ValueError("the field covers another part of the world than the run grid")
    return resample(field, source, target, VECTOR)


# --- scans on the run grid --------------------------------------------------------------------------------------


def placement_notes(scans: DataFrame, grid: Grid) -> DataFrame:
    """scans (name, n<a>, v<a>, o<a>: size, voxel and first voxel's place in mm) with copied, coarse and cropped.

    copied: voxels are the run's. coarse: the axes along which a scan's voxels are larger, so that reading it
    adds no detail. cropped: the axes along which it reaches more than half a run voxel beyond the grid.
    """
    s = grid.spacing
    ratio = {a: F.lit(s) / F.col("v" + a) for a in AXES}
    named = lambda tests: F.concat_ws(",", *[F.when(t, F.lit(a)) for a, t in tests.items()])
    cut = {}
    for a, n, o in zip(AXES, grid.shape, grid.origin, strict=True):
        low, high = F.col("o" + a) - F.col("v" + a) / 2, F.col("o" + a) + F.col("v" + a) * (F.col("n" + a) - 0.5)
        cut[a] = (low < o - s) | (high > o + s * n)
    alike = [F.abs(r - 1) <= ISOTROPIC for r in ratio.values()]
    return scans.withColumns({"copied": alike[0] & alike[1] & alike[2], "coarse": named({a: r < 1 - ISOTROPIC for a, r in ratio.items()}), "cropped": named(cut)})


# --- levels -----------------------------------------------------------------------------------------------------


def find_levels(asked: DataFrame, levels: DataFrame, rel: float = ISOTROPIC) -> DataFrame:
    """asked (spacing_mm) with the level of that spacing, null without one: an equi-join on the power of two, the tolerance after it."""
    step = lambda c: F.round(F.log2(c)).cast("int")
    base = levels.agg(F.min("spacing_mm").alias("_base"))
    keyed = levels.crossJoin(F.broadcast(base)).select(step(F.col("spacing_mm") / F.col("_base")).alias("_step"), F.col("spacing_mm").alias("_s"), "level")
    near = asked.crossJoin(F.broadcast(base)).withColumn("_step", step(F.col("spacing_mm") / F.col("_base"))).drop("_base")
    met = near.join(F.broadcast(keyed), "_step", "left")  # a row a level
    return met.withColumn("level", F.when(spacing_agrees("spacing_mm", "_s", rel), F.col("level"))).drop("_step", "_s")


def run_levels(spacings: Sequence[float], run: str | Sequence = "all", stages: dict | None = None, params: dict | None = None, stop_at: float | int | None = None) -> tuple[int, ...]:
    """The levels of a run, coarsest first. Levels are named by number or by spacing (mm; a float)."""
    top = len(spacings) - 1

    def level(ref: float | int) -> int:
        found = [k for k, s in enumerate(spacings) if math.isclose(s, ref, rel_tol=ISOTROPIC)] if isinstance(ref, float) else [k for k in range(top + 1) if k == ref]
        if not found:
            raise ValueError(f"no level {ref}")
        return found[0]

    named = range(top + 1) if run == "all" else [top, *tuned_levels(stages or {}, params or {})] if run == "listed" else run
    chosen = {level(r) for r in named}
    last = 0 if stop_at is None else level(stop_at)
    if top not in chosen or last > top:
        raise ValueError("a run starts at the coarsest level")
    return tuple(sorted((k for k in chosen if k >= last), reverse=True))


def tuned_levels(stages: dict, params: dict) -> tuple[int, ...]:
    """Levels that have settings of their own."""
    return tuple(sorted({*stages, *params}))


def mapped_levels(spark: SparkSession, grid: Grid, core: int, factor: int, cap: int | None) -> DataFrame:
    """(level, lattice, kept): the voxels of each level's lattice, and whether a residual map of that size is kept."""
    n = None
    for a in AXES:
        one = F.ceil(F.col("n" + a) / factor)
        n = one if n is None else n * one
    return grids(spark, grid, core).select("level", n.cast("long").alias("lattice"), (F.lit(True) if cap is None else n <= cap).alias("kept"))


# --- layouts ----------------------------------------------------------------------------------------------------


def block_layout(levels: DataFrame, inner: int, core: int) -> DataFrame:
    """levels (n<a>) with block_<a> and file_<a>: edges of blocks and of files that hold whole blocks, as large as a core at most but for rounding up."""
    out = {}
    for a in AXES:
        block = F.greatest(F.lit(1), F.least(F.lit(inner), F.col("n" + a)))
        out |= {"block_" + a: block.cast("int"), "file_" + a: (F.ceil(F.least(F.lit(core), F.col("n" + a)) / block) * block).cast("int")}
    return levels.withColumns(out)


def workers(bytes_needed: float, device_gb: float, asked: int | None = None) -> tuple[int, bool]:
    """How many tasks share a device, and whether they fit: two if both do, else one, or as many as asked for."""
    budget = USABLE * device_gb * 1e9
    n = asked if asked is not None else 2 if 2 * bytes_needed <= budget else 1
    return n, n * bytes_needed <= budget


def releases(needs: DataFrame) -> DataFrame:
    """(task_id, after): the last core, in their order, that reads a task's result; needs (core, task_id). After it the result can go.

    A pass that is dealt chunk by chunk keeps a thin front of results this way: those whose first reader has
    begun and whose last one has not ended.
    """
    return needs.groupBy("task_id").agg(F.max("core").alias("after"))


class Front:
    """The same while a pass runs: tells which results are free when a reader ends, in any order."""

    def __init__(self, needs: dict[int, set[int]]) -> None:
        self.left = {core: set(tasks) for core, tasks in needs.items()}
        self.readers: dict[int, int] = {}
        for tasks in self.left.values():
            for t in tasks:
                self.readers[t] = self.readers.get(t, 0) + 1

    def ended(self, core: int) -> list[int]:
        """The results that nobody needs after this reader; nothing the second time."""
        free = []
        for t in sorted(self.left.pop(core, ())):
            self.readers[t] -= 1
            if not self.readers[t]:
                del self.readers[t]
                free.append(t)
        return free
