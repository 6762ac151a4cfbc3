"""Work on blocks of voxels: a block and what its neighbours lend it meet in one task as arrays.

Rows are dealt to blocks by arithmetic on their keys, each once but for a thin shell that several blocks need, so a
stencil or an interpolation shuffles a volume about once, whatever the size of its neighbourhood. A task holds one
block; blocks do not grow with the volume.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxframe.functions.scalar import AXES
from voxframe.session import ship

#: Voxels of a block along an axis.
BLOCK = 32
#: Places are snapped to multiples of this part of a voxel, so that sums in another order see the same bounds.
SNAP = float(2**40)


def snapped(place: Column) -> Column:
    """A place on the raster that makes comparisons with bounds independent of rounding."""
    return F.rint(place * SNAP) / SNAP


def deal(voxels: DataFrame, shape: tuple[int, int, int], below: int, above: int, size: int = BLOCK) -> DataFrame:
    """Each voxel once for every block that reads it; a block reads `below` voxels before it and `above` after it."""
    out = voxels
    for a, n in zip(AXES, shape, strict=True):
        first = F.greatest(F.floor((F.col(a) - above) / size), F.lit(0))
        last = F.least(F.floor((F.col(a) + below) / size), F.lit((n - 1) // size))
        out = out.withColumn("_b" + a, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return out


def _array(table: pa.Table, names: list[str], low: list[int], high: list[int]) -> np.ndarray:
    """Columns of voxel rows as arrays of the box [low, high); voxels without a row are 0."""
    out = np.zeros((len(names), *[h - b for b, h in zip(low, high, strict=True)]))
    place = tuple(table.column(a).to_numpy() - b for a, b in zip(AXES, low, strict=True))
    for i, v in enumerate(names):
        out[(i, *place)] = table.column(v).cast(pa.float64()).to_numpy()
    return out


def interpolated(places: DataFrame, volume: DataFrame, shape: tuple[int, int, int], values: tuple[str, ...], at: tuple[str, str, str], inside: Column, cval: float, keys: tuple[str, ...], size: int = BLOCK) -> DataFrame:
    """places with values: trilinear, voxels beyond the volume or without a row as 0; cval where `inside` is false.

    Places meet the block of their lower corner, which has been lent one voxel from each next block. Places
    that are not inside need no voxels and are dealt evenly.
    """
    ship(places.sparkSession)
    own = places.columns
    count = [-(-n // size) for n in shape]
    rest, home = F.pmod(F.xxhash64(*own), F.lit(count[0] * count[1] * count[2])), []
    for i, (p, n) in enumerate(zip(at, shape, strict=True)):
        low = F.floor(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(n - 1.0)) / size)
        spread = F.floor(rest / int(np.prod(count[i + 1 :], dtype=int))) % count[i]
        home.append(F.when(inside, low).otherwise(spread).cast("int").alias("_b" + AXES[i]))
    names = {c: f"_p{i}" for i, c in enumerate(own)}  # names of places and of the volume may clash
    left = places.select(*[F.col(c).alias(names[c]) for c in own], *[F.col(p).cast("double").alias("_e" + a) for p, a in zip(at, AXES, strict=True)], inside.alias("_in"), *[F.col(k).alias("_k" + k) for k in keys], *home)
    right = deal(volume.select(*[F.col(k).alias("_k" + k) for k in keys], *AXES, *values), shape, 0, 1, size)
    by = [*["_k" + k for k in keys], *["_b" + a for a in AXES]]
    kept = [c for c in own if c not in values]
    schema = StructType([*[places.schema[c] for c in kept], *[StructField(v, DoubleType()) for v in values]])

    def one(some: pa.Table, box: pa.Table) -> pa.Table:
        n = some.num_rows
        out = np.full((len(values), n), cval)
        if n:
            low = [int(some.column("_b" + a)[0].as_py()) * size for a in AXES]
            block = _array(box, list(values), low, [b + size + 1 for b in low]).reshape(len(values), -1)
            there = some.column("_in").to_numpy()
            e = np.stack([some.column("_e" + a).to_numpy()[there] for a in AXES])
            floor = np.floor(e)
            part, floor = e - floor, floor.astype(np.int64)
            total = np.zeros((len(values), e.shape[1]))
            for corner in np.ndindex(2, 2, 2):
                flat, weight = np.zeros(e.shape[1], np.int64), np.ones(e.shape[1])
                for d, step in enumerate(corner):
                    index = floor[d] + step
                    weight = weight * (part[d] if step else 1 - part[d]) * ((index >= 0) & (index < shape[d]))
                    flat = flat * (size + 1) + np.clip(index - low[d], 0, size)
                total += block[:, flat] * weight
            out[:, there] = total
        columns = [some.column(names[c]) for c in kept] + [pa.array(v) for v in out]
        return pa.Table.from_arrays(columns, [*kept, *values]).cast(pa.schema([*[pa.field(c, some.schema.field(names[c]).type) for c in kept], *[pa.field(v, pa.float64()) for v in values]]))

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(one, schema)


def ranked(voxels: DataFrame, window: int, shape: tuple[int, int, int], value: str, keys: tuple[str, ...], mask: np.ndarray | None = None, size: int = BLOCK) -> DataFrame:
    """The middle value (the upper one of an even number) over cubes of `window` voxels, or over the mask's part of them; ends mirrored."""
    ship(voxels.sparkSession)
    below, above = window // 2, window - 1 - window // 2
    by = [*keys, *["_b" + a for a in AXES]]
    dealt = deal(voxels.select(*keys, *AXES, F.col(value).cast("double").alias(value)), shape, below, above, size)
    schema = StructType([*[voxels.schema[c] for c in (*keys, *AXES)], StructField(value, DoubleType())])

    def one(rows: pa.Table) -> pa.Table:
        start = [int(rows.column("_b" + a)[0].as_py()) * size for a in AXES]
        end = [min(s + size, n) for s, n in zip(start, shape, strict=True)]
        low, high = [max(0, s - below) for s in start], [min(n, e + above) for e, n in zip(end, shape, strict=True)]
        box = _array(rows, [value], low, high)[0]
        box = np.pad(box, [(below - (s - b), above - (h - e)) for s, b, h, e in zip(start, low, high, end, strict=True)], mode="symmetric")
        cubes = np.lib.stride_tricks.sliding_window_view(box, (window,) * 3)
        flat = cubes[..., mask] if mask is not None else cubes.reshape(*cubes.shape[:3], -1)
        middle = flat.shape[-1] // 2
        out = np.partition(flat, middle, axis=-1)[..., middle]
        place = np.indices(out.shape).reshape(3, -1)
        columns = [pa.array(np.full(out.size, rows.column(k)[0].as_py()), rows.schema.field(k).type) for k in keys]
        columns += [pa.array(place[d] + start[d], pa.int64()).cast(rows.schema.field(a).type) for d, a in enumerate(AXES)]
        return pa.Table.from_arrays([*columns, pa.array(out.ravel())], [*keys, *AXES, value])

    return dealt.groupBy(*by).applyInArrow(one, schema)
