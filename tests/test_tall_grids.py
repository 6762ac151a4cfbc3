"""Levels and windows of a grid of 18,000 planes, beyond the fixed lists of some queries' SQL."""

from voxframe.operators import tiling
from voxframe.operators.tiling import Grid
from voxframe.plans import frames

TALL = Grid((18000, 20, 25), 0.05)
SHAPES = [tuple(-(-n // 2**level) for n in TALL.shape) for level in range(13)]  # the last one fits into a core of 8


def lattice(shape, factor):
    z, y, x = (-(-n // factor) for n in shape)
    return z * y * x


def test_residual_maps_of_every_level(spark):
    got = sorted(map(tuple, frames.mapped_levels(spark, TALL, 8, 3, 100).collect()))
    assert got == [(level, lattice(s, 3), lattice(s, 3) <= 100) for level, s in enumerate(SHAPES)]


def test_windows_of_every_chunk(spark):
    got = tiling.anchored_windows(tiling.tile(spark, TALL.shape, 8, 4), 8, 6)
    ids = {0, 13, 3599, 3612, 14000, 26999}
    want = set()
    for i in ids:
        index = (i // 12, i // 4 % 3, i % 4)
        low = [max(k * 8 - 4, 0) for k in index]
        high = [min(k * 8 + 12, n) for k, n in zip(index, TALL.shape, strict=True)]
        z, y, x = ([w for w in range(-12, n + 12, 6) if w + 8 > a and w < b] for a, b, n in zip(low, high, TALL.shape, strict=True))
        want |= {(i, wz, wy, wx) for wz in z for wy in y for wx in x}
    some = list(map(tuple, got.where(got.chunk_id.isin(*ids)).collect()))
    assert len(some) == len(want) and set(some) == want
    assert got.select("chunk_id").distinct().count() == 27000


def test_layouts_of_every_level(spark):
    got = frames.block_layout(tiling.grids(spark, TALL, 8), 5, 8).select("level", *[f"{w}_{a}" for w in ("block", "file") for a in "zyx"])
    blocks = [[min(5, n) for n in s] for s in SHAPES]
    files = [[-(-min(8, n) // b) * b for n, b in zip(s, bs, strict=True)] for s, bs in zip(SHAPES, blocks, strict=True)]
    assert sorted(map(tuple, got.collect())) == [(level, *b, *f) for level, (b, f) in enumerate(zip(blocks, files, strict=True))]
