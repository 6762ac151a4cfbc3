"""Operators on voxel rows against their array forms."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.engines import arrays as A
from voxframe.functions.scalar import AXES, VECTOR
from voxframe.operators import blending, gather, pooling, stats, stencil, tiling
from voxframe.operators.tiling import Grid

SHAPE = (7, 6, 9)


def rows(spark, **arrays):
    first = next(iter(arrays.values()))
    where = np.indices(first.shape).reshape(3, -1).astype("int32")
    return spark.createDataFrame(pd.DataFrame({**dict(zip(AXES, where, strict=True)), **{k: v.ravel() for k, v in arrays.items()}}))


def dense(df, shape, *names):
    p = df.toPandas()
    out = np.full((len(names), *shape), np.nan)
    for i, n in enumerate(names):
        out[i][p.z, p.y, p.x] = p[n]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(1).random(SHAPE)


@pytest.fixture(scope="module")
def field():
    return np.random.default_rng(2).normal(0, 0.08, (3, *SHAPE))


def test_warp(spark, image, field):
    got = gather.warp(rows(spark, v=image), rows(spark, **dict(zip(VECTOR, field, strict=True))), SHAPE, 0.05, cval=-1.0)
    assert np.allclose(dense(got, SHAPE, "v")[0], A.warp(image[None], field, 0.05, -1.0)[0])


def test_compose(spark, field):
    other = field[:, ::-1].copy()
    got = gather.compose(rows(spark, **dict(zip(VECTOR, field, strict=True))), rows(spark, **dict(zip(VECTOR, other, strict=True))), SHAPE, 0.05)
    assert np.allclose(dense(got, SHAPE, *VECTOR), A.compose(field, other, 0.05))


@pytest.mark.parametrize("sigma", [0.4, 1.0, 3.0])
def test_gaussian_even_past_the_volume(spark, image, sigma):
    assert np.allclose(dense(stencil.gaussian(rows(spark, v=image), sigma, SHAPE), SHAPE, "v")[0], A.smooth(image, sigma))


def test_median_mirrors_and_takes_the_upper(spark, image):
    wide = np.pad(image, 1, mode="symmetric")
    cubes = np.lib.stride_tricks.sliding_window_view(wide, (3, 3, 3)).reshape(*SHAPE, 27)
    assert np.allclose(dense(stencil.median(rows(spark, v=image), 3, SHAPE), SHAPE, "v")[0], np.median(cubes, -1))
    wide = np.pad(image, ((2, 1),) * 3, mode="symmetric")
    cubes = np.sort(np.lib.stride_tricks.sliding_window_view(wide, (4, 4, 4)).reshape(*SHAPE, 64), -1)
    assert np.allclose(dense(stencil.median(rows(spark, v=image), 4, SHAPE), SHAPE, "v")[0], cubes[..., 32])


def test_jacobian(spark, field):
    got = stencil.jacobian(rows(spark, **dict(zip(VECTOR, field, strict=True))), 0.05)
    assert np.allclose(dense(got, SHAPE, "det")[0], A.jacobian(field, 0.05))


@pytest.mark.parametrize("factor", [2, 3, 4])
def test_pool(spark, image, factor):
    got = pooling.pool(rows(spark, v=image), factor, shape=SHAPE)
    small = tuple(-(-n // factor) for n in SHAPE)
    assert np.allclose(dense(got, small, "v")[0], A.pool(image, factor))


@pytest.mark.parametrize("offset", [(1, 0, -2), (-3, 2, 9), (0, 0, 0), (20, -20, 1)])
def test_shift(spark, image, offset):
    at = [np.clip(np.arange(n) + k, 0, n - 1) for n, k in zip(SHAPE, offset, strict=True)]
    assert np.allclose(dense(stencil.shift(rows(spark, v=image), offset, SHAPE), SHAPE, "v")[0], image[np.ix_(*at)])


def test_blend_of_equal_parts_is_the_field(spark, field):
    f = rows(spark, **dict(zip(VECTOR, field, strict=True)))
    got = blending.blend(tiling.halo_expand(f, SHAPE, 3, 2), SHAPE, 3, 2)
    assert np.allclose(dense(got, SHAPE, *VECTOR), field)


def test_touching_equals_brute_force(spark):
    chunks = tiling.tile(spark, (20, 9, 31), 4, 6)
    got = {(r[0], r[1]) for r in tiling.touching(chunks, tiling.blend_boxes(chunks, (20, 9, 31), 3), 4, 6, 3).select("chunk_id", "box_id").collect()}
    c = chunks.toPandas()
    want = set()
    for a in c.itertuples():
        for b in c.itertuples():
            ok = True
            for ax, n in zip(AXES, (20, 9, 31), strict=True):
                lo, hi = max(0, getattr(b, f"core_{ax}0") - 3), min(n, getattr(b, f"core_{ax}0") + getattr(b, f"core_n{ax}") + 3)
                ok &= min(getattr(a, f"pad_{ax}0") + getattr(a, f"pad_n{ax}"), hi) > max(getattr(a, f"pad_{ax}0"), lo)
            if ok:
                want.add((a.chunk_id, b.chunk_id))
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 2000, allow_nan=False), min_size=1, max_size=40))
def test_array_bins_bound_the_percentile(values):
    v = np.array(values)
    bins = np.where(v < 1e-6, 0, np.minimum(255, 1 + np.floor((np.log10(np.maximum(v, 1e-12)) + 6) * 254 / 9))).astype(int)
    edges = np.concatenate([[0], 10 ** (-6 + 9 * np.arange(0, 255) / 254), [np.inf]])
    assert ((v >= edges[bins] * (1 - 1e-9)) & (v <= edges[bins + 1] * (1 + 1e-9))).all()


def test_percentile_of_merged_parts(spark):
    v = np.random.default_rng(0).lognormal(-2, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(500) % 7, "v": v}))
    got = stats.percentile(stats.merged(stats.histogram(df, "v", ("k",))), 99).first()
    assert np.quantile(v, 0.99, method="inverted_cdf") <= got["value"] <= np.quantile(v, 0.99, method="inverted_cdf") * 1.09


def test_grids():
    g = Grid((1920, 2560, 2560), 0.05)
    assert tiling.depth(g.shape, 256) == 4
    assert g.coarsened(4).shape == (480, 640, 640) and g.coarsened(4).origin[0] == pytest.approx(0.075)
    assert g.same(Grid(g.shape, 0.05)) and not g.same(g.coarsened(2))


def test_resample_to_itself(spark, image):
    g = Grid(SHAPE, 0.05, (1.0, 2.0, 3.0))
    assert np.allclose(dense(gather.resample(rows(spark, v=image), g, g), SHAPE, "v")[0], image)


def test_chunks_of_the_whole_volume_are_registered(spark):
    """30 planes, so two layers of chunks of 16."""
    from voxframe.plans.queries import QUERIES

    got = QUERIES["register_chunks"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["chunk_id"] for r in got) == list(range(8))


def volume_array(spark, sf, scale=1.0):
    from voxframe.sources import tables

    shape = tables.shape(spark, sf)
    return dense(tables.volume(spark, sf), shape, "v")[0] / scale, shape


def test_self_similarity_equals_arrays(spark):
    from voxframe.engines.features import SelfSimilarity
    from voxframe.plans.queries import CORE, HALO, QUERIES

    sf = "/root/testdata/sf0.001"
    a, shape = volume_array(spark, sf)
    got = {(r["chunk_id"], r["channel"]): r["mean"] for r in QUERIES["self_similarity"](spark, sf).collect()}
    for i, at in enumerate(np.ndindex(*[-(-n // CORE) for n in shape])):
        box = a[tuple(slice(max(0, k * CORE - HALO), min(n, (k + 1) * CORE + HALO)) for k, n in zip(at, shape, strict=True))]
        for c, m in enumerate(SelfSimilarity()(box).mean((1, 2, 3))):
            assert got[i, c] == pytest.approx(m, abs=2e-6)
    assert len(got) == 12 * (i + 1)


def test_registered_chunks_equal_the_solver_on_arrays(spark):
    from voxframe.engines.demons import Stage
    from voxframe.plans import config, groupwise
    from voxframe.plans.queries import QUERIES
    from voxframe.sources.tables import SPACING

    sf = "/root/testdata/sf0.001"
    a, shape = volume_array(spark, sf, 300000)
    b = a[:, np.clip(np.arange(shape[1]) + 1, 0, shape[1] - 1)]
    run = config.load({"tiling": {"core": 16, "halo": 8}, "solver": {"stages": [{"scales": [1], "iterations": [4]}]}})
    got = {r["chunk_id"]: r for r in QUERIES["register_chunks"](spark, sf).collect()}
    for i, at in enumerate(np.ndindex(*[-(-n // 16) for n in shape])):
        low = [max(0, k * 16 - 8) for k in at]
        box = tuple(slice(o, min(n, (k + 1) * 16 + 8)) for o, k, n in zip(low, at, shape, strict=True))
        core = tuple(slice(k * 16 - o, min(n, (k + 1) * 16) - o) for o, k, n in zip(low, at, shape, strict=True))
        seed = np.zeros((3, *a[box].shape))
        _, record = groupwise.solve_chunk(a[box], b[box], seed, core, run, SPACING, run.clamp_voxels() * SPACING, (Stage(scales=(1,), iterations=(4,)),), 0, 0)
        r = got[i]
        assert (r["reason"], r["retries"]) == (record["reason"], record["retries"])
        assert r["tissue_fraction"] == pytest.approx(record["tissue_fraction"], abs=1e-6) and r["folds"] == pytest.approx(record["folds"], abs=1e-6)
    assert len(got) == i + 1


def test_exact_quantiles_equal_numpy(spark):
    g = np.random.default_rng(4)
    data = {0: g.lognormal(0, 2, 700), 1: np.full(9, 3.5), 2: np.round(g.normal(size=401), 1), 3: np.array([7.0])}
    df = spark.createDataFrame(pd.DataFrame({"k": np.concatenate([np.full(len(v), k) for k, v in data.items()]), "v": np.concatenate(list(data.values()))}))
    for cells in (1, 5, 4096):
        got = {r["k"]: r["p"] for r in stats.exact_quantiles(df, "v", (0.0, 0.005, 0.5, 0.99, 1.0), ("k",), cells).collect()}
        for k, v in data.items():
            assert np.allclose(got[k], np.quantile(v, (0.0, 0.005, 0.5, 0.99, 1.0)))
    assert np.allclose(stats.exact_quantiles(df, "v", (0.25,)).first()[0], np.quantile(np.concatenate(list(data.values())), 0.25))
    assert stats.exact_quantiles(df.limit(0), "v", (0.5,)).count() == 0


def test_sampling_over_several_blocks(spark):
    """Blocks of 4 voxels, places beyond the ends, fading and clamped."""
    from pyspark.sql import functions as F

    from voxframe.operators import blocks

    g = np.random.default_rng(5)
    a, shape = g.random((9, 11, 6)), (9, 11, 6)
    p = g.uniform(-2, 12, (3, 300))
    places = spark.createDataFrame(pd.DataFrame({"i": np.arange(300), "cz": p[0], "cy": p[1], "cx": p[2], "v": "text"}))
    for boundary in ("constant", "nearest", "fade"):
        inside = F.lit(True)
        q = p
        if boundary == "constant":
            for c, n in zip(("cz", "cy", "cx"), shape, strict=True):
                inside = inside & (F.col(c) >= 0) & (F.col(c) <= n - 1)
        if boundary == "nearest":
            q = np.clip(p, 0, np.array(shape)[:, None] - 1)
        here = places.withColumns({c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(n - 1.0)) for c, n in zip(("cz", "cy", "cx"), shape, strict=True)}) if boundary == "nearest" else places
        got = {r["i"]: r["v"] for r in blocks.interpolated(here, rows(spark, v=a), shape, ("v",), ("cz", "cy", "cx"), inside, -5.0, (), 4).collect()}
        wide = np.pad(a, 4)
        want = A.sample(a, p, "constant", -5.0) if boundary == "constant" else A.sample(wide, np.clip(q, -3, 14) + 4, "nearest")
        assert np.allclose([got[i] for i in range(300)], want)


def test_rank_filters_over_several_blocks(spark, image):
    from voxframe.operators import blocks

    for size in (2, 3, 32):
        got = blocks.ranked(rows(spark, v=image), 3, SHAPE, "v", (), None, size)
        wide = np.lib.stride_tricks.sliding_window_view(np.pad(image, 1, mode="symmetric"), (3, 3, 3)).reshape(*SHAPE, 27)
        assert np.allclose(dense(got, SHAPE, "v")[0], np.median(wide, -1))
