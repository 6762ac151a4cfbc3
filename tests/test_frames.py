"""Frames, layouts, colours, stores and scans."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_engines import blob
from tests.test_operators import dense, rows
from voxframe.functions.scalar import AXES, VECTOR
from voxframe.operators import gather
from voxframe.operators.tiling import Grid
from voxframe.plans import colours, frames
from voxframe.sources import datasource, formats, stores, zarrscan
from voxframe.sources import volumes as V


def test_spacing_and_types():
    assert frames.spacing_of((0.05, 0.05, 0.0500000001)) == pytest.approx(0.05) and frames.spacing_of((0.05, 0.1, 0.1)) == (0.05, 0.1, 0.1)
    assert [frames.stored_type("auto", k).name for k in ("bool", "int16", "uint8", "float64")] == ["uint8", "int16", "uint8", "float32"]
    assert frames.stored_type("float64", "uint8") == np.dtype("f8")


def test_boxes_of_indices():
    assert frames.box_of((slice(1, 3), 2), (5, 6, 7)) == ((1, 2, 0), (3, 3, 7))
    assert frames.box_of((Ellipsis, -1), (5, 6, 7)) == ((0, 0, 6), (5, 6, 7))
    assert frames.box_of(slice(4, 2), (5, 6, 7))[1][0] == 4
    for bad in ((slice(None, None, 2),), (9,), (0, 0, 0, 0)):
        with pytest.raises(IndexError):
            frames.box_of(bad, (5, 6, 7))


def test_split_covers_the_box():
    parts = frames.split((1, 0, 3), (20, 7, 64), lambda size: np.prod(size) <= 100)
    seen = np.zeros((20, 7, 64), int)
    for low, high in parts:
        assert np.prod(np.subtract(high, low)) <= 100
        seen[tuple(slice(a, b) for a, b in zip(low, high, strict=True))] += 1
    assert seen.sum() == 19 * 7 * 61 and seen.max() == 1 and frames.split((0, 0, 0), (0, 5, 5), lambda s: True) == []


def test_maps_between_frames():
    grid = Grid((10, 11, 12), 0.2, (1.0, -2.0, 0.5))
    turn = np.array([[0, -1, 0, 5.0], [1, 0, 0, -3.0], [0, 0, 2, 1.0]])
    w = frames.world_to_source(grid, (200.0,) * 3, (7.0, 8.0, 9.0), turn)
    voxel = np.array([2.0, 3.0, 4.0])
    world = np.array(grid.origin) + voxel * grid.spacing
    fixed = voxel * 200 + np.array([7.0, 8.0, 9.0])
    assert turn[:, :3] @ (w[:3, :3] @ world + w[:3, 3]) + turn[:, 3] == pytest.approx(fixed)
    m = frames.voxel_matrix(grid, w, (40.0,) * 3, (1.0, 2.0, 3.0))
    assert (m[:, :3] @ voxel + m[:, 3]) * 40 + np.array([1.0, 2.0, 3.0]) == pytest.approx(w[:3, :3] @ world + w[:3, 3])
    assert (frames.matrix_in(json.dumps({"note": "x", "m": turn.tolist()})) == frames.square(turn)).all()
    with pytest.raises(ValueError):
        frames.matrix_in('{"a": 1}')
    assert frames.physical_frame(grid) == ((200.0,) * 3, (0.0,) * 3)
    assert frames.physical_frame(grid, [((10, 11, 12), (199.0,) * 3, (1.0, 2.0, 3.0)), ((5, 6, 6), (400.0,) * 3, (0.0,) * 3)])[0] == (199.0,) * 3


def test_levels_of_a_run():
    s = [0.05, 0.1, 0.2, 0.4]
    assert frames.run_levels(s) == (3, 2, 1, 0) and frames.run_levels(s, stop_at=0.1) == (3, 2, 1)
    assert frames.run_levels(s, "listed", {1: []}, {0: {}}) == (3, 1, 0) and frames.run_levels(s, [3, 0.10001]) == (3, 1)
    for bad in ([0, 1], [3, 0.3]):
        with pytest.raises(ValueError):
            frames.run_levels(s, bad)


def test_workers_and_releases():
    assert frames.workers(20e9, 80) == (2, True) and frames.workers(50e9, 80) == (1, True) and frames.workers(50e9, 80, 2) == (2, False)
    front = frames.Front({0: {1, 2}, 1: {2, 3}, 2: {3}})
    assert [front.ended(c) for c in (1, 0, 0, 2)] == [[], [1, 2], [], [3]]


def test_colours(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(300, 6)) @ np.diag([5, 3, 2, 0.5, 0.2, 0.1]) + np.arange(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, f array<double>")
    basis, mean, shares = colours.colour_basis(df, "f", 6)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs((basis * vt[:3]).sum(1)), 1) and np.allclose(mean, x.mean(0)) and np.allclose(shares, s[:3] ** 2 / (s**2).sum())
    got = {r["i"]: (r["r"], r["g"], r["b"]) for r in colours.ranged(colours.projected(df, "f", basis, mean)).collect()}
    p = (x - mean) @ basis.T
    low, high = np.percentile(p, 1, 0), np.percentile(p, 99, 0)
    assert np.allclose([got[i] for i in range(300)], np.clip((p - low) / (high - low), 0, 1))
    sheet = colours.contact_sheet({("a", 0): np.full((8, 8, 3), 9, np.uint8), ("b", 2): np.full((8, 8, 3), 7, np.uint8)})
    assert sheet.shape == (18, 18, 3) and sheet[0, 0, 0] == 9 and sheet[-1, -1, 0] == 7 and sheet[0, -1, 0] == 0


def test_stores(spark, tmp_path):
    a, grid, root = blob((20, 9, 70)), Grid((20, 9, 70), 0.1, (0.0, 1.0, 2.0)), f"file://{tmp_path}/s"
    store = stores.Store.create(spark, root, grid, core=16)
    store.write_level(0, rows(spark, v=a))
    store.build()
    again = stores.Store.open(spark, root)
    assert again.grid == grid and sorted(again.meta["levels"]) == ["0", "1", "2", "3"]
    assert np.allclose(dense(again.level(0), a.shape, "v")[0], a)
    box = again.read_box(0, (3, -1, 60), (9, 4, 99))
    assert box.count() == 6 * 4 * 10 and np.allclose(sorted(r["v"] for r in box.collect()), sorted(a[3:9, :4, 60:].ravel()))
    with pytest.raises(ValueError):
        stores.Store.create(spark, root, grid)
    with pytest.raises(KeyError):
        again.level(7)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("no store")
    with pytest.raises(ValueError):
        stores.Store.create(spark, f"file://{tmp_path}/other", grid, overwrite=True)
    field = stores.Store.create(spark, f"file://{tmp_path}/f", grid, "field", 16)
    block = np.random.default_rng(0).random((3, 8, 9, 6))
    field.write_lattice(0, (0, 0, 64), block)
    got = {tuple(r[a] for a in AXES): tuple(r[u] for u in VECTOR) for r in field.level(0).collect()}
    assert len(got) == 8 * 9 * 6 and got[2, 3, 65] == pytest.approx(tuple(block[:, 2, 3, 1]))
    with pytest.raises(ValueError):
        field.write_lattice(0, (1, 0, 0), block)
    linked = stores.link_source(spark, f"file://{tmp_path}/l", root, grid, core=16)
    assert linked.meta["levels"]["0"]["how"] == "linked" and linked.level(1).count() == again.level(1).count()
    with pytest.raises(ValueError):
        linked.write_level(0, rows(spark, v=a))
    whole = stores.ingest(spark, f"file://{tmp_path}/i", rows(spark, v=a * 300), grid, "auto", "uint8", 16)
    assert whole.meta["dtype"] == "uint8" and whole.level(0).agg(F.max("v")).first()[0] == 255
    memory = stores.Memory(spark)
    assert memory.write("a", rows(spark, v=a)).count() == a.size and memory.has("a")
    memory.remove("a")
    assert not memory.has("a")


def test_warm_start_refuses_other_frames(spark):
    f = rows(spark, **{u: np.zeros((4, 4, 4)) for u in VECTOR})
    with pytest.raises(ValueError):
        frames.warm_start(f, Grid((4, 4, 4), 0.2), Grid((8, 8, 8), 0.1, (5.0, 0.05, 0.05)))
    assert frames.warm_start(f, Grid((4, 4, 4), 0.2, (0.05,) * 3), Grid((8, 8, 8), 0.1)).count() == 512


@pytest.mark.parametrize("name", ["v.nii", "v.nii.gz", "v.tif"])
def test_files_by_slabs(spark, tmp_path, name):
    """More planes than a slab has, each task reading its own."""
    a = (np.random.default_rng(3).random((150, 5, 6)) * 9000).astype("u2")
    raw = formats.write_nifti(formats.Volume(a, (0.1, 0.2, 0.3))) if "nii" in name else formats.write_tiff(a)
    (tmp_path / name).write_bytes(gzip.compress(raw) if name.endswith("gz") else raw)
    datasource.register(spark)
    df = spark.read.format("volume").option("planes", "40").load(str(tmp_path / name))
    assert df.rdd.getNumPartitions() == 4 and (dense(df, a.shape, "v")[0] == a).all()
    assert (dense(V.read_source(spark, str(tmp_path / name)), a.shape, "v")[0] == a).all()


def test_writing_by_planes(spark, tmp_path):
    a = np.round(np.random.default_rng(3).random((19, 5, 6)) * 900)
    a[7] = 0
    df = rows(spark, v=a).where("z <> 7")
    for name, dtype in (("w.nii", "f4"), ("w.tif", "u2")):
        V.write_volume(str(tmp_path / name), df, a.shape, dtype)
        assert (dense(V.read_source(spark, str(tmp_path / name)), a.shape, "v")[0] == a).all()
    for z in (0, 2, 10):
        (tmp_path / "slices").mkdir(exist_ok=True)
        (tmp_path / "slices" / f"s{z}.tif").write_bytes(formats.write_tiff(a[z : z + 1]))
    assert (dense(V.read_source(spark, str(tmp_path / "slices")), (3, 5, 6), "v")[0] == a[[0, 2, 10]]).all()


def zarr_folder(path, a, chunks, version, attributes=None, fill=0, names=None):
    path.mkdir(parents=True, exist_ok=True)
    if version == 2:
        (path / ".zarray").write_text(json.dumps({"shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": {"id": "zlib"}, "fill_value": fill, "order": "C", "dimension_separator": "."}))
    else:
        (path / "zarr.json").write_text(json.dumps({"node_type": "array", "shape": a.shape, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "data_type": a.dtype.name, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}], "fill_value": fill, "dimension_names": names}))
    import zlib

    pad = np.pad(a, [(0, -n % c) for n, c in zip(a.shape, chunks, strict=True)], constant_values=fill)
    for at in np.ndindex(*[n // c for n, c in zip(pad.shape, chunks, strict=True)]):
        block = np.ascontiguousarray(pad[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))])
        if (block == fill).all():
            continue
        file = path / (".".join(map(str, at)) if version == 2 else "c/" + "/".join(map(str, at)))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(zlib.compress(block.tobytes()) if version == 2 else gzip.compress(block.tobytes()))


@pytest.mark.parametrize("version, fill", [(2, 0), (3, 0), (2, 7), (3, 7)])
def test_zarr_scans(spark, tmp_path, version, fill):
    a = (np.random.default_rng(0).random((9, 7, 11)) * 100).astype("u2")
    a[:4, :3] = fill
    zarr_folder(tmp_path / "a.zarr", a, (4, 3, 5), version, fill=fill)
    path = f"file://{tmp_path}/a.zarr"
    assert zarrscan.is_zarr(spark, path) and not zarrscan.is_zarr(spark, f"file://{tmp_path}")
    got = np.nan_to_num(dense(zarrscan.read_zarr(spark, path), a.shape, "v")[0], nan=fill)
    assert (got == a).all()
    box = zarrscan.read_zarr(spark, path, None, (3, 1, 4), (8, 20, 9))
    want = np.full(a.shape, np.nan)
    want[3:8, 1:7, 4:9] = a[3:8, 1:7, 4:9]
    got = dense(box, a.shape, "v")[0]
    assert ((got == want) | np.isnan(got) & ((want == 0) | np.isnan(want))).all() and (fill == 0 or box.count() == 5 * 6 * 5)


def test_images_and_linked_files(spark, tmp_path):
    a = (np.random.default_rng(1).random((8, 6, 10)) * 100).astype("f4")
    root = tmp_path / "image.zarr"
    unit = [{"name": n, "unit": "millimeter"} for n in "xzy"]
    root.mkdir()
    (root / ".zattrs").write_text(json.dumps({"multiscales": [{"axes": unit, "datasets": [{"path": "s0", "coordinateTransformations": [{"type": "scale", "scale": [0.1, 0.1, 0.1]}]}, {"path": "s1"}]}]}))
    zarr_folder(root / "s0", np.ascontiguousarray(a.transpose(2, 0, 1)), (4, 4, 4), 2)
    half = a.reshape(4, 2, 3, 2, 5, 2).mean((1, 3, 5)).astype("f4")
    zarr_folder(root / "s1", np.ascontiguousarray(half.transpose(2, 0, 1)), (4, 4, 4), 2)
    path = f"file://{root}"
    assert zarrscan.image_levels(spark, path)[0].scale_um == pytest.approx((100.0,) * 3)
    assert np.allclose(dense(V.read_source(spark, path), a.shape, "v")[0], a)
    grid = Grid(a.shape, 0.1)
    linked = stores.link_pyramid(spark, f"file://{tmp_path}/p", path, grid, {0: "s0", 1: "s1"}, core=4)
    assert np.allclose(dense(linked.level(1), half.shape, "v")[0], half) and linked.level(2).count() == 2 * 2 * 3
    spec = frames.affine_spec(path, [{"path": "s0", "shape": list(a.shape), "scale_um": [100.0] * 3, "shift_um": [0.0] * 3}], frames.scaling([1000.0] * 3, (100.0, 0.0, 0.0)), (90.0, 0.0))
    view = stores.link_affine(spark, f"file://{tmp_path}/q", spec, grid, 4).level(0)
    want = np.zeros(a.shape)
    want[:-1] = np.where(a >= 90, 0, a)[1:]
    assert np.allclose(dense(view, a.shape, "v")[0], want, atol=1e-4)
    with pytest.raises(ValueError):
        frames.affine_spec(path, [], np.eye(4))


def test_affine_reads_only_its_box(spark):
    plan = gather.affine(rows(spark, v=blob((6, 6, 6))), (6, 6, 6), [[1, 0, 0, 0.5], [0, 1, 0, 0], [0, 0, 1, 0]], (6, 6, 6))
    assert plan.count() == 216
