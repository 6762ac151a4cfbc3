"""Whole runs, files, streams and plans."""

import datetime
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_engines import blob
from tests.test_operators import dense, rows
from voxframe import cli
from voxframe.engines import arrays as A
from voxframe.functions.scalar import AXES, VECTOR, length_in_um
from voxframe.operators.tiling import Grid
from voxframe.plans import config, groupwise
from voxframe.plans.rungrid import Scan, read_on, resolve
from voxframe.sources import formats
from voxframe.sources import volumes as V
from voxframe.streaming.sketches import windowed_histogram

RUN = {"spacing": 0.05, "tiling": {"core": 16, "halo": 8}, "stopping": {"caps": [1]}, "solver": {"coarsest": [{"scales": [2, 1], "iterations": [15, 8]}], "stages": [{"scales": [1], "iterations": [6]}]}}


def test_pair_and_resume(spark, tmp_path):
    a = blob((18, 14, 15))
    b = np.roll(a, 1, 0)
    told = []
    root = f"file://{tmp_path}/run"
    out = groupwise.register_pair(rows(spark, v=a), rows(spark, v=b), a.shape, config.load(RUN), root, told.append)
    u = dense(out.fields.where("subject = 1"), a.shape, *VECTOR)
    inner = slice(3, -3)
    assert ((a - A.warp(b[None], u, 0.05)[0])[inner] ** 2).mean() < 0.6 * ((a - b)[inner] ** 2).mean()
    assert len(told) == 2 and out.reports[-1].reason == "cap"
    again = groupwise.register_pair(rows(spark, v=a), rows(spark, v=b), a.shape, config.load(RUN), root)
    assert [r.d99_mm for r in again.reports] == [r.d99_mm for r in out.reports]
    store = groupwise.Store(spark, root)
    assert groupwise.status(store, 1, lambda level: 1) == [(1, 1), (0, 1)]
    groupwise.clean(store, 0, 0, 1)
    assert not store.has("level=0/pass=0/solved") and store.has("level=0/pass=0/fields")


def test_template_of_equal_subjects_is_the_subject(spark):
    a = blob((12, 10, 11))
    both = rows(spark, v=a).select(F.lit(1).alias("subject"), *AXES, "v").unionByName(rows(spark, v=a).select(F.lit(2).alias("subject"), *AXES, "v"))
    out = groupwise.build_template(both, a.shape, config.load(RUN | {"tiling": {"core": 16, "halo": 8}}))
    assert np.allclose(dense(out.template, a.shape, "v")[0], a, atol=1e-6)
    assert np.abs(dense(out.fields.where("subject = 1"), a.shape, *VECTOR)).max() < 1e-6


def test_apply_field(spark):
    a = blob((8, 8, 8))
    still = rows(spark, **{u: np.zeros(a.shape) for u in VECTOR})
    g = Grid(a.shape, 0.1)
    got = groupwise.apply_field(rows(spark, v=a), still, g, g.coarsened(2))
    assert np.allclose(dense(got, (4, 4, 4), "v")[0], A.pool(a, 2))


@pytest.mark.parametrize("kind", ["u1", "i2", "u2", "f4", "f8"])
def test_file_round_trips(kind):
    a = (np.random.default_rng(0).random((3, 4, 5)) * 100).astype(kind)
    v = formats.read_nifti(formats.write_nifti(formats.Volume(a, (0.3, 0.2, 0.1), (1, 2, 3))))
    assert (v.data == a).all() and v.voxel_mm == pytest.approx((0.3, 0.2, 0.1)) and v.origin_mm == (1, 2, 3)
    assert (formats.read_tiff(formats.write_tiff(a)) == a).all()
    import gzip

    assert (formats.open_volume("x.tif.gz", gzip.compress(formats.write_tiff(a))).data == a).all()


def test_formats_refuse_and_sort():
    for bad in (b"", b"nothing at all", b"II*\0"):
        with pytest.raises(Exception):  # noqa: B017
            formats.read_tiff(bad)
    with pytest.raises(ValueError):
        formats.open_volume("x.doc", b"")
    stack = formats.read_stack({f"s{i}.tif": formats.write_tiff(np.full((1, 2, 2), i, "u1")) for i in (10, 9, 1)})
    assert stack[:, 0, 0].tolist() == [1, 9, 10]
    assert formats.write_png(formats.heat(np.ones((4, 4)), 1.0, np.eye(4)))[:4] == b"\x89PNG"
    assert length_in_um("0.2 mm") == pytest.approx(200) and length_in_um("200um") == 200


def test_files_blocks_and_cli(spark, tmp_path, capsys):
    a = blob((5, 6, 7)).astype("f4")
    (tmp_path / "a.nii").write_bytes(formats.write_nifti(formats.Volume(a, (0.1, 0.1, 0.1))))
    got = V.read_volumes(spark, f"{tmp_path}/a.nii")
    assert np.allclose(dense(got, a.shape, "v")[0], a)
    labelled = got.select(F.lit(1).alias("subject"), F.lit(0).alias("level"), *AXES, "v")
    assert np.allclose(dense(V.to_voxels(V.to_blocks(labelled, 4)), a.shape, "v")[0], a)
    assert (formats.read_nifti(V.export(got, a.shape)).data == a).all()
    from voxframe.sources.datasource import register

    register(spark)
    assert np.allclose(dense(spark.read.format("volume").option("planes", 2).load(f"{tmp_path}/a.nii"), a.shape, "v")[0], a)
    (tmp_path / "s.json").write_text(json.dumps(RUN))
    assert cli.main(["check", str(tmp_path / "s.json")]) == 0 and "halo" in capsys.readouterr().out
    assert cli.main(["plan", "64", "64", "64"]) == 0
    store = groupwise.Store(spark, f"file://{tmp_path}/r")
    store.write("image", got.select(*AXES, "v"))
    assert cli.main(["export", f"file://{tmp_path}/r", "image", str(tmp_path / "b.tif")]) == 0
    assert np.allclose(formats.read_tiff((tmp_path / "b.tif").read_bytes()), a)


def test_levels_and_pyramid_check(spark):
    a = blob((8, 6, 4))
    fine, coarse = rows(spark, v=a), rows(spark, v=A.pool(a, 2))
    assert V.half_mean(coarse, fine, 1e-6) and not V.half_mean(fine.where("z < 4 AND y < 3 AND x < 2"), fine, 1e-6)
    levels = spark.createDataFrame([(0, 8, 6, 4), (1, 4, 3, 2)], "level int, nz int, ny int, nx int")
    sets = spark.createDataFrame([("p", 4, 3, 2), ("q", 4, 3, 2)], "path string, nz int, ny int, nx int")
    assert sorted((r["level"], r["path"]) for r in V.match_levels(levels, sets).collect() if r["path"]) == [(1, "p")]


def test_read_on_run_grid(spark):
    a = blob((8, 8, 8))
    scan = Scan("a", a.shape, (0.05,) * 3)
    grid, (place,) = resolve([scan], 0.1)
    assert np.allclose(dense(read_on(rows(spark, v=a), place, grid), grid.shape, "v")[0], A.pool(a, 2))
    grid, (place,) = resolve([scan])
    assert np.allclose(dense(read_on(rows(spark, v=a), place, grid), grid.shape, "v")[0], a)


def test_stream_equals_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    p = pd.DataFrame({"ts": [t + datetime.timedelta(minutes=7 * i) for i in range(60)], "value": np.random.default_rng(0).random(60)})
    spark.createDataFrame(p).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, windowed_histogram(batch, "ts", "value", "1 hour").collect()))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_histogram(stream, "ts", "value", "1 hour", "2 hours").writeStream.outputMode("complete").format("memory").queryName("h").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("h").collect())) == want
