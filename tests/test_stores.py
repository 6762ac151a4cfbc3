"""Zarr stores, multiscale metadata and reports."""

import gzip
import json
import zlib

import numpy as np
import pytest

from tests.test_engines import blob
from tests.test_operators import rows
from voxframe import cli
from voxframe.engines.features import SelfSimilarity
from voxframe.functions.scalar import VECTOR
from voxframe.plans import reports
from voxframe.sources import formats, zarr


def store(a, chunks, version, packed):
    files, pack = {}, {"gzip": gzip.compress, "zlib": zlib.compress, "zstd": __import__("zstandard").ZstdCompressor().compress, None: bytes}[packed]
    if version == 2:
        files[".zarray"] = json.dumps({"shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": {"id": packed} if packed else None, "fill_value": 0, "order": "C", "dimension_separator": "/"}).encode()
    else:
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": packed}] if packed else [])
        files["zarr.json"] = json.dumps({"node_type": "array", "shape": a.shape, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "data_type": a.dtype.name, "codecs": codecs, "fill_value": 0}).encode()
    pad = np.pad(a, [(0, -n % c) for n, c in zip(a.shape, chunks, strict=True)])
    for at in np.ndindex(*[n // c for n, c in zip(pad.shape, chunks, strict=True)]):
        block = pad[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        if block.any():
            files["/".join([*(["c"] if version == 3 else []), *map(str, at)])] = pack(np.ascontiguousarray(block).tobytes())
    return files.get


@pytest.mark.parametrize("version", [2, 3])
@pytest.mark.parametrize("packed", [None, "gzip", "zstd", "zlib"])
def test_zarr(version, packed):
    a = (np.random.default_rng(0).random((5, 7, 4)) * 100).astype("u2")
    a[:2] = 0
    z = zarr.open_array(store(a, (2, 3, 4), version, packed))
    assert (z.box((0, 0, 0), a.shape) == a).all() and (z.box((1, 2, 1), (4, 7, 3)) == a[1:4, 2:7, 1:3]).all()
    assert sum(int(np.prod(np.subtract(h, lo))) for lo, h in z.boxes()) == a.size


def test_zarr_refuses():
    with pytest.raises(ValueError):
        zarr.open_array(lambda key: None)
    with pytest.raises(ValueError):
        zarr.open_array(store(np.zeros((2, 2, 2), "u1"), (2, 2, 2), 2, None).__class__ and (lambda k: json.dumps({"shape": [1], "chunks": [1], "dtype": "|u1", "compressor": {"id": "blosc"}}).encode() if k == ".zarray" else None))


def test_axes_are_mapped():
    a = np.arange(24).reshape(1, 2, 3, 4).astype("u2")
    z = zarr.open_array(store(a, (1, 2, 3, 4), 2, None))
    assert (zarr.volume_box(z, ["c", "x", "z", "y"], (0, 0, 0), (3, 4, 2)) == a[0].transpose(1, 2, 0)).all()
    with pytest.raises(ValueError):
        zarr.volume_box(z, ["z", "c", "y", "x"], (0, 0, 0), (1, 1, 1))


def test_multiscales():
    axes = [{"name": n, "unit": "micrometer"} if n in "zyx" else {"name": n} for n in "czyx"]
    old = {"multiscales": [{"axes": axes, "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 20, 10, 10]}, {"type": "translation", "translation": [0, 1, 2, 3]}]}], "coordinateTransformations": [{"type": "scale", "scale": [1, 2, 2, 2]}]}]}
    assert zarr.datasets(old) == [zarr.Dataset("0", (40.0, 20.0, 20.0), (2.0, 4.0, 6.0))]
    new = {"ome": {"multiscales": [{"coordinateSystems": [{"name": "w", "axes": axes[1:]}], "datasets": [{"path": "s", "coordinateTransformations": [{"type": "sequence", "transformations": [{"type": "scale", "scale": [5, 5, 5]}]}]}]}]}}
    assert zarr.datasets(new)[0].scale_um == (5.0, 5.0, 5.0)
    assert zarr.datasets({"multiscales": [{"axes": ["z", "y", "x"], "datasets": [{"path": "a"}]}]})[0].scale_um is None
    for bad in ({}, {"multiscales": [{"axes": ["y", "x"], "datasets": []}]}):
        with pytest.raises(ValueError):
            zarr.datasets(bad)


def test_reports(spark, tmp_path, capsys):
    assert all(reports.selftest().values())
    a = blob((9, 8, 10))
    m = reports.feature_metrics(SelfSimilarity(), a)
    assert 1 <= m["participation"] <= 12 and 0 < m["explained"] <= 1
    still = rows(spark, **{u: np.full(a.shape, 0.01) for u in VECTOR})
    assert reports.sheet(rows(spark, v=a), rows(spark, v=a), still, a.shape, 0.1, 0.02)[:4] == b"\x89PNG"
    assert reports.probe(still).first()["value"] == pytest.approx(0.0173, rel=0.1)
    assert tuple(reports.chunk_counts(rows(spark, v=a), 4, 0.0).first()) == (18, 18)
    assert reports.calibrate(SelfSimilarity(), lambda n: SelfSimilarity()(np.zeros((n,) * 3)), 8)["rate"] > 0
    assert cli.main(["selftest"]) == 0
    (tmp_path / "a.nii").write_bytes(formats.write_nifti(formats.Volume(a)))
    assert cli.main(["features", str(tmp_path / "a.nii")]) == 0 and "participation" in capsys.readouterr().out
