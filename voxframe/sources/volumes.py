"""Volume files as tables: a Spark data source, blocks of arrays, and sinks.

spark.read.format("volume").load(path) gives (z, y, x, v) of a NIfTI or TIFF file, or of every such file below a
folder. Block rows hold a box of a volume as bytes; voxel rows and block rows turn into each other.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES
from voxframe.session import ship
from voxframe.sources.formats import natural, open_volume, write_planes

#: Planes that reach the driver at a time.
PLANES = 8
BLOCK = "subject int, level int, bz int, by int, bx int, origin array<int>, shape array<int>, data binary"


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, z, y, x, v) of volume files below a path that Spark reads; a task opens each file whole."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = open_volume(name, data).data
                for z in range(a.shape[0]):  # a plane at a time bounds what is held beside the file
                    y, x = np.indices(a.shape[1:]).reshape(2, -1).astype(np.int32)
                    n = len(y)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, z, np.int32)), pa.array(y), pa.array(x), pa.array(a[z].ravel().astype(float))], ["path", *AXES, "v"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(nii|tif|tiff)(\.gz)?$"))
    return files.select("path", "content").mapInArrow(run, "path string, z int, y int, x int, v double")


def voxel_size(spark: SparkSession, path: str) -> tuple[float, float, float] | None:
    """The voxel size (mm; z, y, x) that a file states."""
    row = spark.read.format("binaryFile").load(path).select("path", "content").first()
    return open_volume(row[0], bytes(row[1])).voxel_mm


def to_blocks(voxels: DataFrame, size: int) -> DataFrame:
    """Voxel rows (subject, level, z, y, x, v) as block rows of size voxels an axis; voxels without a row are 0."""
    ship(voxels.sparkSession)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows.iloc[0]
        low = np.array([int(at["b" + a]) * size for a in AXES])
        box = np.zeros((size,) * 3, "<f8")
        place = [rows[a].to_numpy() - o for a, o in zip(AXES, low, strict=True)]
        box[tuple(place)] = rows["v"].to_numpy()
        box = box[tuple(slice(0, int(p.max()) + 1) for p in place)]
        return pd.DataFrame([{"subject": at["subject"], "level": at["level"], **{"b" + a: at["b" + a] for a in AXES}, "origin": low.tolist(), "shape": list(box.shape), "data": np.ascontiguousarray(box).tobytes()}])

    keyed = voxels.withColumns({"b" + a: F.floor(F.col(a) / size).cast("int") for a in AXES})
    return keyed.groupBy("subject", "level", *["b" + a for a in AXES]).applyInPandas(one, BLOCK)


def to_voxels(blocks: DataFrame) -> DataFrame:
    """Block rows as voxel rows."""
    ship(blocks.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                box = np.frombuffer(r.data, "<f8").reshape(tuple(r.shape))
                where = np.indices(box.shape).reshape(3, -1)
                yield pd.DataFrame({"subject": r.subject, "level": r.level, **{a: (where[d] + r.origin[d]).astype("int32") for d, a in enumerate(AXES)}, "v": box.ravel()})

    return blocks.mapInPandas(run, "subject int, level int, z int, y int, x int, v double")


def plane_rows(voxels: DataFrame, shape: tuple[int, int, int], dtype: str = "f4") -> DataFrame:
    """(z, data): whole planes as bytes, put together on the executors; planes without a voxel have no row."""
    ship(voxels.sparkSession)
    kind = np.dtype(dtype)

    def one(rows: pa.Table) -> pa.Table:
        out = np.zeros(shape[1:], kind)
        v = rows.column("v").to_numpy()
        out[rows.column("y").to_numpy(), rows.column("x").to_numpy()] = np.rint(v) if kind.kind in "iu" else v
        return pa.table({"z": pa.array([rows.column("z")[0].as_py()], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    return voxels.select(F.col("z").cast("int").alias("z"), "y", "x", F.col("v").cast("double").alias("v")).groupBy("z").applyInArrow(one, "z int, data binary")


def planes(voxels: DataFrame, shape: tuple[int, int, int], dtype: str = "f4") -> Iterator[np.ndarray]:
    """The planes of a volume in order; the driver holds one Spark partition of about PLANES of them at a time."""
    at, empty = 0, np.zeros(shape[1:], dtype)
    parts = max(1, -(-shape[0] // PLANES))
    for r in plane_rows(voxels, shape, dtype).repartitionByRange(parts, "z").sortWithinPartitions("z").toLocalIterator():
        while at < r["z"]:
            yield empty
            at += 1
        yield np.frombuffer(r["data"], dtype).reshape(shape[1:])
        at += 1
    for _ in range(at, shape[0]):
        yield empty


def write_volume(path: str, voxels: DataFrame, shape: tuple[int, int, int], dtype: str = "f4", voxel_mm: tuple[float, float, float] | None = None, origin_mm: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """Writes a volume to a NIfTI or TIFF file of the driver, some planes at a time, whatever its size."""
    kind = "nii" if path.lower().endswith(".nii") else "tif"
    with open(path, "wb") as f:
        write_planes(f, planes(voxels, shape, dtype), shape, kind, dtype, voxel_mm, origin_mm)


def export(voxels: DataFrame, shape: tuple[int, int, int], kind: str = "nii", dtype: str = "f4", voxel_mm: tuple[float, float, float] | None = None) -> bytes:
    """A small volume as the bytes of a NIfTI or TIFF file; write_volume takes any size."""
    out = io.BytesIO()
    write_planes(out, planes(voxels, shape, dtype), shape, kind, dtype, voxel_mm)
    return out.getvalue()


def read_source(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """(z, y, x, v) of whatever lies at a path: a Zarr array or image, a volume file, or a folder of slices in natural order."""
    from voxframe.sources import datasource, zarrscan

    if zarrscan.is_zarr(spark, path):
        return zarrscan.read_zarr(spark, path, dataset)
    if path.lower().removesuffix(".gz").endswith((".nii", ".tif", ".tiff")):
        if "://" not in path or path.startswith("file:///"):
            datasource.register(spark)
            return spark.read.format("volume").load(path)
        return read_volumes(spark, path).drop("path")
    files = read_volumes(spark, path)
    names = sorted((r["path"] for r in files.select("path").distinct().collect()), key=natural)  # a name a slice
    order = spark.createDataFrame(list(enumerate(names)), "slice int, path string")
    return files.join(F.broadcast(order), "path").select((F.col("z") + F.col("slice")).alias("z"), "y", "x", "v")


def half_mean(coarse: DataFrame, fine: DataFrame, tolerance: float) -> bool:
    """Whether one level is the 2x mean of another, within a tolerance: what a linked pyramid must pass."""
    from voxframe.operators.pooling import pool

    both = coarse.join(pool(fine, 2).withColumnRenamed("v", "w"), list(AXES))
    worst = both.agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0]
    return worst is not None and worst <= tolerance


def match_levels(levels: DataFrame, datasets: DataFrame) -> DataFrame:
    """Run levels (level, nz, ny, nx) with the first dataset (path, nz, ny, nx) of the same size, null without one."""
    first = datasets.groupBy("nz", "ny", "nx").agg(F.min("path").alias("path"))
    return levels.join(first, ["nz", "ny", "nx"], "left")
