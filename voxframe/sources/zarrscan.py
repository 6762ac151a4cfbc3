"""Zarr arrays and multiscale images as tables: Spark reads the chunk files, each is unpacked where it lands.

Any path that Spark reads will do. A chunk is a row until it is unpacked, so a task holds one chunk, and a box reads
only the chunks that it meets. Voxels of chunks that are missing have the array's fill value.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES
from voxframe.session import ship
from voxframe.sources.zarr import Dataset, Get, ZarrArray, axes, datasets, open_array

#: Files whose presence makes a folder a Zarr store.
MARKS = ("zarr.json", ".zarray", ".zgroup", ".zattrs")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_zarr(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a Zarr array or group."""
    return any(_exists(spark, f"{path.rstrip('/')}/{m}") for m in MARKS)


def _get(spark: SparkSession, root: str) -> Get:
    """Reads a store's small files by key; by Hadoop itself, as Spark's readers skip names that begin with a dot."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def get(key: str) -> bytes | None:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{key}")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    return get


def attributes(spark: SparkSession, path: str) -> dict:
    """A group's attributes, of version 2 or 3; empty without any."""
    get = _get(spark, path)
    if (raw := get("zarr.json")) is not None:
        return json.loads(raw).get("attributes", {})
    return json.loads(get(".zattrs") or b"{}")


def image_levels(spark: SparkSession, path: str) -> list[Dataset]:
    """The datasets of a multiscale image."""
    return datasets(attributes(spark, path))


def open_zarr(spark: SparkSession, path: str, dataset: str | None = None) -> tuple[str, ZarrArray, list[str]]:
    """(folder, array, axis names) of an array, or of an image's dataset (the first one by default)."""
    told = attributes(spark, path)
    image = told.get("ome", told).get("multiscales")
    names = None
    if image:
        names = [n for n, _ in axes(image[0])]
        path = f"{path.rstrip('/')}/{dataset or image[0]['datasets'][0]['path']}"
    elif dataset:
        path = f"{path.rstrip('/')}/{dataset}"
    array = open_array(_get(spark, path))
    names = list(array.names or names or "tczyx"[-len(array.shape) :])[-len(array.shape) :]
    if any(a not in names for a in AXES):
        raise ValueError(f"an image needs axes z, y and x, not {names}")
    for n, size in zip(names, array.shape, strict=True):
        if n not in AXES and size != 1:
            raise ValueError(f"axis {n} has {size} entries; one is read")
    return path, array, names


def read_zarr(spark: SparkSession, path: str, dataset: str | None = None, low: Sequence[int] | None = None, high: Sequence[int] | None = None) -> DataFrame:
    """(z, y, x, v) of a Zarr array or of a dataset of an image, whole or in the box [low, high); axes may come in any order."""
    ship(spark)
    root, array, names = open_zarr(spark, path, dataset)
    place = [names.index(a) for a in AXES]
    n = [array.shape[i] for i in place]
    low = [max(0, int(v)) for v in low] if low is not None else [0, 0, 0]
    high = [min(k, int(v)) for k, v in zip(n, high, strict=True)] if high is not None else n
    count = [-(-k // c) for k, c in zip(array.shape, array.chunks, strict=True)]
    first = [0] * len(count)
    last = list(count)
    for i, a, b in zip(place, low, high, strict=True):
        first[i], last[i] = a // array.chunks[i], -(-b // array.chunks[i])
    whole = first == [0] * len(count) and last == count
    keyed = F.regexp_extract("path", rf"((?:\d+[./]){{{len(count) - 1}}}\d+)$", 1)
    binary = spark.read.format("binaryFile")
    if whole:
        files = binary.option("recursiveFileLookup", "true").load(root)
    else:
        wanted = [f"{root}/{array.key(at)}" for at in itertools.product(*map(range, first, last))]
        found = [p for p in wanted if _exists(spark, p)]
        files = binary.load(found) if found else spark.createDataFrame([], "path string, content binary")
    files = files.select(F.split(keyed, "[./]").cast("array<int>").alias("at"), "content", keyed.alias("_key")).where("_key <> ''").drop("_key")
    if array.fill:  # chunks without a file hold voxels too
        sizes = [b - a for a, b in zip(first, last, strict=True)]
        i = F.col("id")
        each = [(F.floor(i / int(np.prod(sizes[d + 1 :], dtype=int))) % sizes[d] + first[d]).cast("int") for d in range(len(sizes))]
        files = spark.range(int(np.prod(sizes, dtype=int))).select(F.array(*each).alias("at")).join(files, "at", "left")
    bare = replace(array, get=None, key=None)  # what a task needs of it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                chunk = replace(bare, get=lambda _, raw=raw: raw.as_py(), key=lambda at: "").chunk(tuple(at)).transpose([*place, *[i for i in range(len(names)) if i not in place]]).reshape([bare.chunks[i] for i in place])
                start = [at[i] * bare.chunks[i] for i in place]
                a, e = [max(s, lo) for s, lo in zip(start, low, strict=True)], [min(s + c, hi) for s, c, hi in zip(start, chunk.shape, high, strict=True)]
                for z in range(a[0], e[0]):  # a plane at a time bounds what is held beside the chunk
                    part = chunk[z - start[0], a[1] - start[1] : e[1] - start[1], a[2] - start[2] : e[2] - start[2]]
                    y, x = (g.ravel().astype(np.int32) for g in np.meshgrid(np.arange(a[1], e[1]), np.arange(a[2], e[2]), indexing="ij"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), z, np.int32)), pa.array(y), pa.array(x), pa.array(part.ravel().astype(float))], [*AXES, "v"])

    return files.select("at", "content").mapInArrow(run, "z int, y int, x int, v double")
