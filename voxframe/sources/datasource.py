"""The `volume` data source: spark.read.format("volume").load(path) after register(spark)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxframe.session import ship
from voxframe.sources.formats import layout, reader


class Slab(InputPartition):
    """Some planes of a file."""

    def __init__(self, path: str, low: int, high: int) -> None:
        self.path, self.low, self.high = path, low, high


class VolumeReader(DataSourceReader):
    """Reads a NIfTI or TIFF file that every executor can open, a slab of planes a task.

    The driver reads the header (or the page directories) alone, a task its own planes: files may be larger
    than any machine's memory. A file packed by gzip has no such places, so each task goes through what lies
    before its slab. Rows leave as Arrow batches, a plane each.
    """

    def __init__(self, options: dict) -> None:
        path = options["path"]
        self.path, self.planes = path.removeprefix("file://") if path.startswith("file:///") else path, int(options.get("planes", 64))

    def partitions(self) -> list[Slab]:
        with open(self.path, "rb") as f:
            n = layout(self.path, reader(f)).shape[0]
        return [Slab(self.path, z, min(n, z + self.planes)) for z in range(0, n, self.planes)]

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        with open(slab.path, "rb") as f:
            read = reader(f)
            found = layout(slab.path, read)
            y, x = (pa.array(i, pa.int32()) for i in np.indices(found.shape[1:], np.int32).reshape(2, -1))
            for z in range(slab.low, slab.high):
                v = found.plane(read, z).ravel().astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), z, np.int32)), y, x, pa.array(v)], ["z", "y", "x", "v"])


class VolumeSource(DataSource):
    """(z, y, x, v) of one file; option planes sets the planes of a task."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return "z int, y int, x int, v double"

    def reader(self, schema: object) -> VolumeReader:
        return VolumeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    ship(spark)
    spark.dataSource.register(VolumeSource)
