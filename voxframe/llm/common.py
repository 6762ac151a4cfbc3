"""Shared helpers of the text operators: tables, shared scratch folders, Arrow buffers and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.session import ship

#: Arrow batches are cut at this many rows or bytes, so that a batch of long texts stays small in a worker.
ROWS_PER_BATCH, BYTES_PER_BATCH = 4000, 4_000_000
#: Texts of one batch are worked on in slices of about this many bytes (one text at least).
SLICE_BYTES = 1_000_000
#: Largest list of ids that is broadcast; beyond it the same rows are found by a shuffle join.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession, batch_bytes: int = BYTES_PER_BATCH) -> SparkSession:
    """Bounds the Arrow batches of this session and sends the package's code to the executors, once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return spark


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where that setting is unset, a folder of this machine is set and used if the session runs on this machine
    alone; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="voxframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)  # when the application ends
    return folder


def staged(df: DataFrame, what: str) -> DataFrame:
    """Writes rows to the shared folder and reads them back: lineage ends there, and lost executors take nothing."""
    path = scratch(df.sparkSession, what)
    schema = df.schema
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop shuffle files of finished steps
    return df.sparkSession.read.schema(schema).parquet(path)


def removed(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes staged rows that no later step reads."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, by Spark's own statistics; 0 where it reads none."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0  # the default of rows that are in no file
    return total


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def keep_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Semi or anti join on an id: the id list is broadcast only if it is checked to be small."""
    if small_enough(ids):
        return docs.join(F.broadcast(ids), key, how)
    return docs.join(ids.hint("shuffle_hash"), key, how)


def lean(run: Callable[[Iterator], Iterator], cycles: bool = True) -> Callable[[Iterator], Iterator]:
    """A task's function that gives memory back to the system when it ends: workers live on into later stages.

    Without cycles the search for cyclic garbage, slow beside millions of words, waits until then.
    """

    def lean_run(batches: Iterator) -> Iterator:
        if not cycles:
            gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return lean_run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two rounds of xor-shift and multiplication), in place on uint64."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit words."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
