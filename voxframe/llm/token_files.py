"""Token ids in ORC: run-length encoded stripes with row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id, so each file holds one range in ascending order and its stripes
can be read in parallel or skipped by their statistics. ORC's writer run-length encodes the ids; its row
index holds the least and the greatest doc_id of every stride of rows, its Bloom filters answer for single ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.llm.common import lean, scratch, staged, tuned
from voxframe.llm.words import column_encoder

#: Id after the last token of each document.
END_ID = 2
#: Bytes of text that are encoded at once: they bound a worker's memory, the words between them are remembered.
WRITE_BYTES = 2_000_000
#: Writer settings: stripe size, rows between two entries of the row index, false positives of the Bloom filters.
STRIPE_BYTES, INDEX_ROWS, BLOOM_FPP = 8 << 20, 1000, 0.01


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about `most` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encode_texts(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (array of int): the whole text's ids, then the end id. Null text counts as empty."""
    tuned(docs.sparkSession, WRITE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = column_encoder(path)
        for b in gathered(batches, WRITE_BYTES):
            ids, at = encoder.column(b.column(1))
            flat = np.insert(ids, at[1:], end_id)
            ends = pa.array((at + np.arange(len(at))).astype(np.int32))
            del ids, at
            out = pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))], ["doc_id", "ids"])
            del b, flat, ends
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, False), "doc_id long, ids array<int>")


def in_order(docs: DataFrame) -> bool:
    """Whether each partition's doc_ids lie after those of all before it, or can be taken in such an order.

    Reads the ids alone; what is compared is a row a partition. Null ids, which come first, count as out of order.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().alias("part"))
    parts = ids.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("none"))
    after = Window.orderBy("low", "high")
    wrong = parts.select("none", (F.col("high") > F.lead("low").over(after)).alias("crossed"))
    return not wrong.where("none > 0 OR crossed").limit(1).count()


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of all documents to ORC files in `folder`, in ascending doc_id order from file to file.

    Documents whose partitions are in order already, as those of a sorted table are, stay where they lie;
    others are shuffled once, by ranges of doc_id (evenly sized whatever the ids). The ids are made after
    that and go straight to the writer. Null texts hold the end id alone; repeated doc_ids stand side by side,
    in any order among themselves.
    """
    spark = docs.sparkSession
    ranged = docs.select("doc_id", "text")
    if not in_order(ranged):
        ranged = ranged.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id")
    ranged = ranged.sortWithinPartitions("doc_id")
    (encode_texts(ranged, path, end_id).write.option("compression", "lz4").option("orc.stripe.size", STRIPE_BYTES)
     .option("orc.row.index.stride", INDEX_ROWS).option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", BLOOM_FPP).orc(folder))


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids from the files; with doc_ids only these, whose filter the reader answers from its metadata."""
    rows = spark.read.schema("doc_id long, ids array<int>").orc(folder)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def offsets(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files.

    A task sums each file's part that it reads; `start` is the count of the files before (a row a file),
    then a running sum inside the file, in the order of its rows, so that rows that share a doc_id have the
    places that they hold in the file. Null doc_ids come first, as they do in the files.
    """
    tuned(rows.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            at = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), *b.columns[2:]], ["doc_id", "n_tokens", "ids_crc32", "file", "block", "row"])

    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    named = rows.select("doc_id", "ids", *place).mapInArrow(lean(digest), "doc_id long, n_tokens long, ids_crc32 long, file string, block long, row long")
    named = staged(named, "ids-read")  # both uses below read this, not the files twice
    files = named.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    order = Window.orderBy(F.col("least").asc_nulls_first(), F.col("most").asc_nulls_first(), "file")
    crossed = F.coalesce(F.lag("most").over(order) > F.col("least"), F.lit(False))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", F.when(crossed, F.raise_error(F.lit("files of ids are not in the order of doc_id")).cast("long")).otherwise(before).alias("before"))
    inside = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (named.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "file")
            .select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32"))


def written_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all documents to ORC files in the shared folder and describes what the files hold."""
    folder = scratch(docs.sparkSession, "ids-orc")
    write(docs, folder, path)
    return offsets(read(docs.sparkSession, folder))
