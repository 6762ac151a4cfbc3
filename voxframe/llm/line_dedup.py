"""Line deduplication over batches, with levelled sorted runs of line hashes.

The documents come in batches of ascending doc_id. A run is a sorted table (hash, owner) of the line keys
that some batches brought first. Each batch is merge-anti-joined with all runs; what it alone has becomes a
new run of level 0. When a level has FANOUT runs they are merged into one run of the next level, so a key
is rewritten once a level and a batch meets few runs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm.common import lean, scratch, tuned

#: Batches of a whole table, and runs of a level that are merged into one of the next.
BATCHES, FANOUT = 4, 2
#: Shortest key, in code points, that counts as a line worth dropping.
LEAST_CHARS = 10
#: ASCII white space that is stripped from a line's ends for its key.
BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes | None]:
    """The key of each line of a text; None where it has too few code points."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # on bytes this lowers A-Z alone
        key = line.strip(BLANKS)
        n = len(key)
        if n < LEAST_CHARS or n < 4 * LEAST_CHARS and len(key.decode()) < LEAST_CHARS:
            out.append(None)
        else:
            out.append(key)
    return out


def line_hashes(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id): 128-bit hashes of each document's distinct keys."""
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            hashes, owner = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if doc is not None and text:
                    found = {digest(k) for k in line_keys(text.encode()) if k is not None}
                    hashes += found
                    owner += [doc] * len(found)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(owner, pa.int64())], ["h1", "h2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "h1 long, h2 long, doc_id long")


class LineRuns:
    """The runs so far, in a shared folder: level -> paths of sorted tables (h1, h2, owner), keys distinct over all.

    A manifest in the folder names the runs; a later job that opens the same folder goes on from the last
    one. A run is listed only once it is written, and deleted only when no manifest lists it any more, so a
    job that is lost on the way leaves the runs as they were.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT) -> None:
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.levels: dict[int, list[str]] = {}
        self.written, self.version = 0, 0
        if self._fs.exists(self._path(self.folder)):
            names = [str(f.getPath().getName()) for f in self._fs.listStatus(self._path(self.folder))]
            known = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
            if known:
                told = json.loads(spark.read.text(f"{self.folder}/manifest-{known[-1]}.json", wholetext=True).first()[0])
                self.version, self.written = known[-1], told["written"]
                self.levels = {int(k): v for k, v in told["levels"].items()}

    def _tell(self) -> None:
        """Writes the next manifest, whole or not at all, and deletes the one before the last."""
        told = json.dumps({"written": self.written, "levels": self.levels}).encode()
        self.version += 1
        part, whole = self._path(f"{self.folder}/.manifest-{self.version}"), self._path(f"{self.folder}/manifest-{self.version}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(told))
        out.close()
        self._fs.rename(part, whole)
        self._fs.delete(self._path(f"{self.folder}/manifest-{self.version - 2}.json"), True)

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.folder}/level={level}/run={self.written}"
        self.written += 1
        rows.sortWithinPartitions("h1", "h2").write.mode("overwrite").parquet(path)
        self.levels.setdefault(level, []).append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        schema = "h1 long, h2 long, owner long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def all(self) -> DataFrame:
        """Every key with its owner."""
        return self._read([p for paths in self.levels.values() for p in paths])

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-joins a batch's lines with the runs and adds a run of the keys that it brings first."""
        own = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        if self.levels:
            own = own.join(self.all().hint("merge"), ["h1", "h2"], "left_anti")
        self._write(own, 0)
        level, old = 0, []
        while len(self.levels.get(level, [])) >= self.fanout:
            merged = self.levels.pop(level)
            self._write(self._read(merged).repartition("h1", "h2"), level + 1)
            old += merged
            level += 1
        self._tell()
        for p in old:
            self._fs.delete(self._path(p), True)

    def lost(self, lines: DataFrame) -> DataFrame:
        """(doc_id, keys): for each document that loses lines, the 16-byte hashes of the keys that a smaller doc_id owns, joined."""
        lost = lines.join(self.all().hint("merge"), ["h1", "h2"]).where("owner < doc_id")
        bits = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))  # noqa: E731  8 bytes, big end first
        return lost.select("doc_id", F.concat(bits("h1"), bits("h2")).alias("key")).groupBy("doc_id").agg(F.array_join(F.transform(F.collect_list("key"), F.hex), "").alias("keys"))


def dropped_keys(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, folder: str | None = None) -> DataFrame:
    """(doc_id, keys): for each document that loses lines, the 16-byte hashes of the keys it loses, joined.

    A document loses a key that a smaller doc_id holds. Batches follow doc_id, so a key's owner is settled
    by the batch that brings it first. Texts are read once: the hashes of each batch are written apart.
    With a folder, runs of earlier jobs that it holds count too, and this job's runs stay there; doc_ids are
    then taken to grow from job to job.
    """
    spark = docs.sparkSession
    work = scratch(spark, "line-runs")
    edges = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(e) for e in edges})
    batch = sum((F.when(F.col("doc_id") > e, 1).otherwise(0) for e in edges), F.lit(0))
    line_hashes(docs).withColumn("batch", batch).write.partitionBy("batch").parquet(f"{work}/lines")
    lines = spark.read.schema("h1 long, h2 long, doc_id long, batch int").parquet(f"{work}/lines")
    runs = LineRuns(spark, folder or f"{work}/runs", fanout)
    for i in range(len(edges) + 1):
        runs.add(lines.where(F.col("batch") == i))
    return runs.lost(lines)


def split_kept(text: bytes, lost: set[bytes]) -> tuple[list[bytes], int]:
    """The lines of a text that stay, and how many it has."""
    lines = text.split(b"\n")
    if not lost:
        return lines, len(lines)
    digest, order = xxhash.xxh3_128_digest, np.dtype("<i8")
    kept = []
    for line, key in zip(lines, line_keys(text), strict=True):
        if key is None or np.frombuffer(digest(key), order).astype(">i8").tobytes() not in lost:
            kept.append(line)
    return kept, len(lines)


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, folder: str | None = None) -> DataFrame:
    """docs with `text` of the lines that stay (empty if none), `n_lines` before and `n_dropped`.

    Lines end at \\n; null or empty text is one empty line. A line's key is the line with ASCII white space
    stripped at both ends and A-Z lowered. Keys of at least LEAST_CHARS code points lose all their lines
    but in the smallest doc_id that holds them; repeats inside that document stay. Rows with a null doc_id
    keep all their lines and own none; rows that share a doc_id count as one document. Columns named
    n_lines, n_dropped or keys are replaced; others stay. folder: see dropped_keys.
    """
    spark = tuned(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped", "keys")
    lost = dropped_keys(docs, batches, fanout, folder)
    names = docs.columns
    schema = docs.schema.simpleString()[7:-1]
    at = names.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts, n, gone = [], [], []
            for text, keys in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                keys = bytes.fromhex(keys or "")
                kept, lines = split_kept((text or "").encode(), {keys[i : i + 16] for i in range(0, len(keys), 16)})
                texts.append(b"\n".join(kept).decode())
                n.append(lines)
                gone.append(lines - len(kept))
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    tuned(spark)
    return docs.join(lost.hint("shuffle_hash"), "doc_id", "left").select(*names, "keys").mapInArrow(lean(run), f"{schema}, n_lines long, n_dropped long")


def report(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays."""
    rows = dedup_lines(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batches, fanout)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


