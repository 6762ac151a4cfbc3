"""Stores: volumes, fields and task results as tables of blocks below a folder, own, linked or read through an affine map.

A store's metadata is a JSON file beside its levels. A level is a DataFrame however it is kept: blocks of this store
(Parquet), another store's level read in place, a volume file or Zarr image, or a lazy view through an affine map.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES, VECTOR
from voxframe.operators import gather, pooling, stats
from voxframe.operators.tiling import Grid, depth
from voxframe.plans import frames
from voxframe.sources.volumes import BLOCK as BLOCK_ROW
from voxframe.sources.volumes import read_source, to_blocks, to_voxels

#: Voxels of a stored block along an axis.
EDGE = 64
META = "store.json"
KINDS = {"volume": ("v",), "field": VECTOR}


class Files:
    """Small files of a store, by Hadoop's file systems: any path that Spark reads works."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, path: str) -> bool:
        return self.fs.exists(self.path_of(path))

    def put(self, path: str, text: str) -> None:
        out = self.fs.create(self.path_of(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def remove(self, path: str) -> None:
        self.fs.delete(self.path_of(path), True)


class Memory:
    """Levels kept as temporary views of the session instead of files, for tests and small runs."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.views = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        view = "level_" + "".join(c if c.isalnum() else "_" for c in name)
        df.createOrReplaceTempView(view)
        self.views[name] = view
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self.views[name])

    def has(self, name: str) -> bool:
        return name in self.views

    def remove(self, name: str) -> None:
        self.spark.catalog.dropTempView(self.views.pop(name))


class Store:
    """A pyramid of levels (z, y, x, values) on grids that halve, and what is known about them."""

    def __init__(self, spark: SparkSession, root: str, meta: dict) -> None:
        self.spark, self.root, self.meta = spark, root.rstrip("/"), meta
        self.files = Files(spark, root)
        self._open: dict[int, DataFrame] = {}

    # --- making and opening

    @classmethod
    def create(cls, spark: SparkSession, root: str, grid: Grid, kind: str = "volume", core: int = 256, overwrite: bool = False, **more: object) -> Store:
        """An empty store; one that is there is kept unless overwrite, and a folder that is no store is never touched."""
        files = Files(spark, root)
        if files.has(root) and not cls.exists(spark, root) and files.fs.listStatus(files.path_of(root)):
            raise ValueError(f"{root} holds something that is no store")
        if cls.exists(spark, root):
            if not overwrite:
                raise ValueError(f"{root} is there already")
            files.remove(root)
        out = cls(spark, root, {"kind": kind, "shape": list(grid.shape), "spacing": grid.spacing, "origin": list(grid.origin), "core": core, "levels": {}, **more})
        out.save()
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        if not cls.exists(spark, root):
            raise ValueError(f"{root} is no store")
        return cls(spark, root, json.loads(spark.read.text(f"{root.rstrip('/')}/{META}", wholetext=True).first()[0]))

    @classmethod
    def exists(cls, spark: SparkSession, root: str) -> bool:
        """Whether a folder is a store of this kind."""
        return Files(spark, root).has(f"{root.rstrip('/')}/{META}")

    def save(self) -> None:
        self.files.put(f"{self.root}/{META}", json.dumps(self.meta))

    # --- grids

    @property
    def grid(self) -> Grid:
        return Grid(tuple(self.meta["shape"]), self.meta["spacing"], tuple(self.meta["origin"]))

    def level_grid(self, level: int) -> Grid:
        return self.grid.coarsened(2**level) if level else self.grid

    @property
    def values(self) -> tuple[str, ...]:
        return KINDS[self.meta["kind"]]

    # --- reading

    def level(self, level: int) -> DataFrame:
        """(z, y, x, values) of a level, wherever it is kept; opened once."""
        if level not in self._open:
            told = self.meta["levels"].get(str(level))
            if told is None and "affine" not in self.meta:
                raise KeyError(f"{self.root} has no level {level}")
            how = told["how"] if told else "affine"
            self._open[level] = {"own": self._own, "linked": self._linked, "affine": self._affine}[how](level, told or {})
        return self._open[level]

    def _own(self, level: int, told: dict, where: F.Column | None = None) -> DataFrame:
        parts = None
        for i, v in enumerate(self.values):
            blocks = self.spark.read.schema(BLOCK_ROW + ", part int").parquet(f"{self.root}/level={level}").where(F.col("part") == i)
            one = to_voxels(blocks if where is None else blocks.where(where)).select(*AXES, F.col("v").alias(v))
            parts = one if parts is None else parts.join(one, list(AXES))
        return parts

    def _linked(self, level: int, told: dict) -> DataFrame:
        if told.get("store"):
            return Store.open(self.spark, told["store"]).level(told["level"])
        return read_source(self.spark, told["path"], told.get("dataset"))

    def _affine(self, level: int, told: dict) -> DataFrame:
        """The coarsest dataset that is no coarser than the level, its background replaced, through the map; 0 outside."""
        spec, grid = self.meta["affine"], self.level_grid(level)
        fit = [d for d in spec["datasets"] if d["scale_um"][0] <= grid.spacing * 1000 * (1 + 1e-6)]
        d = max(fit, key=lambda d: d["scale_um"][0]) if fit else min(spec["datasets"], key=lambda d: d["scale_um"][0])
        source = self._source(spec, d)
        if spec["background"]:
            limit, value = spec["background"]
            source = source.withColumn("v", F.when(F.col("v") >= limit, F.lit(float(value))).otherwise(F.col("v").cast("double")))
        matrix = frames.voxel_matrix(grid, spec["world_to_source_um"], d["scale_um"], d["shift_um"])
        low, high = _reach(matrix, grid.shape, d["shape"])
        return gather.affine(source.where(frames.in_box(low, high)), tuple(d["shape"]), matrix.tolist(), grid.shape)

    def _source(self, spec: dict, d: dict) -> DataFrame:
        if Store.exists(self.spark, spec["source"]):
            return Store.open(self.spark, spec["source"]).level(int(d["path"]))
        return read_source(self.spark, spec["source"], d["path"])

    def read_box(self, level: int, low: Sequence[int], high: Sequence[int]) -> DataFrame:
        """The voxels of [low, high); of own levels only the blocks that it meets are read."""
        box = frames.in_box(low, high)
        told = self.meta["levels"].get(str(level), {})
        if told.get("how") != "own":
            return self.level(level).where(box)
        meets = F.lit(True)
        for a, b, h in zip(AXES, low, high, strict=True):
            meets = meets & F.col("b" + a).between(max(0, int(b)) // EDGE, max(0, int(h) - 1) // EDGE)
        return self._own(level, told, meets).where(box)

    # --- writing

    def write_level(self, level: int, voxels: DataFrame) -> None:
        """Writes a level (z, y, x, values) as blocks, one table a store's level; what is there is replaced."""
        if self.meta["levels"].get(str(level), {}).get("how") == "linked":
            raise ValueError("linked levels are read only")
        path = f"{self.root}/level={level}"
        for i, v in enumerate(self.values):
            rows = voxels.select(F.lit(0).alias("subject"), F.lit(level).alias("level"), *AXES, F.col(v).cast("double").alias("v"))
            to_blocks(rows, EDGE).withColumn("part", F.lit(i)).write.mode("overwrite" if i == 0 else "append").option("compression", "zstd").parquet(path)
        self._done(level, {"how": "own"})

    def write_lattice(self, level: int, origin: Sequence[int], block: np.ndarray) -> None:
        """Adds one block (values, z, y, x) at a lattice position; it must start on a block and be no larger than one."""
        if any(o % EDGE for o in origin) or max(block.shape[1:]) > EDGE:
            raise ValueError("a block starts on the lattice of blocks")
        rows = [(0, level, *[int(o) // EDGE for o in origin], [int(o) for o in origin], list(block.shape[1:]), bytearray(np.ascontiguousarray(b, "<f8").tobytes()), i) for i, b in enumerate(block)]
        self.spark.createDataFrame(rows, BLOCK_ROW + ", part int").write.mode("append").option("compression", "zstd").parquet(f"{self.root}/level={level}")
        self._done(level, {"how": "own"})

    def _done(self, level: int, told: dict) -> None:
        self.meta["levels"][str(level)] = told
        self._open.pop(level, None)
        self.save()

    def build(self, first: int = 1) -> None:
        """Writes every coarser level from the one below it."""
        for level in range(first, depth(self.grid.shape, self.meta["core"]) + 1):
            below = self.level_grid(level - 1).shape
            self.write_level(level, pooling.pool(self.level(level - 1), 2, self.values, shape=below))

    def window(self, level: int, low: float = 0.5, high: float = 99.5) -> tuple[float, float]:
        """The intensity window of a level."""
        r = stats.intensity_window(self.level(level), "v", low, high).first()
        return r["low"], r["high"]


def _reach(matrix: np.ndarray, shape: Sequence[int], source: Sequence[int]) -> tuple[list[int], list[int]]:
    """What of a source a whole grid reads through a matrix."""
    ends = np.array([[0, n - 1] for n in shape], float)
    terms = matrix[:, :3, None] * ends[None]
    low = np.floor(terms.min(2).sum(1) + matrix[:, 3]) - 1
    high = np.ceil(terms.max(2).sum(1) + matrix[:, 3]) + 2
    return np.clip(low, 0, source).astype(int).tolist(), np.clip(high, 0, source).astype(int).tolist()


def link_source(spark: SparkSession, root: str, source: str, grid: Grid, dataset: str | None = None, core: int = 256, overwrite: bool = False) -> Store:
    """A store whose finest level is another store's, or a file's, read in place; coarser levels are built here."""
    out = Store.create(spark, root, grid, "volume", core, overwrite)
    own = Store.exists(spark, source)
    out._done(0, {"how": "linked", **({"store": source, "level": int(dataset or 0)} if own else {"path": source, "dataset": dataset})})
    out.build()
    return out


def link_pyramid(spark: SparkSession, root: str, source: str, grid: Grid, datasets: dict[int, str], core: int = 256, overwrite: bool = False) -> Store:
    """A store whose levels are an image's datasets, read in place; the levels it lacks are built from those below."""
    out = Store.create(spark, root, grid, "volume", core, overwrite)
    for level, path in sorted(datasets.items()):
        own = Store.exists(spark, source)
        out._done(level, {"how": "linked", **({"store": source, "level": int(path)} if own else {"path": source, "dataset": path})})
    for level in range(depth(grid.shape, core) + 1):
        if str(level) not in out.meta["levels"]:
            out.write_level(level, pooling.pool(out.level(level - 1), 2, shape=out.level_grid(level - 1).shape))
    return out


def link_affine(spark: SparkSession, root: str, spec: dict, grid: Grid, core: int = 256, overwrite: bool = False) -> Store:
    """A store of metadata alone: each level is read from the source through the spec's map when it is asked for."""
    return Store.create(spark, root, grid, "volume", core, overwrite, affine=spec)


def ingest(spark: SparkSession, root: str, voxels: DataFrame, grid: Grid, dtype: str = "auto", source_type: str = "f4", core: int = 256, overwrite: bool = False, say: Callable[[str], None] = lambda text: None) -> Store:
    """A store of voxels (z, y, x, v): level 0 as it is (rounded and clipped for integer types), then the pyramid."""
    kind = frames.stored_type(dtype, source_type)
    out = Store.create(spark, root, grid, "volume", core, overwrite, dtype=kind.name)
    if kind.kind in "iu":
        info = np.iinfo(kind)
        voxels = voxels.withColumn("v", F.least(F.greatest(F.rint("v"), F.lit(float(info.min))), F.lit(float(info.max))))
    out.write_level(0, voxels)
    out.build()
    say(f"{root}: {len(out.meta['levels'])} levels of {kind.name}")
    return out
