"""What a run will cost, level by level, before anything is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.operators.tiling import Grid, grids


@dataclass(frozen=True)
class Profile:
    """Chunk geometry and kernel sizes, in voxels, that all levels share."""

    core: int = 256
    halo: int = 48
    inner: int = 64
    lattice: int = 2
    channels: int = 16
    kernel: int = 7
    sigma: float = 1.0
    scale: int = 2
    reach: int = 24

    def clamp_voxels(self) -> float:
        """The longest displacement that the halo leaves room for."""
        return self.halo - self.scale * ((self.kernel - 1) / 2 + 3 * self.sigma) - self.reach

    def bytes_needed(self, per_voxel_channel: float = 90.0) -> float:
        """Memory of one padded chunk with all its channels."""
        return (self.core + 2 * self.halo) ** 3 * self.channels * per_voxel_channel


def plan(spark: SparkSession, grid: Grid, profile: Profile, subjects: int, caps: tuple[int, ...], rate: float = 1.5e6, per_task: int = 1) -> DataFrame:
    """(level, chunks, passes, work, tasks, gpu_hours, share) for each level; work in channel-voxels.

    caps: passes from the coarsest level on; the last value repeats.
    """
    p = profile
    g = grids(spark, grid, p.core)
    top = g.agg(F.max("level").alias("top"))
    count = lambda n: F.ceil(F.col(n) / p.core)
    passes = F.element_at(F.array(*map(F.lit, caps)), F.least(F.col("top") - F.col("level") + 1, F.lit(len(caps))))
    chunks = count("nz") * count("ny") * count("nx")
    over = F.when(chunks == 1, 1.0).otherwise(((p.core + 2 * p.halo) / p.core) ** 3)
    g = g.crossJoin(F.broadcast(top)).select("level", chunks.cast("long").alias("chunks"), passes.cast("long").alias("passes"), F.col("nz").cast("double").alias("_z"), "ny", "nx", over.alias("_o"))
    g = g.select("level", "chunks", "passes", (F.col("_z") * F.col("ny") * F.col("nx") * F.col("_o") * p.channels * F.col("passes") * subjects).alias("work"), F.ceil(F.col("chunks") * subjects / per_task).cast("long").alias("tasks"))
    total = g.agg(F.sum("work").alias("all"))
    return g.crossJoin(F.broadcast(total)).select("level", "chunks", "passes", "work", "tasks", (F.col("work") / rate / 3600).alias("gpu_hours"), (F.col("work") / F.col("all")).alias("share"))


def hours(levels: DataFrame, seconds_tissue: float, seconds_empty: float, workers: int) -> DataFrame:
    """Adds `hours` to levels (chunks, tissue_chunks, passes): chunks with and without tissue cost differently."""
    seconds = F.col("passes") * (F.col("tissue_chunks") * seconds_tissue + (F.col("chunks") - F.col("tissue_chunks")) * seconds_empty)
    return levels.withColumn("hours", seconds / 3600 / workers)


def dominant(levels: DataFrame) -> DataFrame:
    """(level) of the most work."""
    return levels.agg(F.max_by("level", "work").alias("level"))


def pick_dataset(levels: DataFrame, datasets: DataFrame) -> DataFrame:
    """For each level (level, um) the largest dataset (path, voxel_um) no coarser than it, else the finest: an as-of choice."""
    d = datasets.agg(F.array_sort(F.collect_list(F.struct("voxel_um", "path"))).alias("all"))  # a pyramid's few levels
    fit = F.filter("all", lambda s: s["voxel_um"] <= F.col("um") * (1 + 1e-6))
    best = F.when(F.size(fit) > 0, F.element_at(fit, -1)).otherwise(F.element_at("all", 1))
    return levels.crossJoin(F.broadcast(d)).select("level", "um", best["path"].alias("path"), best["voxel_um"].alias("voxel_um"))


def pending(tasks: DataFrame, done: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Tasks that no completed record names."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")
