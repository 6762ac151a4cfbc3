"""The coarse-to-fine loop: register, blend, update, stop, promote, as Python over DataFrames.

Volumes, fields and templates are voxel rows; each pass writes its results to the shared folder, so lineage does not
grow with the passes and a run goes on from its last finished pass.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.engines import arrays as A
from voxframe.engines.demons import Stage, engine
from voxframe.engines.features import extractor
from voxframe.functions.scalar import AXES, VECTOR, magnitude
from voxframe.operators import blending, gather, pooling, stats, stencil, tiling
from voxframe.operators.tiling import Grid
from voxframe.plans.config import Run
from voxframe.session import ship


def shared(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; one of this machine only where that is unset and nothing runs elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="voxframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Store:
    """Named tables of a run in a folder; a table exists once its success marker does."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        return self.fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS"))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def remove(self, name: str) -> None:
        self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)


@dataclass
class Report:
    """What a pass measured and why its level stopped, if it did."""

    level: int
    iteration: int
    d99_mm: float
    step_mm: float
    fold_frac: float
    entries: int
    skipped: int
    seeded_folds: int
    retries: int
    reason: str | None = None


def _laddered(stages: tuple[Stage, ...], step: str) -> tuple[list[Stage], float]:
    """The stages for one rung of the retry ladder, and the factor on the clamp. Rungs do not add up."""
    if step == "smoother":
        return [replace(s, sigma_field=2 * s.sigma_field) for s in stages], 1.0
    return list(stages), 0.5 if step == "shorter" else 1.0


def solve_chunk(template: np.ndarray, subject: np.ndarray, seed: np.ndarray, core: tuple[slice, ...], run: Run, spacing: float, most: float, stages: tuple[Stage, ...], depth: int, iteration: int) -> tuple[np.ndarray, dict]:
    """One chunk: (total displacement, record). Without tissue, or with folds on every rung, the seed is given back."""
    s = run.solver
    record = {"reason": "", "tissue_fraction": A.tissue_fraction(template), "folds": 0.0, "retries": 0, "d99": float("nan")}
    if record["tissue_fraction"] < s.min_tissue:
        return seed, record | {"reason": "tissue"}
    features = extractor(s.features, 0, depth, iteration)
    fixed, moving = features(template), features(A.warp(subject, seed, spacing))
    solver = engine(s.engine)
    total = seed
    for k, rung in enumerate(s.ladder):
        record["retries"] = k
        if rung == "seed":
            return seed, record | {"reason": "folds", "folds": A.fold_fraction(seed[(slice(None), *core)], spacing)}
        rungs, short = _laddered(stages, rung)
        residual = A.clamp(solver.solve(fixed, moving, spacing, rungs).u, most * short)
        total = A.compose(residual, seed, spacing)
        record["folds"] = A.fold_fraction(total[(slice(None), *core)], spacing)
        record["sizes"] = np.sqrt((residual * residual).sum(0)).ravel()
        if record["folds"] <= s.max_folds:
            break
    return total, record


def register(template: DataFrame, subjects: DataFrame, seeds: DataFrame, grid: Grid, run: Run, depth: int, iteration: int, coarsest: bool) -> DataFrame:
    """Solves every (subject, chunk): rows of kind 'u' (voxels of a padded chunk) and 'r' (a record with a histogram).

    The three inputs are dealt to chunks by arithmetic on their keys, then one group each is solved on arrays; a group
    is one padded chunk, whatever the volume's size.
    """
    core, halo = run.tiling.core, run.tiling.halo
    shape, spacing = grid.shape, grid.spacing
    n = [-(-s // core) for s in shape]
    single = n == [1, 1, 1]
    most = run.coarsest_frac * min(shape) * spacing if single else run.clamp_voxels() * spacing
    stages = run.solver.coarsest if coarsest else run.solver.stages
    ids = subjects.select("subject").distinct()
    parts = (template.crossJoin(F.broadcast(ids)).select("subject", *AXES, F.col("v").alias("t"), *[F.lit(None).cast("double").alias(c) for c in ("m", *VECTOR)])
             .unionByName(subjects.select("subject", *AXES, F.lit(None).cast("double").alias("t"), F.col("v").alias("m"), *[F.lit(None).cast("double").alias(c) for c in VECTOR]))
             .unionByName(seeds.select("subject", *AXES, F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("m"), *VECTOR)))
    dealt = tiling.halo_expand(parts, shape, core, halo)
    ship(subjects.sparkSession)
    names = ["kind", "subject", "chunk_id", "iz", "iy", "ix", *AXES, *VECTOR, "reason", "tissue_fraction", "folds", "retries", "hist"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows.iloc[0]
        index = [int(at["i" + a]) for a in AXES]
        low = [max(0, i * core - halo) for i in index]
        high = [min(s, (i + 1) * core + halo) for i, s in zip(index, shape, strict=True)]
        size = tuple(b - a for a, b in zip(low, high, strict=True))
        place = tuple(rows[a].to_numpy() - o for a, o in zip(AXES, low, strict=True))

        def grid_of(column: str) -> np.ndarray:
            out, some = np.zeros(size), rows[column].notna().to_numpy()
            out[tuple(p[some] for p in place)] = rows[column].to_numpy()[some]
            return out

        inner = tuple(slice(i * core - o, min(s, (i + 1) * core) - o) for i, o, s in zip(index, low, shape, strict=True))
        seed = np.stack([grid_of(c) for c in VECTOR])
        u, record = solve_chunk(grid_of("t"), grid_of("m"), seed, inner, run, spacing, most, stages, depth, iteration)
        where = np.indices(size).reshape(3, -1)
        count = where.shape[1]
        base = {"subject": at["subject"], "chunk_id": at["chunk_id"], **{"i" + a: i for a, i in zip(AXES, index, strict=True)}}
        out = pd.DataFrame({"kind": ["u"] * count, **{k: [v] * count for k, v in base.items()}, **{a: where[d] + low[d] for d, a in enumerate(AXES)}, **{c: u[d].ravel() for d, c in enumerate(VECTOR)}, "reason": [None] * count, "hist": [None] * count})
        hist = np.zeros(256, np.int64)
        if "sizes" in record and record["reason"] != "folds":
            v = record["sizes"]
            bins = np.where(v < 1e-6, 0, np.minimum(255, 1 + np.floor((np.log10(np.maximum(v, 1e-12)) + 6) * 254 / 9))).astype(int)
            hist += np.bincount(bins, minlength=256)
        mark = pd.DataFrame([{"kind": "r", **base, "reason": record["reason"], "tissue_fraction": record["tissue_fraction"], "folds": record["folds"], "retries": record["retries"], "hist": hist.tolist()}])
        return pd.concat([out, mark], ignore_index=True).reindex(columns=names).astype({"retries": "Int64", **{a: "Int64" for a in AXES}})

    schema = "kind string, subject int, chunk_id int, iz int, iy int, ix int, z int, y int, x int, uz double, uy double, ux double, reason string, tissue_fraction double, folds double, retries long, hist array<long>"
    return dealt.groupBy("subject", "chunk_id").applyInPandas(one, schema)


def _stop(reports: list[Report], run: Run, level: int, coarsest: int, spacing: float, last: bool, next_most: float) -> str | None:
    r, s = reports[-1], run.stopping
    threshold = 0.0 if last else s.residual_frac * next_most
    fits = threshold > 0 and r.d99_mm < threshold
    value = "d99_mm" if run.template is not None else "step_mm"
    flat = False
    if s.plateau_passes and len(reports) > s.plateau_passes:
        old, new = getattr(reports[-1 - s.plateau_passes], value), getattr(r, value)
        flat = old - new < s.plateau_rel * old
    if run.template is not None:
        if r.entries > r.skipped and r.seeded_folds == r.entries - r.skipped:
            return "folds"
        if r.d99_mm < s.residual_vox * spacing:
            return "residual"
    else:
        converged = r.step_mm / max(run.eps, 1e-9) < s.ubar_vox * spacing
        if converged and (last or fits):
            return "converged"
    if flat:
        return "plateau"
    return "cap" if r.iteration + 1 >= run.cap(level, coarsest) else None


@dataclass
class Built:
    """A finished run: the template and all fields at the last level, and what each pass reported."""

    template: DataFrame
    fields: DataFrame
    grid: Grid
    reports: list[Report]


def build_template(subjects: DataFrame, shape: tuple[int, int, int], run: Run, root: str | None = None, say: Callable[[str], None] = lambda text: None) -> Built:
    """Estimates a template and one field a subject (subject, z, y, x, v); run.template holds one subject's image instead.

    Missing voxels count as 0. With a root, finished passes are taken from there, so a run can go on after a stop.
    """
    spark = subjects.sparkSession
    run = run.checked()
    store = Store(spark, root or shared(spark, "run"))
    top = tiling.depth(shape, run.tiling.core)
    native = Grid(shape, run.spacing)
    volumes = store.write("volumes", pooling.pyramid(subjects, top, keys=("subject",))) if not store.has("volumes") else store.read("volumes")
    moving = volumes if run.template is None else volumes.where(F.col("subject") != run.template)
    count = moving.select("subject").distinct().count()
    reports: list[Report] = []
    template = fields = motion = None
    grid = native
    for level in range(top, run.stop_at - 1, -1):
        before, grid = grid, native.coarsened(2**level) if level else native
        images = moving.where(F.col("level") == level).drop("level")
        held = volumes.where((F.col("level") == level) & (F.col("subject") == run.template)).select(*AXES, "v") if run.template is not None else None
        name = f"level={level}"
        ids = images.select("subject").distinct()
        empty = gather.dense(spark, grid.shape)
        if fields is None:
            template = held if held is not None else blending.mean_template(empty.crossJoin(F.broadcast(ids)).join(images, ["subject", *AXES], "left").select("subject", *AXES, F.coalesce("v", F.lit(0.0)).alias("v")))
            fields = empty.crossJoin(F.broadcast(ids)).select("subject", *AXES, *[F.lit(0.0).alias(u) for u in VECTOR])
        else:
            template = held if held is not None else gather.resample(template, before, grid)
            fields = _promoted(fields if motion is None else blending.settled(fields, motion, before.shape, before.spacing, ("subject",)), before, grid, ids)
            motion = None
        if not store.has(f"{name}/seed_fields"):
            store.write(f"{name}/seed_template", template)
            store.write(f"{name}/seed_fields", fields)
        template, fields = store.read(f"{name}/seed_template"), store.read(f"{name}/seed_fields")
        own: list[Report] = []
        for iteration in range(run.cap(level, top)):
            here = f"{name}/pass={iteration}"
            if not store.has(f"{here}/report"):
                _pass(store, here, template, images, fields, motion, held, grid, run, level, iteration, level == top, count)
            template, fields = store.read(f"{here}/template"), store.read(f"{here}/fields")
            motion = store.read(f"{here}/motion") if held is None else None
            report = Report(**json.loads(store.read(f"{here}/report").first()[0]))
            own.append(report)
            reports.append(report)
            clamp = run.clamp_voxels() * grid.spacing / 2
            report.reason = _stop(own, run, level, top, grid.spacing, level == run.stop_at, clamp)
            say(f"level {level} pass {iteration}: d99 {report.d99_mm:.4g} mm, step {report.step_mm:.4g} mm, folds {report.fold_frac:.2g} {report.reason or ''}")
            if report.reason:
                break
    if motion is not None:
        fields = store.write("settled", blending.settled(fields, motion, grid.shape, grid.spacing, ("subject",)))
    return Built(template, fields, grid, reports)


def _promoted(fields: DataFrame, source: Grid, target: Grid, ids: DataFrame) -> DataFrame:
    places = gather.dense(fields.sparkSession, target.shape).crossJoin(F.broadcast(ids))
    places = places.withColumns({p: (F.col(a) * target.spacing + t - s) / source.spacing for p, a, s, t in zip(gather.PLACES, AXES, source.origin, target.origin, strict=True)})
    return gather.sample(places, fields, source.shape, VECTOR, "nearest", keys=("subject",)).select("subject", *AXES, *VECTOR)


def _pass(store: Store, here: str, template: DataFrame, images: DataFrame, fields: DataFrame, motion: DataFrame | None, held: DataFrame | None, grid: Grid, run: Run, level: int, iteration: int, coarsest: bool, count: int) -> None:
    """One pass: its tables are written one after the other, the report last."""
    shape, spacing = grid.shape, grid.spacing
    seeds = fields if motion is None else blending.settled(fields, motion, shape, spacing, ("subject",))
    solved = store.write(f"{here}/solved", register(template, images, seeds, grid, run, level, iteration, coarsest))
    parts = solved.where("kind = 'u'").select("subject", "iz", "iy", "ix", *AXES, *VECTOR)
    blended = blending.blend(parts, shape, run.tiling.core, run.tiling.halo, keys=("subject",), sigma=0.5 * run.tiling.lattice)
    new = store.write(f"{here}/fields", blended)
    records = solved.where("kind = 'r'")
    step = 0.0
    if held is None:
        warped = gather.warp(images, new, shape, spacing, keys=("subject",), image_keys=("subject",))
        sums = store.write(f"{here}/sums", blending.accumulate(warped, new))
        sharpen = run.sharpen if coarsest else 0.0
        image, move = blending.update(sums, shape, spacing, count, run.eps, sharpen)
        store.write(f"{here}/template", image)
        moved = store.write(f"{here}/motion", move)
        h = stats.percentile(stats.histogram(moved, magnitude(*VECTOR)), run.stopping.quantile).first()
        step = h["value"] if h else 0.0
    else:
        store.write(f"{here}/template", template)
    hist = records.select(F.posexplode("hist").alias("bin", "n")).where("n > 0").groupBy("bin").agg(F.sum("n").alias("n"))
    d = stats.percentile(hist, run.stopping.quantile).first()
    folds = stencil.folds(stencil.jacobian(new, spacing, ("subject",)), ("subject",)).agg(F.max("folds")).first()[0]
    r = records.agg(F.count(F.lit(1)), F.count_if(F.col("reason") == "tissue"), F.count_if(F.col("reason") == "folds"), F.sum("retries")).first()
    report = Report(level, iteration, d["value"] if d else 0.0, step, folds or 0.0, r[0], r[1], r[2], r[3] or 0)
    store.write(f"{here}/report", store.spark.createDataFrame([(json.dumps(asdict(report)),)], "report string"))


def register_pair(fixed: DataFrame, moving: DataFrame, shape: tuple[int, int, int], run: Run, root: str | None = None, say: Callable[[str], None] = lambda text: None) -> Built:
    """The field that brings moving onto fixed (z, y, x, v each): a run whose template is held. Subject 1 is moving."""
    both = fixed.select(F.lit(0).alias("subject"), *AXES, "v").unionByName(moving.select(F.lit(1).alias("subject"), *AXES, "v"))
    return build_template(both, shape, replace(run, template=0), root, say)


def apply_field(volume: DataFrame, field: DataFrame, grid: Grid, target: Grid | None = None) -> DataFrame:
    """A volume warped by a field on the same grid, then read on another grid if one is given."""
    warped = gather.warp(volume, field, grid.shape, grid.spacing)
    return warped if target is None or target.same(grid) else gather.resample(warped, grid, target)


def status(store: Store, levels: int, caps: Callable[[int], int]) -> list[tuple[int, int]]:
    """(level, finished passes) of a run's folder."""
    return [(level, sum(store.has(f"level={level}/pass={i}/report") for i in range(caps(level)))) for level in range(levels, -1, -1)]


def clean(store: Store, level: int, keep: int, passes: int) -> None:
    """Removes the solved chunks and sums of a level's passes but the last `keep`."""
    for i in range(max(0, passes - keep)):
        for what in ("solved", "sums"):
            store.remove(f"level={level}/pass={i}/{what}")


def radius(halo: int, margin: int, core: int) -> int:
    """How many chunks away a core's blend still reads."""
    return math.ceil((halo + margin) / core)
