"""Queries of stores, frames, layouts and colours, and their SQL; registered beside those of the volume operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES, VECTOR
from voxframe.operators import gather, pooling, stats, tiling
from voxframe.operators.tiling import Grid
from voxframe.plans import colours, frames
from voxframe.plans.groupwise import shared
from voxframe.plans.queries import _MATRIX, _MEET, CHUNKS, COHORT, CORE, FIELDS, HALO, VOL, _chunks, _field_sql, _gather_sql, query, rounded
from voxframe.sources import stores
from voxframe.sources import tables as T
from voxframe.sources.tables import SPACING


def _grid(spark: SparkSession, sf: str) -> Grid:
    return Grid(T.shape(spark, sf), SPACING)


# --- stores -----------------------------------------------------------------------------------------------------


@query(f"WITH {VOL} SELECT z, y, x, v FROM vol")
def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A volume written to a store as blocks and read back from it."""
    store = stores.Store.create(spark, shared(spark, "store"), _grid(spark, sf), core=CORE)
    store.write_level(0, T.volume(spark, sf))
    return stores.Store.open(spark, store.root).level(0)


@query(f"WITH {VOL} SELECT z, y, x, v FROM vol, dims WHERE z >= nz - 9 AND z < nz - 1 AND y >= 3 AND y < 18 AND x >= 7 AND x < 25")
def store_box(spark: SparkSession, sf: str) -> DataFrame:
    """A box of a stored level: only the blocks that it meets are read."""
    grid = _grid(spark, sf)
    store = stores.Store.create(spark, shared(spark, "store"), grid, core=CORE)
    store.write_level(0, T.volume(spark, sf))
    return store.read_box(0, (grid.shape[0] - 9, 3, 7), (grid.shape[0] - 1, 18, 30))


@query(f"""WITH {VOL}, {FIELDS}, {_field_sql(1)} SELECT z, y, x, uz, uy, ux FROM f1 WHERE z < 6 AND y >= 4 AND x < 9""")
def field_box(spark: SparkSession, sf: str) -> DataFrame:
    """A box of a stored field, its three components each in blocks of their own."""
    store = stores.Store.create(spark, shared(spark, "store"), _grid(spark, sf), "field", CORE)
    store.write_level(0, T.field(spark, sf))
    return store.read_box(0, (0, 4, 0), (6, 20, 9))


_L1 = "l1 AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(v) AS v FROM vol GROUP BY ALL)"


@query(f"WITH {VOL}, {_L1} SELECT 0 AS level, z, y, x, v FROM vol UNION ALL SELECT 1, z, y, x, round(v, 6) FROM l1")
def linked_store(spark: SparkSession, sf: str) -> DataFrame:
    """A store linked to another one: its finest level is read in place, the next one is its own."""
    grid = _grid(spark, sf)
    source = stores.Store.create(spark, shared(spark, "store"), grid, core=CORE)
    source.write_level(0, T.volume(spark, sf))
    linked = stores.link_source(spark, shared(spark, "store"), source.root, grid, core=CORE)
    out = None
    for level in (0, 1):
        one = rounded(linked.level(level), "v").select(F.lit(level).alias("level"), *AXES, "v")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {VOL}, {_L1}, l2 AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(v) AS v FROM l1 GROUP BY ALL) SELECT 2 AS level, count(*) AS voxels, round(sum(v), 3) AS total FROM l2 UNION ALL SELECT 1, count(*), round(sum(v), 3) FROM l1")
def linked_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    """A pyramid of which two levels are read in place and the next one is built."""
    grid = _grid(spark, sf)
    source = stores.Store.create(spark, shared(spark, "store"), grid, core=CORE)
    source.write_level(0, T.volume(spark, sf))
    source.write_level(1, pooling.pool(T.volume(spark, sf), 2))
    linked = stores.link_pyramid(spark, shared(spark, "store"), source.root, grid, {0: "0", 1: "1"}, core=CORE)
    out = None
    for level in (1, 2):
        one = linked.level(level).groupBy(F.lit(level).alias("level")).agg(F.count(F.lit(1)).alias("voxels"), F.sum("v").alias("total"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "total", digits=3)


@query(f"""WITH {VOL}, dark AS (SELECT z, y, x, CASE WHEN v >= 250000 THEN 0 ELSE v END AS v FROM vol),
p AS (SELECT z, y, x, CAST(0.9 AS DOUBLE) * z + CAST(0.1 AS DOUBLE) * y + 1.5 AS cz, CAST(-0.1 AS DOUBLE) * z + CAST(0.9 AS DOUBLE) * y + 2.25 AS cy, CAST(0.05 AS DOUBLE) * y + CAST(1.1 AS DOUBLE) * x - 1.0 AS cx FROM vol)
SELECT z, y, x, round(v, 1) AS v FROM ({_gather_sql('p', 'dark', 'z, y, x', ('v',), 'constant')})""")
def affine_store(spark: SparkSession, sf: str) -> DataFrame:
    """A store of metadata alone: its level is read through a map from another store, whose bright background counts as 0."""
    grid = _grid(spark, sf)
    source = stores.Store.create(spark, shared(spark, "store"), grid, core=CORE)
    source.write_level(0, T.volume(spark, sf))
    um = SPACING * 1000
    to_source = frames.scaling([um] * 3, (0.0, 0.0, 0.0)) @ frames.square(_MATRIX) @ frames.scaling([1 / SPACING] * 3, (0.0, 0.0, 0.0))
    spec = frames.affine_spec(source.root, [{"path": "0", "shape": list(grid.shape), "scale_um": [um] * 3, "shift_um": [0.0] * 3}], to_source, (250000.0, 0.0))
    return rounded(stores.link_affine(spark, shared(spark, "store"), spec, grid, CORE).level(0), "v", digits=1)


# --- frames -----------------------------------------------------------------------------------------------------


def _corner_sql(row: list[float]) -> str:
    return " + ".join(f"CAST({k} AS DOUBLE) * (pad_{a}0 + c{a} * (pad_n{a} - 1))" for k, a in zip(row, AXES, strict=False)) + f" + {row[3]}"


@query(f"""WITH {VOL}, {CHUNKS}, corners AS (SELECT chunk_id, nz, ny, nx, {", ".join(f"{_corner_sql(r)} AS s{a}" for r, a in zip(_MATRIX, AXES, strict=True))}
FROM chunks, dims, (VALUES (0), (1)) a(cz), (VALUES (0), (1)) b(cy), (VALUES (0), (1)) c(cx))
SELECT chunk_id, {", ".join(f"CAST(least(greatest(floor(round(min(s{a}), 9)) - 1, 0), any_value(n{a})) AS INT) AS src_{a}0, CAST(least(greatest(ceil(round(max(s{a}), 9)) + 2, 0), any_value(n{a})) AS INT) AS src_{a}1" for a in AXES)} FROM corners GROUP BY chunk_id""")
def source_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """What of a source each padded box reads through an affine map."""
    boxes = frames.source_boxes(_chunks(spark, sf), _MATRIX, T.shape(spark, sf))
    return boxes.select("chunk_id", *[f"src_{a}{e}" for a in AXES for e in (0, 1)])


_SIG = "CASE WHEN {c} = 0 THEN 0 ELSE round_even({c} * pow(10, 6 - floor(log10(abs({c})))), 0) / pow(10, 6 - floor(log10(abs({c})))) END"


@query(f"""WITH s AS (SELECT p_partkey, p_retailprice / 3e4 AS z, p_retailprice / 3e4 * (1 + (p_size % 5) * 4e-4) AS y, p_retailprice / 3e4 * (1 + p_size % 3 * 1e-9) AS x FROM part),
r AS (SELECT p_partkey, {", ".join(f"{_SIG.format(c=a)} AS {a}" for a in AXES)} FROM s)
SELECT p_partkey, greatest(z, y, x) <= least(z, y, x) * (1 + 1e-3) AS iso, {", ".join(f"round(CASE WHEN greatest(z, y, x) <= least(z, y, x) * (1 + 1e-3) THEN (z + y + x) / 3 ELSE {a} END, 9) AS v{a}" for a in AXES)} FROM r""")
def canonical_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """Voxel sizes of scans without the noise of their headers, as one number where they agree."""
    size, base = F.col("p_size"), F.col("p_retailprice") / 3e4
    s = T.table(spark, sf, "part").select("p_partkey", base.alias("z"), (base * (1 + size % 5 * 4e-4)).alias("y"), (base * (1 + size % 3 * 1e-9)).alias("x"))
    return rounded(s.select("p_partkey", *frames.canonical("z", "y", "x")), "vz", "vy", "vx", digits=9)


@query(f"WITH {FIELDS} SELECT subject, CAST(ceil(max(greatest(abs(uz), abs(uy), abs(ux))) / 0.05) + 2 AS INT) AS margin FROM fields GROUP BY subject")
def required_margin(spark: SparkSession, sf: str) -> DataFrame:
    """How far beyond a box the warp of each subject reads."""
    return frames.margins(T.fields(spark, sf), SPACING, ("subject",))


@query(f"WITH {VOL} SELECT z, y, x, CAST(round_even(least(greatest((v - 1000) / CAST(299000 AS DOUBLE), 0), 1) * 65535, 0) AS INT) AS v FROM vol")
def scaled_16bit(spark: SparkSession, sf: str) -> DataFrame:
    """A volume through its window on the scale of 16-bit exports."""
    return T.volume(spark, sf).withColumn("v", frames.scaled_16bit("v", 1000.0, 300000.0))


@query(f"WITH {VOL} SELECT 'z' AS axis, count(*) AS voxels, round(sum(v), 3) AS total FROM vol, dims WHERE z >= nz // 2 AND z < nz // 2 + 2 UNION ALL SELECT 'y', count(*), round(sum(v), 3) FROM vol WHERE y = 4 UNION ALL SELECT 'x', count(*), round(sum(v), 3) FROM vol WHERE x >= 12 AND x < 15")
def plane_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Thin boxes across the three axes."""
    v, shape, out = T.volume(spark, sf), T.shape(spark, sf), None
    for a, at, thick in (("z", None, 2), ("y", 4, 1), ("x", None, 3)):
        one = v.where(frames.plane_box(shape, a, at, thick)).agg(F.count(F.lit(1)).alias("voxels"), F.sum("v").alias("total")).select(F.lit(a).alias("axis"), "voxels", "total")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "total", digits=3)


@query(f"""WITH s AS (SELECT p_partkey, 10 + p_size AS nz, 18 AS ny, 30 - p_size % 7 AS nx, CASE WHEN p_size % 3 = 0 THEN 0.05 ELSE 0.01 * (1 + p_size % 9) END AS vz, 0.05 AS vy, 0.05 * (1 + p_size % 2) AS vx, (p_size % 4) * 0.05 - 0.1 AS oz, 0.0 AS oy, 0.05 AS ox FROM part), {VOL}
SELECT p_partkey, abs(0.05 / vz - 1) <= 1e-3 AND abs(0.05 / vx - 1) <= 1e-3 AS copied,
concat_ws(',', CASE WHEN 0.05 / vz < 1 - 1e-3 THEN 'z' END, CASE WHEN 0.05 / vy < 1 - 1e-3 THEN 'y' END, CASE WHEN 0.05 / vx < 1 - 1e-3 THEN 'x' END) AS coarse,
concat_ws(',', {", ".join(f"CASE WHEN round(CAST(s.o{a} - v{a} / 2 AS DOUBLE), 9) < -0.05 OR round(CAST(s.o{a} + v{a} * (s.n{a} - 0.5) AS DOUBLE), 9) > round(CAST(0.05 * dims.n{a} AS DOUBLE), 9) THEN '{a}' END" for a in AXES)}) AS cropped FROM s, dims""")
def placement_notes(spark: SparkSession, sf: str) -> DataFrame:
    """How scans reach the run grid: copied, coarser than it, cut by it."""
    size = F.col("p_size")
    scans = T.table(spark, sf, "part").select("p_partkey", (10 + size).alias("nz"), F.lit(18).alias("ny"), (30 - size % 7).alias("nx"), F.when(size % 3 == 0, 0.05).otherwise(0.01 * (1 + size % 9)).alias("vz"), F.lit(0.05).alias("vy"), (0.05 * (1 + size % 2)).alias("vx"),
                                              ((size % 4) * 0.05 - 0.1).alias("oz"), F.lit(0.0).alias("oy"), F.lit(0.05).alias("ox"))
    return frames.placement_notes(scans, _grid(spark, sf)).select("p_partkey", "copied", "coarse", "cropped")


# --- levels and layouts -----------------------------------------------------------------------------------------

_LEVELS = f"""levels AS (SELECT CAST(l AS INT) AS level, CAST(0.05 * pow(2, l) AS DOUBLE) AS spacing_mm, CAST(ceil(nz / pow(2, l)) AS INT) AS nz, CAST(ceil(ny / pow(2, l)) AS INT) AS ny, CAST(ceil(nx / pow(2, l)) AS INT) AS nx FROM dims, (SELECT unnest(range(12)) AS l) WHERE l <= ceil(log2(greatest(nz, ny, nx) / {CORE}.0)))"""


@query(f"""WITH {VOL}, {_LEVELS}, asked AS (SELECT p_partkey, 0.05 * p_size * (1 + (p_partkey % 5) * 4e-4) AS spacing_mm FROM part)
SELECT a.p_partkey, l.level FROM asked a LEFT JOIN levels l ON abs(a.spacing_mm - l.spacing_mm) <= 1e-3 * greatest(a.spacing_mm, l.spacing_mm)""")
def find_level(spark: SparkSession, sf: str) -> DataFrame:
    """The level that a spacing names, within a tolerance: an equi-join on powers of two."""
    asked = T.table(spark, sf, "part").select("p_partkey", (0.05 * F.col("p_size") * (1 + F.col("p_partkey") % 5 * 4e-4)).alias("spacing_mm"))
    return frames.find_levels(asked, tiling.grids(spark, _grid(spark, sf), CORE)).select("p_partkey", "level")


@query(f"WITH {VOL}, {_LEVELS} SELECT level, CAST(ceil(nz / 3.0) * ceil(ny / 3.0) * ceil(nx / 3.0) AS BIGINT) AS lattice, ceil(nz / 3.0) * ceil(ny / 3.0) * ceil(nx / 3.0) <= 100 AS kept FROM levels")
def residual_maps_kept(spark: SparkSession, sf: str) -> DataFrame:
    """At which levels a residual map is small enough to be kept."""
    return frames.mapped_levels(spark, _grid(spark, sf), CORE, 3, 100)


@query(f"""WITH {VOL}, {_LEVELS} SELECT level, {", ".join(f"CAST(least(5, n{a}) AS INT) AS block_{a}, CAST(ceil(least(8, n{a}) / CAST(least(5, n{a}) AS DOUBLE)) * least(5, n{a}) AS INT) AS file_{a}" for a in AXES)} FROM levels""")
def block_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks and files of each level."""
    levels = frames.block_layout(tiling.grids(spark, _grid(spark, sf), CORE), 5, 8)
    return levels.select("level", *[f"{w}_{a}" for a in AXES for w in ("block", "file")])


@query("SELECT DISTINCT CAST(k AS INT) AS level FROM (SELECT o_custkey % 9 AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT p_size % 7 AS k FROM part WHERE p_size > 40)")
def tuned_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels that stages or parameters of their own are set for."""
    a = T.table(spark, sf, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 9).cast("int").alias("level"))
    b = T.table(spark, sf, "part").where("p_size > 40").select((F.col("p_size") % 7).cast("int").alias("level"))
    return a.union(b).distinct()


@query(f"""WITH {VOL}, {CHUNKS}, m AS (SELECT b.chunk_id AS core, CAST(floor((c.chunk_id * 7 + s.i) / 4.0) AS INT) AS task_id FROM chunks c, chunks b, dims, (SELECT unnest(range(7)) AS i) s WHERE {_MEET})
SELECT task_id, max(core) AS after FROM m GROUP BY task_id""")
def releases(spark: SparkSession, sf: str) -> DataFrame:
    """After which core each register task's result can go."""
    c = _chunks(spark, sf)
    subjects = spark.range(7).select((F.col("id") + 1).cast("int").alias("subject"), F.col("id").cast("int").alias("rank"))
    met = tiling.touching(c, tiling.blend_boxes(c, T.shape(spark, sf), 2), CORE, HALO, 2).select("chunk_id", F.col("box_id").alias("core"))
    return frames.releases(met.join(tiling.tasks(c, subjects, 4), "chunk_id").select("core", "task_id").distinct())


@query(f"WITH {COHORT} SELECT z, y, x, round(sum(v) * CAST(0.125 AS DOUBLE), 6) AS v FROM coh GROUP BY z, y, x")
def scaled_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over subjects, scaled: the running sum of a template as one aggregation."""
    c = T.cohort(spark, sf).groupBy(*AXES).agg((F.sum("v") * 0.125).alias("v"))
    return rounded(c, "v")


# --- resampling and windows -------------------------------------------------------------------------------------


@query(f"""WITH {VOL}, {FIELDS}, {_field_sql(1)}, lat AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, CAST(0.23719 AS DOUBLE) * avg(uz) AS uz, CAST(0.23719 AS DOUBLE) * avg(uy) AS uy, CAST(0.23719 AS DOUBLE) * avg(ux) AS ux FROM f1 GROUP BY ALL), ld AS (SELECT CAST(ceil(nz / 2.0) AS INT) AS nz, 10 AS ny, 13 AS nx FROM dims),
p AS (SELECT z, y, x, (z - 0.5) / 2 AS cz, (y - 0.5) / 2 AS cy, (x - 0.5) / 2 AS cx FROM vol) SELECT z, y, x, round(uz, 6) AS uz, round(uy, 6) AS uy, round(ux, 6) AS ux FROM ({_gather_sql('p', 'lat', 'z, y, x', VECTOR, 'nearest', dims='ld')})""", signed=VECTOR)
def warm_start(spark: SparkSession, sf: str) -> DataFrame:
    """A field from a coarser run as the seed of this one."""
    fine = _grid(spark, sf)
    other = pooling.pool(T.field(spark, sf), 2, VECTOR).withColumns({u: 0.23719 * F.col(u) for u in VECTOR})
    return rounded(frames.warm_start(other, fine.coarsened(2), fine), *VECTOR)


_SPAN = 8


def _covering_sql(a: str) -> str:
    return f"(SELECT unnest(range(-10, 400)) * 6 AS w{a}) q{a}"


def _in_order(group: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """A whole group, added up in this order."""
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


@query(f"""WITH {VOL}, m AS (SELECT v.z, v.y, v.x, v.v, wz, wy, wx FROM vol v JOIN {_covering_sql('z')} ON wz <= v.z AND v.z < wz + 8 JOIN {_covering_sql('y')} ON wy <= v.y AND v.y < wy + 8 JOIN {_covering_sql('x')} ON wx <= v.x AND v.x < wx + 8),
a AS (SELECT wz, wy, wx, avg(v) AS mean FROM m GROUP BY ALL),
g AS (SELECT m.*, a.mean, {" * ".join(f"exp(-0.5 * pow((m.{a} - m.w{a} - 3.5) / 2.0, 2))" for a in AXES)} AS g FROM m JOIN a ON a.wz = m.wz AND a.wy = m.wy AND a.wx = m.wx)
SELECT z, y, x, round(sum(g * (v - mean)) / sum(g), 4) AS v FROM g GROUP BY z, y, x""", signed=("v",))
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """What a model says of overlapping windows, here a voxel less its window's mean, averaged with weights that fall from each window's middle."""
    v = T.volume(spark, sf)
    for a in AXES:  # windows of 8 voxels start at multiples of 6
        first, last = F.floor((F.col(a) - _SPAN) / 6) + 1, F.floor(F.col(a) / 6)
        v = v.withColumn("w" + a, F.explode(F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda k: k * 6)))
    window = ["w" + a for a in AXES]
    weight = F.lit(1.0)
    for a in AXES:
        weight = weight * F.exp(-0.5 * F.pow((F.col(a) - F.col("w" + a) - 3.5) / 2.0, 2))
    # cents less a mean of 512 often lie halfway between two roundings: sums in a fixed order round them alike, however rows are dealt
    met = v.withColumns({"mean": F.avg("v").over(_in_order(window, AXES)), "g": weight})
    total = {"v": F.sum(F.col("g") * (F.col("v") - F.col("mean"))), "g": F.sum("g")}
    met = met.withColumns({"n": F.row_number().over(Window.partitionBy(*AXES).orderBy(*window)), **{c: t.over(_in_order(AXES, window)) for c, t in total.items()}})
    return rounded(met.where("n = 1").select(*AXES, (F.col("v") / F.col("g")).alias("v")), "v", digits=4)


@query(f"""WITH {VOL}, mid AS (SELECT y, x, v FROM vol, dims WHERE z = nz // 2), s AS (SELECT CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j FROM (SELECT unnest(range(32)) AS i) a, (SELECT unnest(range(32)) AS j) b)
SELECT i, j, v FROM s JOIN mid ON y = i * 20 // 32 AND x = j * 25 // 32""")
def nearest_tile(spark: SparkSession, sf: str) -> DataFrame:
    """The middle plane as a square tile, nearest neighbour."""
    shape = T.shape(spark, sf)
    return colours.tile(T.volume(spark, sf).where(frames.plane_box(shape, "z")), shape[1:], 32)


_BASIS = [[round(math.cos((k + 1) * (c + 0.5) * math.pi / 64), 6) for c in range(64)] for k in range(3)]
_GUN_SQL = ", ".join(f"list_sum([CAST(embedding[c] AS DOUBLE) * [{', '.join(map(str, row))}][c] FOR c IN range(1, 65)]) AS {g}" for row, g in zip(_BASIS, "rgb", strict=True))


@query(f"""WITH p AS (SELECT vec_id, {_GUN_SQL} FROM embeddings), w AS (SELECT {", ".join(f"quantile_cont({g}, 0.01) AS l{g}, quantile_cont({g}, 0.99) AS h{g}" for g in "rgb")} FROM p)
SELECT vec_id, {", ".join(f"round(least(greatest(({g} - l{g}) / greatest(h{g} - l{g}, 1e-8), 0), 1), 6) AS {g}" for g in "rgb")} FROM p, w""")
def rgb_map(spark: SparkSession, sf: str) -> DataFrame:
    """Features on three directions, each scaled from its 1st to its 99th percentile."""
    e = T.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 64).alias("embedding"))
    return rounded(colours.ranged(colours.projected(e, "embedding", _BASIS)).select("vec_id", "r", "g", "b"), "r", "g", "b")


@query()
def rgb_basis(spark: SparkSession, sf: str) -> DataFrame:
    """The three main directions of all features, and their shares of the variance."""
    basis, _, shares = colours.colour_basis(T.table(spark, sf, "embeddings").select(F.slice("embedding", 1, 64).alias("f")), "f", 64)
    rows = [(k, c, float(round(basis[k, c], 6)), float(round(shares[k], 6))) for k in range(3) for c in range(64)]
    return spark.createDataFrame(rows, "direction int, channel int, weight double, share double")


@query("SELECT CAST(core AS INT) AS core, round(pow(core + 96, 3) * 16 * 90 / 1e9, 6) AS gigabytes, CAST(CASE WHEN 2 * pow(core + 96, 3) * 16 * 90 <= 0.8 * 80e9 THEN 2 ELSE 1 END AS INT) AS workers, pow(core + 96, 3) * 16 * 90 * CASE WHEN 2 * pow(core + 96, 3) * 16 * 90 <= 0.8 * 80e9 THEN 2 ELSE 1 END <= 0.8 * 80e9 AS fits FROM (SELECT DISTINCT 8 * p_size AS core FROM part)")
def worker_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Memory of a chunk by the size of its core, and how many tasks share a device of 80 GB."""
    from voxframe.plans.costs import Profile

    cores = sorted(r[0] * 8 for r in T.table(spark, sf, "part").select("p_size").distinct().collect())  # 50 sizes at most
    rows = []
    for core in cores:
        need = Profile(core=core).bytes_needed()
        rows.append((core, round(need / 1e9, 6), *frames.workers(need, 80.0)))
    return spark.createDataFrame(rows, "core int, gigabytes double, workers int, fits boolean")


@query(f"""WITH {VOL}, {_L1} SELECT round(quantile_cont(v, 0.005), 6) AS low, round(quantile_cont(v, 0.995), 6) AS high, count(*) AS voxels FROM l1""")
def ingested_window(spark: SparkSession, sf: str) -> DataFrame:
    """An ingested pyramid's second level and its intensity window."""
    store = stores.ingest(spark, shared(spark, "store"), T.volume(spark, sf), _grid(spark, sf), core=CORE)
    level = store.level(1)
    return rounded(stats.intensity_window(level).crossJoin(F.broadcast(level.agg(F.count(F.lit(1)).alias("voxels")))), "low", "high")


@query(f"WITH {VOL} SELECT z + 0 AS z, y, x, v FROM vol WHERE z % 3 = 0")
def kept_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Every third plane by its own index: a copy of voxels without interpolation where lattices agree."""
    fine = _grid(spark, sf)
    coarse = Grid((-(-fine.shape[0] // 3), *fine.shape[1:]), fine.spacing, fine.origin)
    places = gather.dense(spark, coarse.shape).withColumns({"cz": F.col("z") * 3.0, "cy": F.col("y") * 1.0, "cx": F.col("x") * 1.0})
    return gather.sample(places, T.volume(spark, sf), fine.shape, ("v",)).select((F.col("z") * 3).alias("z"), "y", "x", "v")
