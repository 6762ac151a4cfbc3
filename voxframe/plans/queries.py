"""One query for each volume operator, over volumes carved out of the driver's tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import scalar as S
from voxframe.functions.scalar import AXES, VECTOR
from voxframe.operators import blending, gather, pooling, stats, stencil, tiling
from voxframe.operators.tiling import Grid
from voxframe.plans import costs, stopping
from voxframe.sources import tables as T
from voxframe.sources.tables import SPACING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CORE, HALO = 8, 4
Make = Callable[[SparkSession, str], DataFrame]

# --- SQL of the shared inputs -----------------------------------------------------------------------------------

_AT = "CAST(floor({k} / 500.0) AS INT) AS z, CAST(floor({k} / 25.0) % 20 AS INT) AS y, CAST({k} % 25 AS INT) AS x"
VOL = f"vol AS (SELECT {_AT.format(k='o_orderkey')}, o_totalprice AS v FROM orders), dims AS (SELECT max(z) + 1 AS nz, 20 AS ny, 25 AS nx FROM vol)"
COHORT = f"coh AS (SELECT l_linenumber AS subject, {_AT.format(k='l_orderkey')}, avg(l_quantity) AS v FROM lineitem GROUP BY l_linenumber, l_orderkey)"
FIELDS = f"fields AS (SELECT l_linenumber AS subject, {_AT.format(k='l_orderkey')}, avg(l_discount) - 0.05 AS uz, avg(l_tax) - 0.04 AS uy, (avg(l_quantity) - 25.5) / 250 AS ux FROM lineitem GROUP BY l_linenumber, l_orderkey)"


def _field_sql(subject: int) -> str:
    """One subject's dense field; needs VOL and FIELDS before it."""
    return f"f{subject} AS (SELECT v.z, v.y, v.x, coalesce(uz, 0) AS uz, coalesce(uy, 0) AS uy, coalesce(ux, 0) AS ux FROM vol v LEFT JOIN (SELECT * FROM fields WHERE subject = {subject}) d ON d.z = v.z AND d.y = v.y AND d.x = v.x)"


def _axis_ids(n: str, per: int = CORE) -> str:
    return f"(SELECT unnest(range(CAST(ceil(({n}) / {per}.0) AS BIGINT))) AS i)"


CHUNKS = f"""chunks AS (
  SELECT CAST((z.i * ceil(ny / {CORE}.0) + y.i) * ceil(nx / {CORE}.0) + x.i AS INT) AS chunk_id, CAST(z.i AS INT) AS iz, CAST(y.i AS INT) AS iy, CAST(x.i AS INT) AS ix,
    {", ".join(f"CAST({a}.i * {CORE} AS INT) AS core_{a}0, CAST(least({a}.i * {CORE} + {CORE}, n{a}) - {a}.i * {CORE} AS INT) AS core_n{a}, CAST(greatest({a}.i * {CORE} - {HALO}, 0) AS INT) AS pad_{a}0, CAST(least({a}.i * {CORE} + {CORE} + {HALO}, n{a}) - greatest({a}.i * {CORE} - {HALO}, 0) AS INT) AS pad_n{a}" for a in AXES)}
  FROM dims, {_axis_ids("SELECT nz FROM dims")} z, {_axis_ids("20")} y, {_axis_ids("25")} x)"""


def _gather_sql(places: str, volume: str, ids: str, values: tuple[str, ...], boundary: str, cval: float = 0.0, on: str = "", dims: str = "dims", hide: str = "") -> str:
    """Interpolated values at places (ids, cz, cy, cx) as a SELECT."""
    snap = lambda a: f"(round_even(CAST(c{a} AS DOUBLE) * 1099511627776, 0) / 1099511627776)"  # noqa: E731  bounds do not depend on the order of sums
    inside = "TRUE" if boundary != "constant" else " AND ".join(f"{snap(a)} >= 0 AND {snap(a)} <= n{a} - 1" for a in AXES)
    clamp = (lambda a: f"least(greatest({snap(a)}, 0), n{a} - 1)") if boundary == "nearest" else snap
    cols = ", ".join(f"p.{i}" for i in ids.split(", "))
    return f"""
      SELECT {cols}, {", ".join(f"CASE WHEN any_value(p.ok) THEN coalesce(sum(w * b.{v}), 0) ELSE {cval} END AS {hide}{v}" for v in values)}
      FROM (SELECT *, {inside} AS ok, {", ".join(f"{clamp(a)} AS e{a}" for a in AXES)} FROM {places}, {dims}) p
      CROSS JOIN LATERAL (SELECT CAST(floor(ez) AS INT) + dz AS kz, CAST(floor(ey) AS INT) + dy AS ky, CAST(floor(ex) AS INT) + dx AS kx,
        {" * ".join(f"(CASE WHEN d{a} = 0 THEN 1 - (e{a} - floor(e{a})) ELSE e{a} - floor(e{a}) END)" for a in AXES)} AS w
        FROM (VALUES (0), (1)) a(dz), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) c(dx)) k
      LEFT JOIN {volume} b ON b.z = k.kz AND b.y = k.ky AND b.x = k.kx AND k.w > 0 {on}
      GROUP BY {cols}"""


def _kernel_sql(sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    return f"kern AS (SELECT d, exp(-0.5 * d * d / {sigma * sigma}) / (SELECT sum(exp(-0.5 * d * d / {sigma * sigma})) FROM (SELECT unnest(range({-r}, {r + 1})) AS d)) AS w FROM (SELECT unnest(range({-r}, {r + 1})) AS d))"


def _filter_sql(name: str, source: str, kernel: str = "kern", values: tuple[str, ...] = ("v",)) -> str:
    """CTEs name_z, name_y, name: a separable filter of source with repeated ends."""
    out, last = [], source
    for a, done in zip(AXES, (f"{name}_z", f"{name}_y", name), strict=True):
        on = " AND ".join(f"b.{b} = " + (f"least(greatest(a.{b} + k.d, 0), n{b} - 1)" if a == b else f"a.{b}") for b in AXES)
        out.append(f"{done} AS (SELECT a.z, a.y, a.x, {', '.join(f'sum(k.w * b.{v}) AS {v}' for v in values)} FROM {last} a CROSS JOIN {kernel} k CROSS JOIN dims JOIN {last} b ON {on} GROUP BY a.z, a.y, a.x)")
        last = done
    return ", ".join(out)


def query(oracle: str | None = None, signed: tuple[str, ...] = ()) -> Callable[[Make], Make]:
    """Registers a query under its function's name, with its SQL; signed columns may round to a zero below 0."""

    def add(f: Make) -> Make:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'{c} + 0.0 AS {c}' for c in signed)}) FROM ({oracle})" if signed else oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums in another order differ in their last bits; results are compared after rounding."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})  # no zero below 0


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.tile(spark, T.shape(spark, sf), CORE, HALO)


# --- pooling and windows ----------------------------------------------------------------------------------------


@query(f"""WITH {VOL}, l1 AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(v) AS v FROM vol GROUP BY ALL),
l2 AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(v) AS v FROM l1 GROUP BY ALL),
a AS (SELECT 0 AS level, * FROM vol UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2),
w AS (SELECT level, quantile_cont(v, 0.005) AS low, quantile_cont(v, 0.995) AS high FROM a GROUP BY level)
SELECT a.level, count(*) AS voxels, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, round(avg(least(greatest((v - low) / (high - low), 0), 1)), 6) AS mean FROM a JOIN w ON a.level = w.level GROUP BY a.level""")
def level_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Pyramid, each level's intensity window, and the mean of the normalised level: the flagship."""
    levels = pooling.pyramid(T.volume(spark, sf), 2)
    w = stats.intensity_window(levels, keys=("level",))
    out = levels.join(F.broadcast(w), "level").groupBy("level").agg(F.count(F.lit(1)).alias("voxels"), F.first("low").alias("low"), F.first("high").alias("high"), F.avg(S.normalise("v", F.col("low"), F.col("high"))).alias("mean"))
    return rounded(out, "low", "high", "mean")


@query(f"""WITH {VOL}, l1 AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(v) AS v FROM vol GROUP BY ALL),
l2 AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(v) AS v FROM l1 GROUP BY ALL)
SELECT 1 AS level, z, y, x, round(v, 6) AS v FROM l1 UNION ALL SELECT 2, z, y, x, round(v, 6) FROM l2""")
def pyramid_pool(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pooling.pyramid(T.volume(spark, sf), 2).where("level > 0"), "v")


@query(f"""WITH {VOL}, l1 AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, CAST(floor(avg(floor(v))) AS BIGINT) AS v FROM vol GROUP BY ALL)
SELECT 2 AS level, CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM l1 GROUP BY ALL""")
def pyramid_integer(spark: SparkSession, sf: str) -> DataFrame:
    """Stored levels of an integer volume are cut, not rounded."""
    whole = T.volume(spark, sf).withColumn("v", F.floor("v"))
    return pooling.pyramid(whole, 2, integer=True).where("level = 2")


@query(f"""WITH {VOL}, w AS (SELECT *, (CASE WHEN nz % 3 > 0 AND z = nz - 1 THEN 4 - nz % 3 ELSE 1 END) * (CASE WHEN y = 19 THEN 2 ELSE 1 END) * (CASE WHEN x = 24 THEN 3 ELSE 1 END) AS w FROM vol, dims)
SELECT CAST(floor(z / 3.0) AS INT) AS z, CAST(floor(y / 3.0) AS INT) AS y, CAST(floor(x / 3.0) AS INT) AS x, round(sum(v * w) / sum(w), 6) AS v FROM w GROUP BY 1, 2, 3""")
def pool_padded(spark: SparkSession, sf: str) -> DataFrame:
    """Factor 3 over ragged ends: the last plane stands for the missing ones."""
    return rounded(pooling.pool(T.volume(spark, sf), 3, shape=T.shape(spark, sf)), "v")


@query(f"""WITH {VOL} SELECT CAST(floor(z / 3.0) AS INT) AS z, CAST(floor(y / 3.0) AS INT) AS y, CAST(floor(x / 3.0) AS INT) AS x, round(avg(v), 6) AS v FROM vol GROUP BY 1, 2, 3""")
def pool_present(spark: SparkSession, sf: str) -> DataFrame:
    """Factor 3, over the voxels there are."""
    return rounded(pooling.pool(T.volume(spark, sf), 3), "v")


@query(f"""WITH {VOL}, lat AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(v) AS v FROM vol GROUP BY ALL)
SELECT a.z, a.y, a.x, round(b.v, 6) AS v FROM vol a JOIN lat b ON b.z = floor(a.z / 2.0) AND b.y = floor(a.y / 2.0) AND b.x = floor(a.x / 2.0)""")
def upsample_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pooling.upsample_nearest(pooling.pool(T.volume(spark, sf), 2), 2, T.shape(spark, sf)), "v")


@query(f"WITH {VOL} SELECT z, y, x, round(least(greatest((v - 1000) / 299000, 0), 1), 9) AS v, CAST(least(greatest(round_even(v / 1000, 0), 0), 255) AS BIGINT) AS stored FROM vol")
def normalise_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Clipped normalisation, and the cast of an ingest: half to even, clipped."""
    v = T.volume(spark, sf)
    return v.select(*AXES, F.round(S.normalise("v", 1000, 300000), 9).alias("v"), S.as_integer(F.col("v") / 1000, 0, 255).alias("stored"))


@query(f"""WITH {VOL}, t AS (SELECT 0.1 * max(v) AS t FROM vol) SELECT round(quantile_cont(v, 0.005), 6) AS low, round(quantile_cont(v, 0.995), 6) AS high FROM vol, t WHERE v > t""")
def masked_window(spark: SparkSession, sf: str) -> DataFrame:
    """Intensity window of voxels above a tenth of the greatest."""
    return rounded(stats.intensity_window(T.volume(spark, sf), mask_frac=0.1), "low", "high")


# --- tiling -----------------------------------------------------------------------------------------------------


@query(f"WITH {VOL}, {CHUNKS} SELECT * FROM chunks")
def tile_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf)


@query(f"""WITH {VOL}, l AS (SELECT CAST(unnest(range(CAST(ceil(log2(greatest(nz, ny, nx) / 8.0)) AS BIGINT) + 1)) AS INT) AS level, nz, ny, nx FROM dims)
SELECT level, CAST(ceil(nz / pow(2, level)) AS INT) AS nz, CAST(ceil(ny / pow(2, level)) AS INT) AS ny, CAST(ceil(nx / pow(2, level)) AS INT) AS nx, round(0.05 * pow(2, level), 9) AS spacing_mm, round(0.05 * (pow(2, level) - 1) / 2, 9) AS oz,
CAST(ceil(ceil(nz / pow(2, level)) / 8) * ceil(ceil(ny / pow(2, level)) / 8) * ceil(ceil(nx / pow(2, level)) / 8) AS BIGINT) AS chunks FROM l""")
def pyramid_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Every level's grid and how many chunks tile it."""
    g = tiling.grids(spark, Grid(T.shape(spark, sf), SPACING), CORE)
    n = F.ceil(F.col("nz") / CORE) * F.ceil(F.col("ny") / CORE) * F.ceil(F.col("nx") / CORE)
    return rounded(g.select("level", "nz", "ny", "nx", "spacing_mm", "oz", n.alias("chunks")), "spacing_mm", "oz", digits=9)


_MEET = " AND ".join(f"least(c.pad_{a}0 + c.pad_n{a}, least(b.core_{a}0 + b.core_n{a} + 2, n{a})) > greatest(c.pad_{a}0, greatest(b.core_{a}0 - 2, 0))" for a in AXES)


@query(f"WITH {VOL}, {CHUNKS} SELECT c.chunk_id, b.chunk_id AS box_id FROM chunks c, chunks b, dims WHERE {_MEET}")
def chunks_touching(spark: SparkSession, sf: str) -> DataFrame:
    """Which chunks' padded boxes meet which blend boxes: an interval join as an equi-join on neighbour keys."""
    c = _chunks(spark, sf)
    return tiling.touching(c, tiling.blend_boxes(c, T.shape(spark, sf), 2), CORE, HALO, 2).select("chunk_id", "box_id")


@query(f"""WITH {VOL}, {CHUNKS}, m AS (SELECT b.chunk_id AS core, CAST(floor((c.chunk_id * 7 + s.i) / 4.0) AS INT) AS task_id FROM chunks c, chunks b, dims, (SELECT unnest(range(7)) AS i) s WHERE {_MEET})
SELECT core, count(DISTINCT task_id) AS needs, min(task_id) AS first_task, max(task_id) AS last_task FROM m GROUP BY core""")
def blend_depends(spark: SparkSession, sf: str) -> DataFrame:
    """How many register tasks each core waits for."""
    c = _chunks(spark, sf)
    subjects = spark.range(7).select((F.col("id") + 1).cast("int").alias("subject"), F.col("id").cast("int").alias("rank"))
    met = tiling.touching(c, tiling.blend_boxes(c, T.shape(spark, sf), 2), CORE, HALO, 2).select("chunk_id", F.col("box_id").alias("core"))
    need = met.join(tiling.tasks(c, subjects, 4), "chunk_id").select("core", "task_id").distinct()
    return need.groupBy("core").agg(F.count(F.lit(1)).alias("needs"), F.min("task_id").alias("first_task"), F.max("task_id").alias("last_task"))


@query(f"""WITH {VOL}, {CHUNKS} SELECT CAST(floor((chunk_id * 7 + s.i) / 4.0) AS INT) AS task_id, CAST((chunk_id * 7 + s.i) % 4 AS INT) AS place, chunk_id, CAST(s.i + 1 AS INT) AS subject FROM chunks, (SELECT unnest(range(7)) AS i) s""")
def manifest_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of a pass, grouped into tasks chunk by chunk."""
    subjects = spark.range(7).select((F.col("id") + 1).cast("int").alias("subject"), F.col("id").cast("int").alias("rank"))
    return tiling.tasks(_chunks(spark, sf), subjects, 4)


_INSIDE = " AND ".join(f"v.{a} >= c.pad_{a}0 AND v.{a} < c.pad_{a}0 + c.pad_n{a}" for a in AXES)


@query(f"WITH {VOL}, {CHUNKS} SELECT c.chunk_id, count(*) AS voxels, round(sum(v), 3) AS total FROM chunks c JOIN vol v ON {_INSIDE} GROUP BY c.chunk_id")
def halo_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk's padded box of voxels."""
    parts = tiling.halo_expand(T.volume(spark, sf), T.shape(spark, sf), CORE, HALO)
    return rounded(parts.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("voxels"), F.sum("v").alias("total")), "total", digits=3)


@query(f"""WITH {VOL}, {CHUNKS}, c AS (SELECT DISTINCT iz, core_z0 AS c0, core_z0 + core_nz AS c1, pad_z0 AS p0, pad_z0 + pad_nz AS p1 FROM chunks), z AS (SELECT iz, c0, c1, p0, p1, CAST(unnest(range(p0, p1)) AS INT) AS z FROM c)
SELECT iz, z, round(CASE WHEN z >= c0 AND z < c1 THEN 1 WHEN z < c0 THEN 0.5 - 0.5 * cos(pi() * ((z - p0) + 0.5) / (c0 - p0)) ELSE 0.5 - 0.5 * cos(pi() * ((p1 - 1 - z) + 0.5) / (p1 - c1)) END, 9) AS w FROM z""")
def axis_window(spark: SparkSession, sf: str) -> DataFrame:
    """The Hann taper of every chunk along z."""
    n = T.shape(spark, sf)[0]
    c = _chunks(spark, sf).select("iz", "pad_z0", "pad_nz").distinct()
    z = c.select("iz", F.explode(F.sequence("pad_z0", F.col("pad_z0") + F.col("pad_nz") - 1)).alias("z"))
    return rounded(z.withColumn("w", tiling.axis_weight("z", n, CORE, HALO)), "w", digits=9)


@query(f"""WITH {VOL}, {CHUNKS} SELECT chunk_id, CAST(floor(pad_z0 / 2.0) AS INT) AS first, CAST(ceil((pad_z0 + pad_nz) / 2.0) - floor(pad_z0 / 2.0) AS INT) AS extent FROM chunks""")
def lattice_box(spark: SparkSession, sf: str) -> DataFrame:
    """The z extent of each padded box on a lattice twice as coarse."""
    first, extent = tiling.lattice_box(F.col("pad_z0"), F.col("pad_nz"), 2)
    return _chunks(spark, sf).select("chunk_id", first.alias("first"), extent.alias("extent"))


@query(f"""WITH {VOL}, {CHUNKS}, w AS (SELECT chunk_id, pad_z0, pad_nz, pad_y0, pad_ny, pad_x0, pad_nx FROM chunks)
SELECT chunk_id, CAST(z.i * 6 AS INT) AS wz, CAST(y.i * 6 AS INT) AS wy, CAST(x.i * 6 AS INT) AS wx FROM w, (SELECT unnest(range(-5, 400)) AS i) z, (SELECT unnest(range(-5, 20)) AS i) y, (SELECT unnest(range(-5, 20)) AS i) x
WHERE z.i * 6 + 8 > pad_z0 AND z.i * 6 < pad_z0 + pad_nz AND y.i * 6 + 8 > pad_y0 AND y.i * 6 < pad_y0 + pad_ny AND x.i * 6 + 8 > pad_x0 AND x.i * 6 < pad_x0 + pad_nx""")
def anchored_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 8 voxels every 6 that meet each padded box, whatever chunk asks."""
    return tiling.anchored_windows(_chunks(spark, sf), 8, 6)


# --- reductions -------------------------------------------------------------------------------------------------

_BIN = "CASE WHEN {v} < 1e-6 THEN 0 ELSE CAST(least(255, 1 + floor((log10({v}) + 6) * (254 / 9.0))) AS INT) END"
_EDGE = "CASE WHEN bin >= 255 THEN 1000 ELSE least(pow(10, -6 + 9.0 * bin / 254), 1000) END"


@query(f"SELECT event_type, {_BIN.format(v='value')} AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def hist_partial(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(T.table(spark, sf, "events"), "value", ("event_type",))


@query(f"""WITH h AS (SELECT {_BIN.format(v='value')} AS bin, count(*) AS n FROM events GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM h), b AS (SELECT min(bin) AS bin FROM c WHERE cum >= 0.99 * total)
SELECT bin, round({_EDGE}, 6) AS value FROM b""")
def hist_merge_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Partial histograms by type, merged, and their 99th percentile."""
    return rounded(stats.percentile(stats.merged(hist_partial(spark, sf)), 99), "value")


@query(f"WITH {FIELDS} SELECT subject, round(quantile_cont(sqrt(uz * uz + uy * uy + ux * ux), 0.99), 6) AS p99, round(max(sqrt(uz * uz + uy * uy + ux * ux)), 6) AS most, CAST(ceil(max(greatest(abs(uz), abs(uy), abs(ux))) / 0.05) + 2 AS INT) AS margin FROM fields GROUP BY subject")
def exact_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentile of the displacement's length, and the margin that a warp must read."""
    size = S.magnitude(*VECTOR)
    margin = (F.ceil(F.max(F.greatest(*[F.abs(F.col(u)) for u in VECTOR])) / SPACING) + 2).cast("int")
    f = T.fields(spark, sf)
    p = stats.exact_quantiles(f, size, (0.99,), ("subject",)).select("subject", F.col("p")[0].alias("p99"))
    return rounded(p.join(f.groupBy("subject").agg(F.max(size).alias("most"), margin.alias("margin")), "subject"), "p99", "most")


@query(f"""WITH {VOL}, {CHUNKS}, e AS (SELECT c.chunk_id, v FROM chunks c JOIN vol v ON {_INSIDE}), t AS (SELECT chunk_id, greatest(0.02, 0.05 * max(v)) AS t FROM e GROUP BY 1)
SELECT e.chunk_id, round(avg(CASE WHEN v > t THEN 1.0 ELSE 0.0 END), 9) AS tissue FROM e JOIN t ON e.chunk_id = t.chunk_id GROUP BY 1""")
def tissue_fraction(spark: SparkSession, sf: str) -> DataFrame:
    parts = tiling.halo_expand(T.volume(spark, sf), T.shape(spark, sf), CORE, HALO)
    return rounded(stats.tissue_fraction(parts, ("chunk_id",)), "tissue", digits=9)


@query(f"""WITH {VOL}, {COHORT}, a AS (SELECT v.z, v.y, v.x, v.v AS a, c.v AS b FROM vol v JOIN coh c ON c.z = v.z AND c.y = v.y AND c.x = v.x AND c.subject = 1)
SELECT CAST(floor(z / 8.0) AS INT) AS iz, round(2.0 * count(*) FILTER (a > 150000 AND b > 25) / (count(*) FILTER (a > 150000) + count(*) FILTER (b > 25)), 9) AS dice FROM a GROUP BY 1""")
def dice(spark: SparkSession, sf: str) -> DataFrame:
    one = T.cohort(spark, sf).where("subject = 1").select(*AXES, F.col("v").alias("w"))
    both = T.volume(spark, sf).join(one, list(AXES)).withColumn("iz", F.floor(F.col("z") / CORE).cast("int"))
    return rounded(stats.dice(both, F.col("v") > 150000, F.col("w") > 25, ("iz",)), "dice", digits=9)


@query(f"WITH {COHORT} SELECT subject, round(sum(v * z) / sum(v), 6) AS cz, round(sum(v * y) / sum(v), 6) AS cy, round(sum(v * x) / sum(v), 6) AS cx FROM coh GROUP BY subject")
def centre_of_mass(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.centre_of_mass(T.cohort(spark, sf), keys=("subject",)), "cz", "cy", "cx")


@query(f"""WITH {COHORT} SELECT z, y, x, round(max(CASE WHEN v <= 45 THEN v END), 6) AS most, round(avg(CASE WHEN v > 45 THEN 1.0 ELSE 0.0 END), 9) AS gave_up FROM coh GROUP BY z, y, x""")
def cohort_fmax(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest value over subjects where those above 45 gave up (NaN)."""
    nan = T.cohort(spark, sf).withColumn("v", F.when(F.col("v") > 45, F.lit(float("nan"))).otherwise(F.col("v")))
    return stats.over_subjects(nan).withColumns({"most": F.round("most", 6), "gave_up": F.round("gave_up", 9)})


@query(f"WITH {COHORT} SELECT z, y, x, round(avg(v), 6) AS v FROM coh GROUP BY z, y, x")
def mean_template(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(blending.mean_template(T.cohort(spark, sf)), "v")


@query(f"""WITH {COHORT}, {FIELDS} SELECT c.z, c.y, c.x, round(sum(c.v), 6) AS isum, round(sum(uz), 6) AS sz, round(sum(uy), 6) AS sy, round(sum(ux), 6) AS sx, count(*) AS n FROM coh c JOIN fields f ON f.subject = c.subject AND f.z = c.z AND f.y = c.y AND f.x = c.x GROUP BY c.z, c.y, c.x""", signed=('sz', 'sy', 'sx'))
def accumulators(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(blending.accumulate(T.cohort(spark, sf), T.fields(spark, sf)), "isum", "sz", "sy", "sx")


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS c FROM embeddings), s AS (SELECT vec_id, greatest(sqrt(sum(CAST(v AS DOUBLE) * v)), 1e-6) AS s FROM e GROUP BY 1)
SELECT e.vec_id, CAST(c AS INT) AS channel, round(CAST(v AS DOUBLE) / s, 6) AS v FROM e JOIN s ON e.vec_id = s.vec_id""", signed=('v',))
def channel_l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "embeddings").select("vec_id", F.posexplode(S.l2_channels("embedding")).alias("channel", "v"))
    return rounded(e.withColumn("channel", F.col("channel") + 1), "v")


@query("""WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS c FROM embeddings), s AS (SELECT vec_id, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM e GROUP BY 1)
SELECT e.vec_id, CAST(c AS INT) AS channel, round((v - m) / s, 6) AS v FROM e JOIN s ON e.vec_id = s.vec_id""", signed=('v',))
def channel_standardise(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "embeddings").select("vec_id", F.posexplode(S.standard_channels("embedding")).alias("channel", "v"))
    return rounded(e.withColumn("channel", F.col("channel") + 1), "v")


_COV = """e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings),
cov AS (SELECT CAST(a.c AS INT) AS i, CAST(b.c AS INT) AS j, avg(a.v * b.v) - avg(a.v) * avg(b.v) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.c <= b.c AND b.c < 64 GROUP BY 1, 2)"""


@query(f"WITH {_COV} SELECT i, j, round(cov, 6) AS cov FROM cov", signed=('cov',))
def pca_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.covariance(T.table(spark, sf, "embeddings"), "embedding", 64), "cov")


@query(f"WITH {_COV} SELECT round(sum(CASE WHEN i = j THEN cov ELSE 0 END) ^ 2 / sum(cov * cov * CASE WHEN i = j THEN 1 ELSE 2 END), 4) AS ratio FROM cov")
def feature_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Participation ratio of the channels."""
    return rounded(stats.participation(stats.covariance(T.table(spark, sf, "embeddings"), "embedding", 64)), "ratio", digits=4)


@query("""SELECT CAST(o_custkey % 5 AS INT) AS level, count(*) AS entries, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS seeded_folds, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS retries, round(max(o_totalprice) / 1e6, 9) AS fold_frac FROM orders GROUP BY 1""")
def collect_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Run records reduced to what a pass reports."""
    o = T.table(spark, sf, "orders").withColumn("level", (F.col("o_custkey") % 5).cast("int"))
    records = o.select("level", F.when(F.col("o_orderstatus") == "O", "tissue").when(F.col("o_orderstatus") == "P", "folds").alias("reason"), (F.col("o_orderstatus") == "F").cast("long").alias("retries"))
    return rounded(stats.collected(records, o.select("level", (F.col("o_totalprice") / 1e6).alias("folds")), ("level",)), "fold_frac", digits=9)


# --- resampling -------------------------------------------------------------------------------------------------

_F1 = f"{VOL}, {FIELDS}, {_field_sql(1)}, p1 AS (SELECT *, z + uz / 0.05 AS cz, y + uy / 0.05 AS cy, x + ux / 0.05 AS cx FROM f1)"


@query(f"WITH {_F1} SELECT z, y, x, round(v, 4) AS v FROM ({_gather_sql('p1', 'vol', 'z, y, x', ('v',), 'constant')})")
def warp_constant(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gather.warp(T.volume(spark, sf), T.field(spark, sf), T.shape(spark, sf), SPACING), "v", digits=4)


@query(f"WITH {_F1} SELECT z, y, x, CASE WHEN v > 0.5 THEN 1 ELSE 0 END AS inside FROM ({_gather_sql('p1', '(SELECT z, y, x, 1.0 AS v FROM vol)', 'z, y, x', ('v',), 'constant')})")
def coverage_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Where a warp reads inside the volume."""
    ones = T.volume(spark, sf).select(*AXES, F.lit(1.0).alias("v"))
    return gather.warp(ones, T.field(spark, sf), T.shape(spark, sf), SPACING).select(*AXES, (F.col("v") > 0.5).cast("int").alias("inside"))


@query(f"WITH {_F1}, {_field_sql(2)} SELECT z, y, x, round(uz + guz, 6) AS uz, round(uy + guy, 6) AS uy, round(ux + gux, 6) AS ux FROM ({_gather_sql('p1', 'f2', 'z, y, x, uz, uy, ux', VECTOR, 'nearest', hide='g')})", signed=('uz', 'uy', 'ux'))
def compose_fields(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gather.compose(T.field(spark, sf, 1), T.field(spark, sf, 2), T.shape(spark, sf), SPACING), *VECTOR)


_COARSE = "g AS (SELECT CAST(a.i AS INT) AS z, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS x, a.i * 2 + 0.5 AS cz, b.i * 2 + 0.5 AS cy, c.i * 2 + 0.5 AS cx FROM (SELECT unnest(range(CAST(ceil((SELECT nz FROM dims) / 2.0) AS BIGINT))) AS i) a, (SELECT unnest(range(10)) AS i) b, (SELECT unnest(range(13)) AS i) c)"


@query(f"WITH {VOL}, {_COARSE} SELECT z, y, x, round(v, 4) AS v FROM ({_gather_sql('g', 'vol', 'z, y, x', ('v',), 'nearest')})")
def resample_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """A volume on the grid of the next level, ends clamped."""
    fine = Grid(T.shape(spark, sf), SPACING)
    return rounded(gather.resample(T.volume(spark, sf), fine, fine.coarsened(2)), "v", digits=4)


@query(f"""WITH {VOL}, lat AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(v) AS v FROM vol GROUP BY ALL), ld AS (SELECT CAST(ceil(nz / 2.0) AS INT) AS nz, 10 AS ny, 13 AS nx FROM dims),
p AS (SELECT z, y, x, (z - 0.5) / 2 AS cz, (y - 0.5) / 2 AS cy, (x - 0.5) / 2 AS cx FROM vol) SELECT z, y, x, round(v, 4) AS v FROM ({_gather_sql('p', 'lat', 'z, y, x', ('v',), 'nearest', dims='ld')})""")
def read_dense(spark: SparkSession, sf: str) -> DataFrame:
    """A lattice read back at full resolution, trilinear."""
    fine = Grid(T.shape(spark, sf), SPACING)
    return rounded(gather.resample(pooling.pool(T.volume(spark, sf), 2), fine.coarsened(2), fine), "v", digits=4)


_MATRIX = [[0.9, 0.1, 0.0, 1.5], [-0.1, 0.9, 0.0, 2.25], [0.0, 0.05, 1.1, -1.0]]


@query(f"""WITH {VOL}, p AS (SELECT z, y, x, CAST(0.9 AS DOUBLE) * z + CAST(0.1 AS DOUBLE) * y + 1.5 AS cz, CAST(-0.1 AS DOUBLE) * z + CAST(0.9 AS DOUBLE) * y + 2.25 AS cy, CAST(0.05 AS DOUBLE) * y + CAST(1.1 AS DOUBLE) * x - 1.0 AS cx FROM vol)
SELECT z, y, x, round(v, 1) AS v FROM ({_gather_sql('p', 'vol', 'z, y, x', ('v',), 'constant', 250.0)})""")
def affine_view(spark: SparkSession, sf: str) -> DataFrame:
    """A view of the volume through an affine matrix; background outside."""
    shape = T.shape(spark, sf)
    return rounded(gather.affine(T.volume(spark, sf), shape, _MATRIX, shape, 250.0), "v", digits=1)


@query(f"""WITH {VOL}, {_kernel_sql(0.25)}, pooled AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(v) AS v FROM vol GROUP BY ALL),
dims2 AS (SELECT CAST(ceil(nz / 2.0) AS INT) AS nz, 10 AS ny, 13 AS nx FROM dims), {_filter_sql('soft', 'pooled').replace('CROSS JOIN dims ', 'CROSS JOIN dims2 ')},
p AS (SELECT CAST(a.i AS INT) AS z, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS x, (3 * a.i - 1.5) / 2 AS cz, (3 * b.i - 1.5) / 2 AS cy, (3 * c.i - 1.5) / 2 AS cx FROM (SELECT unnest(range(CAST(ceil((SELECT nz FROM dims) / 3.0) AS BIGINT) + 2)) AS i) a, (SELECT unnest(range(9)) AS i) b, (SELECT unnest(range(11)) AS i) c)
SELECT z, y, x, round(v, 4) AS v FROM ({_gather_sql('p', 'soft', 'z, y, x', ('v',), 'fade', dims='dims2')})""")
def resampled_source(spark: SparkSession, sf: str) -> DataFrame:
    """A scan read on a run grid three times as coarse that reaches beyond it: pool by 2, blur, interpolate, fade to 0."""
    from voxframe.plans.rungrid import resampled

    shape = T.shape(spark, sf)
    places = gather.dense(spark, tuple(-(-n // 3) + 2 for n in shape)).withColumns({"cz": 3 * F.col("z") - 1.0, "cy": 3 * F.col("y") - 1.0, "cx": 3 * F.col("x") - 1.0})
    return rounded(resampled(T.volume(spark, sf), shape, places, 2, 0.25), "v", digits=4)


@query(f"WITH {FIELDS}, m AS (SELECT *, sqrt(uz * uz + uy * uy + ux * ux) AS m FROM fields) SELECT subject, z, y, x, round(CASE WHEN m > 0.05 THEN uz * 0.05 / m ELSE uz END, 6) AS uz, round(CASE WHEN m > 0.05 THEN uy * 0.05 / m ELSE uy END, 6) AS uy, round(CASE WHEN m > 0.05 THEN ux * 0.05 / m ELSE ux END, 6) AS ux, round(m, 6) AS size FROM m", signed=('uz', 'uy', 'ux'))
def clamp_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    f = T.fields(spark, sf)
    return rounded(f.select("subject", *AXES, *S.clamp(VECTOR, 0.05), S.magnitude(*VECTOR).alias("size")), *VECTOR, "size")


@query(f"WITH {FIELDS} SELECT subject, z, y, x, round(uy / (9.5 * 0.05), 9) AS gy, round(ux / (12.0 * 0.05), 9) AS gx, round(uy, 9) AS uy FROM fields", signed=('gy', 'gx', 'uy'))
def grid_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Millimetres to [-1, 1] grid units and back."""
    f = T.fields(spark, sf)
    f = f.select("subject", *AXES, S.mm_to_grid("uy", 20, SPACING).alias("gy"), S.mm_to_grid("ux", 25, SPACING).alias("gx"))
    return rounded(f.withColumn("uy", S.grid_to_mm("gy", 20, SPACING)), "gy", "gx", "uy", digits=9)


# --- neighbourhoods ---------------------------------------------------------------------------------------------


def _gradient_sql(source: str, keys: str, values: tuple[str, ...], spacing: float) -> str:
    over = lambda a: f"OVER (PARTITION BY {', '.join([k for k in [keys] if k] + [b for b in AXES if b != a])} ORDER BY {a})"
    one = lambda a, v: f"CASE WHEN lag({v}) {over(a)} IS NULL THEN (lead({v}) {over(a)} - {v}) / {spacing} WHEN lead({v}) {over(a)} IS NULL THEN ({v} - lag({v}) {over(a)}) / {spacing} ELSE (lead({v}) {over(a)} - lag({v}) {over(a)}) / (2 * {spacing}) END AS d{a}_{v}"
    return f"SELECT *, {', '.join(one(a, v) for a in AXES for v in values)} FROM {source}"


_DET = f"""{VOL}, {FIELDS}, {_field_sql(1)}, g AS ({_gradient_sql('f1', '', VECTOR, 0.05)}), det AS (SELECT z, y, x,
(1 + dz_uz) * ((1 + dy_uy) * (1 + dx_ux) - dx_uy * dy_ux) - dy_uz * (dz_uy * (1 + dx_ux) - dx_uy * dz_ux) + dx_uz * (dz_uy * dy_ux - (1 + dy_uy) * dz_ux) AS det FROM g)"""


@query(f"WITH {_DET} SELECT z, y, x, round(det, 6) AS det FROM det", signed=('det',))
def jacobian_det(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.jacobian(T.field(spark, sf), SPACING), "det")


@query(f"WITH {_DET} SELECT round(avg(CASE WHEN det <= 0 THEN 1.0 ELSE 0.0 END), 9) AS folds FROM det")
def fold_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.folds(stencil.jacobian(T.field(spark, sf), SPACING)), "folds", digits=9)


@query(f"WITH {VOL}, {_kernel_sql(1.0)}, {_filter_sql('soft', 'vol')} SELECT z, y, x, round(v, 4) AS v FROM soft")
def gaussian_separable(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.gaussian(T.volume(spark, sf), 1.0, T.shape(spark, sf)), "v", digits=4)


@query(f"WITH {VOL}, {_kernel_sql(1.0)}, {_filter_sql('soft', 'vol')} SELECT CAST(z / 2 AS INT) AS z, CAST(y / 2 AS INT) AS y, CAST(x / 2 AS INT) AS x, round(v, 4) AS v FROM soft WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0")
def decimate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.decimate(T.volume(spark, sf), 2, T.shape(spark, sf)), "v", digits=4)


@query(f"WITH {VOL}, {_kernel_sql(1.0)}, {_filter_sql('soft', 'vol')} SELECT a.z, a.y, a.x, round(greatest(0, a.v + 0.5 * (a.v - s.v)), 4) AS v FROM vol a JOIN soft s ON a.z = s.z AND a.y = s.y AND a.x = s.x")
def unsharp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.unsharp(T.volume(spark, sf), T.shape(spark, sf)), "v", digits=4)


_BOX = "kern AS (SELECT d, 1 / 3.0 AS w FROM (SELECT unnest(range(-1, 2)) AS d))"


@query(f"WITH {VOL}, kern AS (SELECT d, CAST(1 AS DOUBLE) / 3 AS w FROM (SELECT unnest(range(-1, 2)) AS d)), {_filter_sql('soft', 'vol')} SELECT z, y, x, round(v, 4) AS v FROM soft")
def box_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.box_mean(T.volume(spark, sf), 1, T.shape(spark, sf)), "v", digits=4)


@query(f"""WITH {VOL}, two AS (SELECT z, y, x, v, v * v AS s FROM vol), kern AS (SELECT d, CAST(1 AS DOUBLE) / 3 AS w FROM (SELECT unnest(range(-1, 2)) AS d)), {_filter_sql('soft', 'two', values=('v', 's'))}
SELECT a.z, a.y, a.x, round((a.v - m.v) / (sqrt(greatest(m.s - m.v * m.v, 0)) + 1e-6), 4) AS v FROM vol a JOIN soft m ON a.z = m.z AND a.y = m.y AND a.x = m.x""", signed=('v',))
def local_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.local_normalise(T.volume(spark, sf), 1, T.shape(spark, sf)), "v", digits=4)


@query(f"""WITH {VOL}, o AS (SELECT unnest(range(-1, 2)) AS d), n AS (SELECT a.z, a.y, a.x, b.v FROM vol a, dims, o i, o j, o k, vol b WHERE
b.z = CASE WHEN a.z + i.d < 0 THEN -1 - a.z - i.d WHEN a.z + i.d >= nz THEN 2 * nz - 1 - a.z - i.d ELSE a.z + i.d END AND b.y = CASE WHEN a.y + j.d < 0 THEN -1 - a.y - j.d WHEN a.y + j.d >= ny THEN 2 * ny - 1 - a.y - j.d ELSE a.y + j.d END
AND b.x = CASE WHEN a.x + k.d < 0 THEN -1 - a.x - k.d WHEN a.x + k.d >= nx THEN 2 * nx - 1 - a.x - k.d ELSE a.x + k.d END) SELECT z, y, x, list_sort(list(v))[14] AS v FROM n GROUP BY z, y, x""")
def median3(spark: SparkSession, sf: str) -> DataFrame:
    return stencil.median(T.volume(spark, sf), 3, T.shape(spark, sf))


@query(f"""WITH {VOL}, o AS (SELECT unnest(range(-1, 2)) AS d), n AS (SELECT a.z, a.y, a.x, b.v FROM vol a, dims, o i, o j, o k, vol b WHERE i.d * i.d + j.d * j.d + k.d * k.d <= 2 AND
b.z = CASE WHEN a.z + i.d < 0 THEN -1 - a.z - i.d WHEN a.z + i.d >= nz THEN 2 * nz - 1 - a.z - i.d ELSE a.z + i.d END AND b.y = CASE WHEN a.y + j.d < 0 THEN -1 - a.y - j.d WHEN a.y + j.d >= ny THEN 2 * ny - 1 - a.y - j.d ELSE a.y + j.d END
AND b.x = CASE WHEN a.x + k.d < 0 THEN -1 - a.x - k.d WHEN a.x + k.d >= nx THEN 2 * nx - 1 - a.x - k.d ELSE a.x + k.d END) SELECT z, y, x, list_sort(list(v))[10] AS v FROM n GROUP BY z, y, x""")
def median_ball(spark: SparkSession, sf: str) -> DataFrame:
    """The median over a voxel and its 18 nearest neighbours."""
    return stencil.median_ball(T.volume(spark, sf), T.shape(spark, sf))


@query(f"WITH {VOL} SELECT a.z, a.y, a.x, b.v FROM vol a, dims, vol b WHERE b.z = least(greatest(a.z + 1, 0), nz - 1) AND b.y = least(greatest(a.y - 3, 0), ny - 1) AND b.x = least(greatest(a.x + 2, 0), nx - 1)")
def shift_replicate(spark: SparkSession, sf: str) -> DataFrame:
    return stencil.shift(T.volume(spark, sf), (1, -3, 2), T.shape(spark, sf))


@query(f"WITH {VOL} SELECT 'z' AS plane, z, y, x, v FROM vol, dims WHERE z = floor(nz / 2.0) UNION ALL SELECT 'y', z, y, x, v FROM vol WHERE y = 10 UNION ALL SELECT 'x', z, y, x, v FROM vol WHERE x = 12")
def mid_slices(spark: SparkSession, sf: str) -> DataFrame:
    v, shape, out = T.volume(spark, sf), T.shape(spark, sf), None
    for a, n in zip(AXES, shape, strict=True):
        one = v.where(F.col(a) == n // 2).select(F.lit(a).alias("plane"), *AXES, "v")
        out = one if out is None else out.unionByName(one)
    return out


# --- blending and updates ---------------------------------------------------------------------------------------


def _weight_sql(a: str) -> str:
    lo, hi = f"(c.core_{a}0 - c.pad_{a}0)", f"(c.pad_{a}0 + c.pad_n{a} - c.core_{a}0 - c.core_n{a})"
    return (f"(CASE WHEN v.{a} >= c.core_{a}0 AND v.{a} < c.core_{a}0 + c.core_n{a} THEN 1 WHEN v.{a} < c.core_{a}0 THEN 0.5 - 0.5 * cos(pi() * (v.{a} - c.pad_{a}0 + 0.5) / {lo}) "
            f"ELSE 0.5 - 0.5 * cos(pi() * (c.pad_{a}0 + c.pad_n{a} - 1 - v.{a} + 0.5) / {hi}) END)")  # fmt: skip


@query(f"""WITH {VOL}, {FIELDS}, {_field_sql(1)}, {CHUNKS}, e AS (SELECT v.z, v.y, v.x, c.chunk_id, uz + 0.001 * c.chunk_id AS uz, uy - 0.001 * c.chunk_id AS uy, ux AS ux, {' * '.join(map(_weight_sql, AXES))} AS w FROM chunks c JOIN f1 v ON {_INSIDE})
SELECT z, y, x, round(sum(w * uz) / sum(w), 6) AS uz, round(sum(w * uy) / sum(w), 6) AS uy, round(sum(w * ux) / sum(w), 6) AS ux FROM e GROUP BY z, y, x""", signed=('uz', 'uy', 'ux'))
def blend_core(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk results that disagree in their halos, blended into one field."""
    shape = T.shape(spark, sf)
    parts = tiling.halo_expand(T.field(spark, sf), shape, CORE, HALO)
    parts = parts.withColumns({"uz": F.col("uz") + 0.001 * F.col("chunk_id"), "uy": F.col("uy") - 0.001 * F.col("chunk_id")})
    return rounded(blending.blend(parts, shape, CORE, HALO), *VECTOR)


_SUMS = f"{VOL}, {COHORT}, {FIELDS}, sums AS (SELECT v.z, v.y, v.x, coalesce(sum(c.v), 0) AS isum, coalesce(sum(uz), 0) AS sz, coalesce(sum(uy), 0) AS sy, coalesce(sum(ux), 0) AS sx FROM vol v LEFT JOIN coh c ON c.z = v.z AND c.y = v.y AND c.x = v.x LEFT JOIN fields f ON f.subject = c.subject AND f.z = c.z AND f.y = c.y AND f.x = c.x GROUP BY v.z, v.y, v.x)"


@query(f"""WITH {_SUMS}, mean AS (SELECT z, y, x, isum / 7 AS v FROM sums), p AS (SELECT z, y, x, z - 0.25 * sz / 7 / 0.05 AS cz, y - 0.25 * sy / 7 / 0.05 AS cy, x - 0.25 * sx / 7 / 0.05 AS cx FROM sums)
SELECT z, y, x, round(v, 5) AS v FROM ({_gather_sql('p', 'mean', 'z, y, x', ('v',), 'constant')})""")
def recentre_update(spark: SparkSession, sf: str) -> DataFrame:
    """The next template: the mean image, moved against the mean displacement."""
    shape = T.shape(spark, sf)
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("isum", "sz", "sy", "sx")]
    sums = gather.dense(spark, shape).join(blending.accumulate(T.cohort(spark, sf), T.fields(spark, sf)), list(AXES), "left").select(*AXES, *zero)
    return rounded(blending.update(sums, shape, SPACING, 7)[0], "v", digits=5)


@query(f"""WITH {FIELDS}, m AS (SELECT subject, CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(sqrt(uz * uz + uy * uy + ux * ux)) AS m FROM fields GROUP BY ALL)
SELECT z, y, x, round(max(m), 6) AS most, round(avg(0.0), 9) AS gave_up FROM m GROUP BY z, y, x""")
def residual_map(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest residual over subjects, on a lattice."""
    size = T.fields(spark, sf).select("subject", *AXES, S.magnitude(*VECTOR).alias("v"))
    return rounded(stats.over_subjects(pooling.pool(size, 2, keys=("subject",))), "most", "gave_up")


# --- plans ------------------------------------------------------------------------------------------------------

_REPORTS = "days AS (SELECT CAST(ts AS DATE) AS day, quantile_cont(value, 0.99) AS d99, avg(value) AS step FROM events GROUP BY 1), r AS (SELECT CAST(date_diff('day', (SELECT min(day) FROM days), day) AS INT) AS iteration, d99, step FROM days)"
_PLATEAU = f"{_REPORTS}, p AS (SELECT *, coalesce((lag(d99, 2) OVER w - d99 < 0.05 * lag(d99, 2) OVER w) AND iteration >= 3, FALSE) AS plateau FROM r WINDOW w AS (ORDER BY iteration))"


@query(f"WITH {_PLATEAU} SELECT iteration, round(d99, 6) AS d99, plateau FROM p")
def plateau_lag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stopping.plateau(T.pass_reports(spark, sf), "d99", 2, 0.05, 1).select("iteration", "d99", "plateau"), "d99")


@query(f"""WITH {_PLATEAU} SELECT iteration, CASE WHEN d99 < 0.5 * 400 THEN 'residual' WHEN plateau THEN 'plateau' WHEN iteration + 1 >= 20 THEN 'cap' END AS held,
CASE WHEN step < 0.1 * 990 AND (FALSE OR d99 < 480) THEN 'converged' WHEN plateau THEN 'plateau' WHEN iteration + 1 >= 20 THEN 'cap' END AS estimated FROM p""")
def stop_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Why a level would stop, with a held and with an estimated template."""
    p = stopping.plateau(T.pass_reports(spark, sf), "d99", 2, 0.05, 1)
    it, cap, d99, flat = F.col("iteration"), F.lit(20), F.col("d99"), F.col("plateau")
    held = stopping.stop_held(d99, F.lit(480.0), flat, it, cap, F.lit(False), 400.0)
    return p.select("iteration", held.alias("held"), stopping.stop_estimated(d99, F.col("step"), F.lit(480.0), flat, it, cap, F.lit(False), 990.0).alias("estimated"))


@query(f"WITH {_REPORTS} SELECT iteration, round(2.0 * pow(0.25, least(iteration / 9.0, 1.0)), 9) AS sigma FROM r")
def anneal_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.pass_reports(spark, sf).select("iteration", stopping.annealed(F.col("iteration"), 2.0, 0.5, 10).alias("sigma")), "sigma", digits=9)


@query("""WITH l AS (SELECT unnest(range(5)) AS level), g AS (SELECT level, ceil(1920 / pow(2, level)) AS nz, ceil(2560 / pow(2, level)) AS n FROM l), c AS (SELECT level, ceil(nz / 256) * ceil(n / 256) * ceil(n / 256) AS chunks, nz * n * n AS voxels, list_extract([6, 4, 3, 2, 1], CAST(5 - level AS BIGINT)) AS passes FROM g),
w AS (SELECT level, chunks, passes, voxels * (CASE WHEN chunks = 1 THEN 1 ELSE pow(352 / 256.0, 3) END) * 16 * passes * 10 AS work FROM c)
SELECT CAST(level AS INT) AS level, CAST(chunks AS BIGINT) AS chunks, CAST(passes AS BIGINT) AS passes, round(work / 1e9, 3) AS work, CAST(ceil(chunks * 10 / 4) AS BIGINT) AS tasks, round(work / 1.5e6 / 3600, 3) AS gpu_hours, round(work / sum(work) OVER (), 6) AS share FROM w""")
def plan_cost(spark: SparkSession, sf: str) -> DataFrame:
    """What the published example costs: ten volumes of 1920 x 2560 x 2560 voxels, level by level."""
    p = costs.plan(spark, Grid((1920, 2560, 2560), 0.05), costs.Profile(), 10, (6, 4, 3, 2, 1), per_task=4)
    return p.withColumns({"work": F.round(F.col("work") / 1e9, 3), "gpu_hours": F.round("gpu_hours", 3), "share": F.round("share", 6)})


@query("""WITH d AS (SELECT * FROM (VALUES ('a', 20.0), ('b', 40.0), ('c', 80.0), ('d', 160.0)) t(path, voxel_um)), l AS (SELECT DISTINCT CAST(p_size AS INT) AS level, CAST(5 * p_size AS DOUBLE) AS um FROM part WHERE p_size <= 50)
SELECT level, um, coalesce((SELECT path FROM d WHERE voxel_um <= um * (1 + 1e-6) ORDER BY voxel_um DESC LIMIT 1), 'a') AS path FROM l""")
def as_of_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """For each level the coarsest dataset that is no coarser than it."""
    d = spark.createDataFrame([("a", 20.0), ("b", 40.0), ("c", 80.0), ("d", 160.0)], "path string, voxel_um double")
    levels = T.table(spark, sf, "part").where("p_size <= 50").select(F.col("p_size").cast("int").alias("level"), (F.col("p_size") * 5.0).alias("um")).distinct()
    return costs.pick_dataset(levels, d).select("level", "um", "path")


@query(f"""WITH {COHORT}, t AS (SELECT DISTINCT subject, z, y FROM coh), done AS (SELECT DISTINCT subject, z, y FROM coh WHERE v > 45)
SELECT t.subject, t.z, t.y FROM t WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.subject = t.subject AND d.z = t.z AND d.y = t.y)""")
def pending_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks without a completed record."""
    c = T.cohort(spark, sf)
    return costs.pending(c.select("subject", "z", "y").distinct(), c.where("v > 45"), ("subject", "z", "y"))


@query(f"""WITH {VOL}, c AS (SELECT CAST(floor(z / 8.0) AS INT) AS iz, floor(y / 8.0) AS iy, floor(x / 8.0) AS ix, avg(v) AS m FROM vol GROUP BY 1, 2, 3) SELECT count(*) AS chunks, count(*) FILTER (m >= 250000) AS tissue_chunks FROM c""")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many chunks there are, and how many of them a pass would solve."""
    from voxframe.plans.reports import chunk_counts as counts

    return counts(T.volume(spark, sf), CORE, 250000)


@query(f"""WITH {VOL}, l AS (SELECT CAST(unnest(range(3)) AS INT) AS level, nz FROM dims), g AS (SELECT level, CAST(ceil(nz / pow(2, level)) AS INT) AS nz, CAST(ceil(20 / pow(2, level)) AS INT) AS ny, CAST(ceil(25 / pow(2, level)) AS INT) AS nx FROM l),
d AS (SELECT * FROM (VALUES ('b', 10, 13), ('a', 10, 13), ('c', 5, 7), ('x', 1, 1)) t(path, ny, nx)) SELECT g.level, min(d.path) AS path FROM g LEFT JOIN d ON d.ny = g.ny AND d.nx = g.nx GROUP BY g.level""")
def link_by_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Which stored dataset, if any, can stand for each level: the first of the same size."""
    from voxframe.sources.volumes import match_levels

    levels = tiling.grids(spark, Grid(T.shape(spark, sf), SPACING), CORE).where("level < 3")
    sizes = spark.createDataFrame([("b", 10, 13), ("a", 10, 13), ("c", 5, 7), ("x", 1, 1)], "path string, ny int, nx int")
    every = sizes.crossJoin(F.broadcast(levels.select("nz").distinct()))
    whole = spark.range(3).select(F.col("id").cast("int").alias("level")).join(levels, "level", "left")
    return match_levels(whole, every).select("level", "path")


@query(f"""WITH {VOL}, lat AS (SELECT CAST(floor(z / 2.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, avg(v) AS v, max(CASE WHEN z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0 THEN v END) AS w FROM vol GROUP BY 1, 2, 3)
SELECT round(max(abs(v - w)), 6) AS worst FROM lat""")
def pyramid_check(spark: SparkSession, sf: str) -> DataFrame:
    """How far a subsampled level is from the mean of the level below: what tells a pyramid of means from one of samples."""
    v = T.volume(spark, sf)
    picked = v.where("z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0").select(*[F.floor(F.col(a) / 2).cast("int").alias(a) for a in AXES], F.col("v").alias("w"))
    return rounded(pooling.pool(v, 2).join(picked, list(AXES)).agg(F.max(F.abs(F.col("v") - F.col("w"))).alias("worst")), "worst")


@query(f"SELECT date_trunc('day', ts) AS start, {_BIN.format(v='value')} AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The histogram of each day: what the stream keeps as state."""
    from voxframe.streaming.sketches import windowed_histogram as sketch

    return sketch(T.table(spark, sf, "events"), "ts", "value", "1 day")


@query("""WITH l AS (SELECT CAST(o_custkey % 5 AS INT) AS level, count(*) AS chunks, count(*) FILTER (o_totalprice > 150000) AS tissue_chunks FROM orders GROUP BY 1) SELECT level, chunks, tissue_chunks, CAST(level + 1 AS BIGINT) AS passes, round((level + 1) * (tissue_chunks * 30.0 + (chunks - tissue_chunks) * 1.5) / 3600 / 8, 9) AS hours FROM l""")
def estimate_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of each level when chunks with and without tissue cost differently."""
    o = T.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 5).cast("int").alias("level"))
    levels = o.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("o_totalprice") > 150000).alias("tissue_chunks"))
    return rounded(costs.hours(levels.withColumn("passes", (F.col("level") + 1).cast("long")), 30.0, 1.5, 8), "hours", digits=9)


@query(f"""WITH {VOL}, {FIELDS}, {_field_sql(1)}, m AS (SELECT z, y, x, CAST(0.23719 AS DOUBLE) * uz AS uz, CAST(-0.23719 AS DOUBLE) * uy AS uy, CAST(0.23719 AS DOUBLE) * ux AS ux FROM f1), p AS (SELECT *, z + uz / 0.05 AS cz, y + uy / 0.05 AS cy, x + ux / 0.05 AS cx FROM m)
SELECT 1 AS subject, z, y, x, round(uz + guz, 6) AS uz, round(uy + guy, 6) AS uy, round(ux + gux, 6) AS ux FROM ({_gather_sql('p', 'f1', 'z, y, x, uz, uy, ux', VECTOR, 'nearest', hide='g')})""", signed=VECTOR)
def settle_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A subject's field with the template's last motion composed in."""
    f = T.field(spark, sf)
    motion = f.select(*AXES, (0.23719 * F.col("uz")).alias("uz"), (-0.23719 * F.col("uy")).alias("uy"), (0.23719 * F.col("ux")).alias("ux"))
    own = f.select(F.lit(1).alias("subject"), *AXES, *VECTOR)
    return rounded(blending.settled(own, motion, T.shape(spark, sf), SPACING, ("subject",)), *VECTOR)


@query()
def self_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve feature channels of each chunk's padded box, reduced to their mean: arrays inside, one group a chunk."""
    import numpy as np
    import pandas as pd

    from voxframe.engines.features import SelfSimilarity
    from voxframe.session import ship

    ship(spark)
    parts = tiling.halo_expand(T.volume(spark, sf), T.shape(spark, sf), CORE, HALO)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        place = [rows[a].to_numpy() - rows[a].min() for a in AXES]
        box = np.zeros([int(p.max()) + 1 for p in place])
        box[tuple(place)] = rows["v"].to_numpy()
        means = SelfSimilarity()(box).mean((1, 2, 3))
        return pd.DataFrame({"chunk_id": rows["chunk_id"].iloc[0], "channel": np.arange(12, dtype="int32"), "mean": means.round(6)})

    return parts.groupBy("chunk_id").applyInPandas(one, "chunk_id int, channel int, mean double")


@query()
def register_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One pass of the chunk solver on the volume and a copy moved by a voxel: a record for each chunk."""
    from voxframe.plans import config, groupwise

    shape = T.shape(spark, sf)
    fixed = T.volume(spark, sf).withColumn("v", F.col("v") / 300000)
    moving = stencil.shift(fixed, (0, 1, 0), shape).select(F.lit(1).alias("subject"), *AXES, "v")
    still = moving.select("subject", *AXES, *[F.lit(0.0).alias(u) for u in VECTOR])
    run = config.load({"tiling": {"core": 16, "halo": 8}, "solver": {"stages": [{"scales": [1], "iterations": [4]}]}})
    solved = groupwise.register(fixed, moving, still, Grid(shape, SPACING), run, 0, 0, False)
    return solved.where("kind = 'r'").select("chunk_id", "subject", "reason", "retries", F.round("tissue_fraction", 6).alias("tissue_fraction"), F.round("folds", 6).alias("folds"))
