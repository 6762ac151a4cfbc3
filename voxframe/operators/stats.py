"""Mergeable histograms, percentiles and other reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.scalar import AXES, BINS, log_bin, upper_edge

#: Cells that values are counted in on the way to exact quantiles.
CELLS = 4096


def histogram(rows: DataFrame, value: Column | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, n): counts by logarithmic bin, at most 256 rows a key; merged by adding n."""
    return rows.groupBy(*keys, log_bin(value).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merged(histograms: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One histogram for each key from any number of partial ones."""
    return histograms.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def percentile(histograms: DataFrame, q: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, value): the upper edge of the first bin at which the running count reaches q percent.

    Deliberately no smaller than the exact percentile; an empty histogram gives no row. The window runs over
    the 256 bins of a key, not over the values.
    """
    order = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    run = histograms.withColumn("cum", F.sum("n").over(order)).withColumn("total", F.sum("n").over(whole))
    first = run.where(F.col("cum") >= q / 100.0 * F.col("total")).groupBy(*keys).agg(F.min("bin").alias("bin"))
    return first.select(*keys, "bin", F.when(F.col("bin") >= BINS - 1, F.lit(1e3)).otherwise(upper_edge("bin")).alias("value"))


def exact_quantiles(rows: DataFrame, value: Column | str, qs: tuple[float, ...], keys: tuple[str, ...] = (), cells: int = CELLS) -> DataFrame:
    """(keys, p): exact quantiles, interpolated between neighbouring values, as an array in the order of qs.

    Values are counted in `cells` even cells between a key's least and greatest value, partially before the
    shuffle; the counts tell in which cells the wanted ranks lie, and only the values of those are sorted.
    So no task holds a key's values, however many there are.
    """
    k = list(keys) or ["_one"]
    named = rows.select(*[F.col(c) for c in keys], (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v IS NOT NULL")
    named = named if keys else named.withColumn("_one", F.lit(1))
    ends = named.groupBy(*k).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count(F.lit(1)).alias("_n"))
    width = (F.col("_b") - F.col("_a")) / cells
    placed = named.join(F.broadcast(ends), k).withColumn("_c", F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_a")) / width), F.lit(cells - 1))).otherwise(F.lit(0)))
    order = Window.partitionBy(*k).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*k, "_c").agg(F.count(F.lit(1)).alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(order), F.lit(0)))
    wanted = F.array(*[x for q in qs for x in (F.floor(F.lit(q) * (F.col("_n") - 1)), F.ceil(F.lit(q) * (F.col("_n") - 1)))])
    ranks = ends.select(*k, F.explode(F.array_distinct(wanted)).alias("_rank"))
    cellsof = counts.join(F.broadcast(ranks), k).where("_rank >= _before AND _rank < _before + _m").select(*k, "_c", "_before").distinct()
    inside = Window.partitionBy(*k, "_c").orderBy("_v")
    few = placed.join(F.broadcast(cellsof), [*k, "_c"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    met = few.join(F.broadcast(ranks), [*k, "_rank"]).groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two ranks a quantile
    out = met.join(F.broadcast(ends.select(*k, "_n")), k)
    part = [(F.lit(q) * (F.col("_n") - 1)) for q in qs]
    of = lambda r: F.element_at("_at", r)
    return out.select(*keys, F.array(*[of(F.floor(h)) + (h - F.floor(h)) * (of(F.ceil(h)) - of(F.floor(h))) for h in part]).alias("p"))


def intensity_window(rows: DataFrame, value: str = "v", low: float = 0.5, high: float = 99.5, keys: tuple[str, ...] = (), mask_frac: float = 0.0) -> DataFrame:
    """(keys, low, high): exact percentiles, interpolated; of values above mask_frac of the greatest one, if given."""
    if mask_frac:
        top = rows.groupBy(*keys).agg(F.max(value).alias("top"))
        rows = (rows.join(F.broadcast(top), list(keys)) if keys else rows.crossJoin(F.broadcast(top))).where(F.col(value) > mask_frac * F.col("top"))
    p = exact_quantiles(rows, value, (low / 100, high / 100), keys)
    ends = rows.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    out = p.join(ends, list(keys)) if keys else p.crossJoin(F.broadcast(ends))
    flat = F.col("p")[1] <= F.col("p")[0]
    return out.select(*keys, F.when(flat, F.col("least")).otherwise(F.col("p")[0]).alias("low"), F.when(flat, F.col("most") + 1e-6).otherwise(F.col("p")[1]).alias("high"))


# A voxel is tissue above the greater of FLOOR and SHARE of the greatest value.
FLOOR, SHARE = 0.02, 0.05


def tissue_fraction(voxels: DataFrame, keys: tuple[str, ...], value: str = "v", threshold: float = 0.0, floor: float = FLOOR, share: float = SHARE) -> DataFrame:
    """(keys, tissue): the share of a group's voxels above the threshold, or above max(floor, share of the greatest)."""
    top = voxels.groupBy(*keys).agg(F.max(value).alias("top"), F.count(F.lit(1)).alias("all"))
    limit = F.lit(float(threshold)) if threshold > 0 else F.greatest(F.lit(floor), share * F.col("top"))
    return voxels.join(top, list(keys)).groupBy(*keys).agg(F.avg((F.col(value) > limit).cast("double")).alias("tissue"))


def dice(voxels: DataFrame, a: Column, b: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, dice): twice the common voxels over the sum of both."""
    one = lambda c: F.sum(c.cast("long"))
    return voxels.groupBy(*keys).agg((2.0 * one(a & b) / (one(a) + one(b))).alias("dice"))


def centre_of_mass(voxels: DataFrame, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cz, cy, cx): the mean position weighted by what is positive of the value."""
    w = F.greatest(F.col(value), F.lit(0.0))
    return voxels.groupBy(*keys).agg(*[(F.sum(w * F.col(a)) / F.sum(w)).alias("c" + a) for a in AXES])


def over_subjects(voxels: DataFrame, value: str = "v") -> DataFrame:
    """(z, y, x, most, gave_up): the greatest value over subjects, NaN aside, and the share of NaN."""
    gone = F.isnan(value)
    return voxels.groupBy(*AXES).agg(F.max(F.when(~gone, F.col(value))).alias("most"), F.avg(gone.cast("double")).alias("gave_up"))


def covariance(vectors: DataFrame, column: str, n: int) -> DataFrame:
    """(i, j, cov): the population covariance of n channels, from one pass of partial sums; i <= j.

    Each row makes its n * (n + 1) / 2 products, which are added up before the shuffle.
    """
    x = vectors.select(F.transform(column, lambda v: v.cast("double")).alias("x"))
    pairs = x.select("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("x", "i", F.explode(F.sequence(F.col("i"), F.lit(n - 1))).alias("j"))
    a, b = F.element_at("x", F.col("i") + 1), F.element_at("x", F.col("j") + 1)
    s = pairs.groupBy("i", "j").agg(F.sum(a * b).alias("ab"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.count(F.lit(1)).alias("n"))
    return s.select("i", "j", (F.col("ab") / F.col("n") - F.col("a") / F.col("n") * F.col("b") / F.col("n")).alias("cov"))


def participation(cov: DataFrame) -> DataFrame:
    """(ratio): how many channels take part, (sum of eigenvalues)^2 / sum of their squares, without an eigensolver.

    The trace and the squared Frobenius norm of the covariance are those sums.
    """
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("cov")).otherwise(0.0))
    square = F.sum(F.col("cov") * F.col("cov") * F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0))
    return cov.agg((trace * trace / square).alias("ratio"))


def collected(records: DataFrame, blends: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What a pass reports: skipped for lack of tissue, gave up on folds, retries, and the greatest fold share."""
    a = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("reason") == "tissue").alias("skipped"), F.count_if(F.col("reason") == "folds").alias("seeded_folds"), F.sum("retries").alias("retries"))
    b = blends.groupBy(*keys).agg(F.max("folds").alias("fold_frac"))
    return a.join(b, list(keys), "left")
