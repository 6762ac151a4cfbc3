"""Volumes, fields and run records carved out of relational tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns of a plane of the volumes; planes follow from the number of keys.
PLANE = (20, 25)
SPACING = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: str) -> list:
    """Voxel coordinates of a dense key."""
    y, x = PLANE
    k = F.col(key)
    return [F.floor(k / (y * x)).cast("int").alias("z"), (F.floor(k / x) % y).cast("int").alias("y"), (k % x).cast("int").alias("x")]


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """The volume's size; one count, answered from Parquet footers."""
    return -(-table(spark, sf_dir, "orders").count() // (PLANE[0] * PLANE[1])), *PLANE


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, v): a dense volume of reals."""
    return table(spark, sf_dir, "orders").select(*place("o_orderkey"), F.col("o_totalprice").alias("v"))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, z, y, x, v): sparse volumes of seven subjects."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_orderkey").agg(F.avg("l_quantity").alias("v"))
    return lines.select(F.col("l_linenumber").alias("subject"), *place("l_orderkey"), "v")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, z, y, x, uz, uy, ux): a displacement (mm) for each voxel of the cohort; missing ones are 0."""
    means = [(F.avg("l_discount") - 0.05).alias("uz"), (F.avg("l_tax") - 0.04).alias("uy"), ((F.avg("l_quantity") - 25.5) / 250).alias("ux")]
    lines = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_orderkey").agg(*means)
    return lines.select(F.col("l_linenumber").alias("subject"), *place("l_orderkey"), "uz", "uy", "ux")


def field(spark: SparkSession, sf_dir: str, subject: int = 1) -> DataFrame:
    """(z, y, x, uz, uy, ux) of one subject on every voxel, 0 where it has none."""
    from voxframe.functions.scalar import AXES, VECTOR
    from voxframe.operators.gather import dense

    one = fields(spark, sf_dir).where(F.col("subject") == subject).drop("subject")
    return dense(spark, shape(spark, sf_dir)).join(one, list(AXES), "left").select(*AXES, *[F.coalesce(u, F.lit(0.0)).alias(u) for u in VECTOR])


def pass_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iteration, d99, step): one run record a day of events."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.percentile("value", F.lit(0.99)).alias("d99"), F.avg("value").alias("step"))
    first = days.agg(F.min("day").alias("first"))
    return days.crossJoin(F.broadcast(first)).select(F.datediff("day", "first").alias("iteration"), "d99", "step")
