"""Overlapping windows: results that do not depend on how rows are dealt to files and partitions."""

import duckdb
from pyspark.sql import functions as F

from voxframe.plans import more_queries, queries

#: Fourteen planes, in which 64 voxels less their window's mean lie halfway between two roundings.
ORDERS = "/root/testdata/sf0.1/orders.parquet"
ROWS = 7000


def test_rows_in_any_order(spark, tmp_path):
    """To the last digit the SQL's result on rows in order of their keys."""
    rows, mixed = spark.read.parquet(ORDERS).where(F.col("o_orderkey") < ROWS), F.hash("o_orderkey")
    rows.repartitionByRange(7, mixed).sortWithinPartitions(mixed).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{ORDERS}' WHERE o_orderkey < {ROWS}")
    want = con.sql(f"SELECT z, y, x, v FROM ({queries.ORACLES['sliding_windows']})").fetchall()
    got = more_queries.sliding_windows(spark, str(tmp_path)).select("z", "y", "x", "v").collect()
    assert sorted(map(tuple, got)) == sorted(want)
