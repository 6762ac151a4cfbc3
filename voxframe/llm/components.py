"""Connected components of an edge table, as group-bys and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import removed, staged

#: Rounds after which the loop gives up loudly; their number grows with the logarithm of the longest path.
MOST_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one other, which points at none."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return not twice.limit(1).count() and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of (a, b): the smallest node reachable.

    Alternates large-star and small-star steps: every node is pointed at the smallest of its neighbours,
    from above, then from below. No group is gathered, each step is a minimum for each node and a join
    back, and the edges of a round are written to the shared folder. Loops and repeated edges do no harm.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        new = staged(down, "edges")
        removed(edges.sparkSession, now)
        now = new
    raise RuntimeError("components did not settle")
