"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

All steps are grouped minima and joins; no neighbourhood is gathered in a task, and nothing but a count and a
checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """``node, root`` for every end of a link (columns ``a, b``): root is the smallest node that can be reached."""
    edges = work.stage(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = work.stage(large, "large")
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        moved = large.join(low, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        after = work.stage(small.distinct(), "small")
        work.drop(edges, large)
        edges = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node either points to one root or is one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)")
    return not odd.take(1)
