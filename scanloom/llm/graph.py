"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that is reachable) for each end of the edges (a, b).

    Alternating large-star and small-star rounds; each halves long chains, and its edges are written, so
    that the plan stays short.  Minima are pre-aggregated before the shuffle; a hub costs no more than its edges.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), small=True)
    while not is_done(now):
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        below = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(below, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").filter("v <> u").distinct()
        now = cut(small, small=True)
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def is_done(edges: DataFrame) -> bool:
    """Whether each v has one u, and no u is a v: then the edges are stars."""
    several = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    inner = edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
    return not several.count() and not inner.count()
