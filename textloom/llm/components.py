"""Connected components of a link table, by alternating large and small stars until nothing changes.

Links and components stay distributed. Every round is written to the shared folder, which cuts the lineage and lets a round
survive lost executors. Minima per node are combined before they are shuffled; the join back to the links is a plain
equi-join whose hot nodes adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links point from the larger node u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for every node of links (u, v) that isn't the smallest of its component."""
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges, before = written(ordered, "links"), None
    for _ in range(most_rounds):
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = sign
        edges = written(_small_star(_large_star(edges)), "stars")
    raise RuntimeError(f"components haven't settled after {most_rounds} rounds")
