"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two key-min aggregations (combined in the map tasks) joined back on the key, so a hub with very many
links costs a row per task in the first and is split by the skew join in the second. Rounds end once a round changes
nothing; edges then point from each node to the smallest of its component. No state leaves the executors but a count
and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneframe.plans.scratch import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    other = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(other)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node with a link to another; component is the smallest node reachable. Loops,
    repeated edges and either direction are fine; edges with a null end are ignored; no edges give no rows."""
    scratch = Scratch(edges.sparkSession)
    now = scratch.put("edges", edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    mark, turn = None, 0
    while True:
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not n or (n, total) == mark:
            break
        mark = n, total
        name = f"round{turn}"
        step = scratch.put(name, _small_star(_large_star(now)).distinct())
        scratch.drop(*(k for k in list(scratch.paths) if k != name))
        now, turn = step, turn + 1
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
