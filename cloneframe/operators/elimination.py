"""Ordered elimination: what falls by a standing node falls, and what has fallen fells no other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneframe.plans.scratch import Scratch, keep

SALTS = 8  # tasks over which the references of one key are dealt
WALKED = 200_000


def tasks(n: int) -> int:
    """Tasks of a join of n rows with each other, whose work is in its pairs and not in the size of its rows."""
    return 1 + min(n // 500, 399)


def fallen(links: DataFrame, walked: int = WALKED) -> DataFrame:
    """(node) of the b that a standing a fells; links (a, b) are distinct, and a comes before b in the order of nodes.

    In rounds: what no link ends at stands, what it links to falls, and the links of both go. `walked` links or fewer
    are walked in order on the driver, so long chains of few links need no round each.
    """
    spark = links.sparkSession
    scratch = Scratch(spark)
    links = scratch.put("0", links.select("a", "b"))
    kind = links.schema["b"].dataType.simpleString()
    out = spark.createDataFrame([], f"node {kind}")
    n = 0
    while links.limit(walked + 1).count() > walked:
        ends = links.select(F.col("b").alias("a")).distinct()
        heads = scratch.put(f"heads{n}", links.select("a").distinct().join(ends, "a", "left_anti"))
        gone = scratch.put(f"gone{n}", links.join(heads, "a", "left_semi").select("b").distinct())
        out = out.unionByName(gone.withColumnRenamed("b", "node"))
        settled = heads.unionByName(gone.withColumnRenamed("b", "a"))
        links = scratch.put(str(n + 1), links.join(settled, "a", "left_anti").join(gone, "b", "left_anti").select("a", "b"))
        scratch.drop(str(n), f"heads{n}")
        n += 1
    last = set()
    for a, b in links.orderBy("a", "b").collect():  # of checked size
        if a not in last:
            last.add(b)
    out = keep(out.unionByName(spark.createDataFrame([(x,) for x in last], f"node {kind}")))
    scratch.drop()
    return out
