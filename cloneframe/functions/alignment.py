"""Expressions over gapped alignment rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloneframe.functions.sequence import chars


def errors(germline: Column, query: Column) -> Column:
    """Differing columns over the common length; 0 where a row is empty or missing."""
    n = F.least(F.length(germline), F.length(query))
    both = F.zip_with(chars(F.left(germline, n)), chars(F.left(query, n)), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.coalesce(F.aggregate(both, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")


def coverage(germline: Column, length: Column) -> Column:
    """Percent of the reference that the alignment covers; 0 where there is none."""
    bases = F.length(F.replace(germline, F.lit("-"), F.lit("")))
    return F.when((F.coalesce(length, F.lit(0)) > 0) & (F.length(F.coalesce(germline, F.lit(""))) > 0), 100.0 * bases / length).otherwise(0.0)


def query_position(g_start: Column, q_start: Column, germline: Column, query: Column, target: Column) -> Column:
    """Query bases before the first column at which `target` reference bases are consumed; -1 if it is not covered.

    Starts are one-based, target counts from the reference's first base.
    """
    begin = F.struct((g_start - 1).cast("long").alias("g"), (q_start - 1).cast("long").alias("q"), F.when(g_start - 1 == target, q_start - 1).otherwise(F.lit(-1)).cast("long").alias("at"))
    n = F.least(F.length(germline), F.length(query))
    columns = F.arrays_zip(chars(F.left(germline, n)).alias("x"), chars(F.left(query, n)).alias("y"))

    def step(s: Column, z: Column) -> Column:
        g = s["g"] + F.when(z["x"] == "-", 0).otherwise(1)
        q = s["q"] + F.when(z["y"] == "-", 0).otherwise(1)
        return F.struct(g.cast("long").alias("g"), q.cast("long").alias("q"), F.when(s["at"] >= 0, s["at"]).when(g == target, q).otherwise(F.lit(-1)).cast("long").alias("at"))

    return F.aggregate(columns, begin, step)["at"]


def shm(identity: Column) -> Column:
    """100 - identity; 0 where it is missing."""
    return F.coalesce(F.nanvl(100.0 - identity, F.lit(0.0)), F.lit(0.0))
