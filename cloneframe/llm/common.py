"""What the operators share besides the library's scratch tables: keys of rows, and keys that repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneframe.plans.scratch import Scratch, keep, scratch_path

__all__ = ["Scratch", "fresh", "keep", "map_arrow", "repeated", "row_key", "scratch_path"]


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[tuple[str, str]]) -> DataFrame:
    """mapInArrow for columns of any name, in which that of PySpark has no dots. fields: names and types that run returns."""
    names = df.columns

    def plain(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(pa.RecordBatch.from_arrays(x.columns, names=names) for x in it):
            yield pa.RecordBatch.from_arrays(b.columns, names=[f"o{i}" for i in range(len(fields))])

    out = df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(plain, ", ".join(f"o{i} {kind}" for i, (_, kind) in enumerate(fields)))
    return out.toDF(*(name for name, _ in fields))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Key of a row by id and text. Equal rows share it, as their results are equal; rows of one id with other texts do not."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The keys with two rows or more. Counts combine in the map tasks, so a hot key costs a row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)
