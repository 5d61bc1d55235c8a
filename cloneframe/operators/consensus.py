"""Column consensus of aligned rows, by aggregation over positions.

Rows are counted per (group, column, base) with map-side combine, so a group of any size spreads over the tasks that
hold its rows; only its columns, as many as its longest row, meet in a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloneframe.functions import kernels
from cloneframe.functions.sequence import chars

# Order of bases among equal counts, columns of the ragged end, and the first share of active rows.
ORDER = "-ACGTN"
RAGGED, ACTIVE = 10, 0.05


def column_consensus(df: DataFrame, by: list[str], aligned: str, threshold: float = 0.7, ambiguous: str = "N") -> DataFrame:
    """(by.., consensus). Short rows end in gaps. From the 3' end on, rows count as active once they have begun, so
    ragged ends do not vote for gaps; a column's most frequent base stands if its share reaches threshold, a gap then
    adds nothing, and any other column is ambiguous."""
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.length(aligned)).alias("_cols"))
    places = df.select(*by, F.posexplode(chars(F.col(aligned))).alias("_pos", "_b"))
    base = F.when(F.col("_b").rlike("^[ACGT-]$"), F.col("_b")).otherwise("N")
    counted = places.groupBy(*by, "_pos").agg(*(F.count_if(base == b).alias(f"_n{i}") for i, b in enumerate(ORDER)))
    t = counted.join(size, by)
    there = sum((F.col(f"_n{i}") for i in range(1, len(ORDER))), F.lit(0))
    t = t.withColumn("_there", there).withColumn("_gap", F.col("_rows") - F.col("_there")).withColumn("_r", F.col("_cols") - 1 - F.col("_pos"))
    running = F.max("_there").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    begun = F.greatest(F.lit(1).cast("long"), F.bround(F.lit(ACTIVE) * F.col("_rows"), 0).cast("long"), running)
    t = t.withColumn("_a", F.when(F.col("_r") <= RAGGED, begun).otherwise(F.col("_rows")))
    t = t.withColumn("_n0", F.greatest(F.lit(0).cast("long"), F.col("_gap") - (F.col("_rows") - F.col("_a"))))
    divisor = F.when(F.col("_r") < RAGGED, F.col("_a")).otherwise(F.col("_rows"))
    best = F.array_max(F.array(*(F.struct(F.col(f"_n{i}").alias("n"), F.lit(-i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(ORDER))))
    t = t.withColumn("_best", best)
    letter = F.when(F.col("_best.n") / divisor >= threshold, F.when(F.col("_best.b") == "-", "").otherwise(F.col("_best.b"))).otherwise(ambiguous)
    made = t.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_pos", letter.alias("c")))).alias("_l"))
    made = made.select(*by, F.array_join(F.transform("_l", lambda x: x["c"]), "").alias("consensus"))
    return size.select(*by).join(made, by, "left").select(*by, F.coalesce("consensus", F.lit("")).alias("consensus"))


def star_rows(df: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """df with column aligned, rows of one length per group: kernels.star_alignment of the rows in `order`, without a
    group in one task. Distinct texts are aligned to the group's center, and the widest gaps before each of the
    center's places are brought together."""
    sizes = df.groupBy(*by, F.length(text).alias("_size")).agg(F.count(F.lit(1)).alias("_n"), F.min_by(text, order).alias("_center"))
    centers = sizes.groupBy(*by).agg(F.max_by("_center", F.struct("_n", "_size")).alias("_center"), F.count(F.lit(1)).alias("_sizes")).filter("_sizes > 1").drop("_sizes")
    rows = df.select(*by, F.col(text).alias("_text")).distinct().join(centers, by)  # groups of one length are aligned as they are
    names = [f"k{i}" for i in range(len(by))]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, by, strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [kernels.align(c, s)[:2] for c, s in zip(pdf["_center"], pdf["_text"], strict=True)]
            wide = [kernels.gap_widths(r, len(c)).tolist() for (r, _), c in zip(made, pdf["_center"], strict=True)]
            yield pdf.assign(_ref=[r for r, _ in made], _row=[q for _, q in made], _wide=wide).drop(columns="_center")

    pairs = rows.select(*(F.col(c).alias(n) for n, c in zip(names, by, strict=True)), "_text", "_center").mapInPandas(run, f"{keys}, _text string, _ref string, _row string, _wide array<long>")
    widest = pairs.select(*names, F.posexplode("_wide").alias("_i", "_w")).groupBy(*names, "_i").agg(F.max("_w").alias("_w"))
    widest = widest.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_w"))), lambda x: x["_w"]).alias("_wide"))  # as long as the center

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(aligned=[kernels.spread(r, q, w) for r, q, w in zip(pdf["_ref"], pdf["_row"], pdf["_wide"], strict=True)])[[*names, "_text", "aligned"]]

    placed = pairs.drop("_wide").join(widest, names).mapInPandas(place, f"{keys}, _text string, aligned string")
    placed = placed.select(*(F.col(n).alias(c) for n, c in zip(names, by, strict=True)), F.col("_text").alias(text), F.col("aligned").alias("_aligned"))
    return df.join(placed, [*by, text], "left").withColumn("aligned", F.coalesce("_aligned", text)).drop("_aligned")
