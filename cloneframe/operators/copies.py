"""Dereplication, and correction of amplification bias by barcode groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneframe.functions import sequence as seq
from cloneframe.functions.names import group_header
from cloneframe.operators.clonotypes import hamming_links
from cloneframe.operators.components import components
from cloneframe.operators.consensus import column_consensus, star_rows
from cloneframe.plans.scratch import keep

LENGTH_STEP = 2
CONSENSUS_LEAST, CONSENSUS_SHARE = 3, 0.501


def dereplicate(reads: DataFrame, barcode_length: int = 0, trim_g: bool = False, min_length: int = 0, order: str = "ord") -> DataFrame:
    """(barcode, sequence, name, size, first): one row per barcode and sequence, with the first read's name."""
    rows = reads.filter(F.length("sequence") >= min_length)
    barcode, rest = seq.barcode_of_copy(F.col("sequence"), barcode_length)
    rows = rows.select("name", order, barcode.alias("barcode"), (seq.trim_leading_g(rest) if trim_g else rest).alias("sequence"))
    return rows.groupBy("barcode", "sequence").agg(F.min_by("name", order).alias("name"), F.count(F.lit(1)).alias("size"), F.min(order).alias("first"))


def dereplicated_header() -> Column:
    return F.concat("name", F.lit(";barcode="), "barcode", F.lit(";size="), F.col("size").cast("string"), F.lit(";"))


def trim_g(reads: DataFrame) -> DataFrame:
    """Reads without their leading G run; what is empty then goes."""
    return reads.withColumn("sequence", seq.trim_leading_g(F.col("sequence"))).filter("sequence <> ''")


def barcoded(reads: DataFrame, barcode_length: int, trim_g: bool = False, min_length: int = 0, cdr3: Column | None = None) -> DataFrame:
    """(ord, name, barcode, sequence, cdr3) of reads of min_length or more, which is tested before the barcode goes."""
    barcode, rest = seq.barcode_of_group(F.col("sequence"), barcode_length)
    rows = reads.filter(F.length("sequence") >= min_length).select("ord", "name", barcode.alias("barcode"), (seq.trim_leading_g(rest) if trim_g else rest).alias("sequence"))
    return rows if cdr3 is None else rows.withColumn("cdr3", cdr3).filter("cdr3 <> ''")


def length_sessions(rows: DataFrame, by: list[str], step: int = LENGTH_STEP) -> DataFrame:
    """rows with session: 1, 2 .. along ascending length, a new one where the length grows by more than step."""
    order = Window.partitionBy(*by).orderBy(F.length("sequence"), "ord")
    jump = F.when(F.length("sequence") - F.lag(F.length("sequence")).over(order) > step, 1).otherwise(0)
    return rows.withColumn("_jump", jump).withColumn("session", 1 + F.sum("_jump").over(order)).drop("_jump")


def cdr3_groups(rows: DataFrame) -> DataFrame:
    """rows with group: CDR3s of a barcode chained by one mismatch (the smallest ord of the chain)."""
    nodes = rows.groupBy("barcode", "cdr3").agg(F.min("ord").alias("_node"))
    found = components(hamming_links(nodes, ["barcode"], "cdr3", "_node", 1)).withColumnsRenamed({"node": "_node", "component": "_root"})
    nodes = nodes.join(found, "_node", "left").select("barcode", "cdr3", F.coalesce("_root", "_node").alias("group"))
    return rows.join(nodes, ["barcode", "cdr3"])


def representatives(rows: DataFrame, by: list[str], consensus: bool = True) -> DataFrame:
    """(by.., name, sequence, size): the first read of a group; of three or more, the column consensus of its aligned
    reads unless it has N. Those are named consensus1, consensus2 .. in the order of `by`."""
    one = rows.groupBy(*by).agg(F.min_by("name", "ord").alias("name"), F.min_by("sequence", "ord").alias("_first"), F.count(F.lit(1)).alias("size"))
    if not consensus:
        return one.withColumnRenamed("_first", "sequence")
    big = rows.join(one.filter(F.col("size") >= CONSENSUS_LEAST).select(*by), by, "left_semi")
    made = column_consensus(star_rows(big, by, "sequence", "ord"), by, "aligned", CONSENSUS_SHARE, "N")
    # places in the order, from the places in each part of it
    named = keep(made.filter(~F.contains("consensus", F.lit("N"))).repartitionByRange(*by).sortWithinPartitions(*by).select(*by, "consensus", F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33)
    sizes = named.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    named = named.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_place", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1)
    out = one.join(named.select(*by, "consensus", "_place"), by, "left")
    return out.select(*by, F.coalesce(F.concat(F.lit("consensus"), F.col("_place").cast("string")), "name").alias("name"), F.coalesce("consensus", "_first").alias("sequence"), "size")


def group_reads(reads: DataFrame, barcode_length: int, cdr3: Column | None = None, trim_g: bool = False, min_length: int = 0, consensus: bool = True) -> DataFrame:
    """(header, sequence, size) per barcode, or per barcode, CDR3 chain and length session."""
    rows = barcoded(reads, barcode_length, trim_g, min_length, cdr3)
    if cdr3 is None:
        out = representatives(rows, ["barcode"], consensus)
        return out.select(group_header(F.col("name"), F.col("barcode"), F.col("size")).alias("header"), "sequence", "size")
    rows = length_sessions(cdr3_groups(rows), ["barcode", "group"])
    out = representatives(rows, ["barcode", "group", "session"], consensus)
    first = rows.groupBy("barcode", "group", "session").agg(F.min_by("cdr3", "ord").alias("cdr3"))
    out = out.join(first, ["barcode", "group", "session"])
    return out.select(group_header(F.col("name"), F.col("barcode"), F.col("size"), F.col("cdr3")).alias("header"), "sequence", "size")
