"""Clonotypes: reads of one V and J whose CDR3s are chained by few mismatches.

Distinct (V, J, CDR3) triples are linked, not reads. CDR3s of one length within m mismatches agree in one of m + 1
slices (pigeonhole), so an equi-join on (V, J, length, slice) finds every link, and the distance confirms it. Chains
become clonotypes by distributed components; no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneframe.functions.sequence import edit_distance, hamming
from cloneframe.operators.components import components


def slices(s: Column, parts: int) -> Column:
    """Array of (slice number, text), the slices as even as can be."""
    n = F.length(s)
    bound = lambda i: F.floor(n * i / parts).cast("int")
    return F.array(*(F.struct(F.lit(i).alias("part"), F.substring(s, bound(i) + 1, bound(i + 1) - bound(i)).alias("text")) for i in range(parts)))


def hamming_links(nodes: DataFrame, by: list[str], text: str, key: str, most: int) -> DataFrame:
    """(a, b) keys of nodes with equal `by` and texts of one length with at most `most` mismatches; a < b."""
    cut = nodes.select(*by, text, key, F.length(text).alias("_n"), F.explode(slices(F.col(text), most + 1)).alias("_s")).select("*", "_s.part", F.col("_s.text").alias("_t")).drop("_s")
    right = cut.withColumnsRenamed({text: "_text", key: "_key"})
    pairs = cut.join(right, [*by, "_n", "part", "_t"]).filter((F.col(key) < F.col("_key")) & (hamming(F.col(text), F.col("_text")) <= most))
    return pairs.select(F.col(key).alias("a"), F.col("_key").alias("b")).distinct()


def edit_links(nodes: DataFrame, by: list[str], text: str, key: str, most: int) -> DataFrame:
    """(a, b) keys of nodes with equal `by` and texts within `most` edits.

    Of the shorter text's most + 1 slices one stands in the longer text, moved by no more places than there are edits
    before it and, counted from the end, after it. So the longer one's pieces at those few places meet the slices.
    """
    one = nodes.select(*by, F.col(text).alias("_text"), F.col(key).alias("_key"), F.length(text).alias("_m"))
    short = one.select(*by, "_text", "_key", F.col("_m").alias("_n"), F.explode(slices(F.col("_text"), most + 1)).alias("_s"))
    short = short.select(*by, "_n", F.col("_s.part").alias("_part"), F.col("_s.text").alias("_piece"), F.col("_text").alias("_short"), F.col("_key").alias("_a"))
    part, n, m = F.col("_part"), F.col("_n"), F.col("_m")
    begin, end = (F.floor(n * (part + i) / (most + 1)).cast("int") for i in (0, 1))
    low = F.greatest(F.lit(0), begin - part, begin + m - n - (most - part))
    high = F.least(m - (end - begin), begin + part, begin + m - n + (most - part))
    long = one.withColumn("_n", F.explode(F.sequence(F.greatest(F.lit(0), m - most), m))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(most))))
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    long = long.select(*by, "_n", "_part", "_text", "_key", (end - begin).alias("_size"), F.explode(places).alias("_at"))
    long = long.select(*by, "_n", "_part", F.substring("_text", F.col("_at") + 1, F.col("_size")).alias("_piece"), "_text", "_key").distinct()
    pairs = short.join(long, [*by, "_n", "_part", "_piece"]).filter(F.col("_a") != F.col("_key"))
    pairs = pairs.select(F.least("_a", "_key").alias("a"), F.greatest("_a", "_key").alias("b"), "_short", "_text").dropDuplicates(["a", "b"])
    return pairs.filter(edit_distance(F.col("_short"), F.col("_text"), most) <= most).select("a", "b")


def linked(nodes: DataFrame, links: DataFrame, key: str, name: str) -> DataFrame:
    """nodes with the smallest key of their component as column name."""
    found = components(links).withColumnsRenamed({"node": key, "component": name})
    return nodes.join(found, key, "left").withColumn(name, F.coalesce(name, key))


def members(df: DataFrame, mismatches: int = 1, order: str = "row_id") -> DataFrame:
    """df's rows that have V, J and CDR3, with clonotype_id: the smallest `order` among the clonotype's rows."""
    need = ("v_call", "j_call", "cdr3")
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"clonotypes need columns {missing}")
    rows = df.filter(" and ".join(f"coalesce({c}, '') <> ''" for c in need))
    nodes = rows.groupBy(*need).agg(F.min(order).alias("_node"))
    links = hamming_links(nodes, ["v_call", "j_call"], "cdr3", "_node", mismatches)
    return rows.join(linked(nodes, links, "_node", "clonotype_id").drop("_node"), list(need))


def call(df: DataFrame, mismatches: int = 1, order: str = "row_id") -> DataFrame:
    """Row per clonotype: its row of least V_SHM (the first of equals), clonotype_id and clonotype_size."""
    found = members(df, mismatches, order)
    rate = F.coalesce("V_SHM", F.lit(0.0)) if "V_SHM" in df.columns else F.lit(0.0)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    best = found.groupBy("clonotype_id").agg(F.min_by(row, F.struct(rate, F.col(order))).alias("r"), F.count(F.lit(1)).alias("clonotype_size"))
    return best.select("clonotype_id", "clonotype_size", *(F.col(f"r.`{c}`") for c in df.columns))


def by_size(clonotypes: DataFrame) -> DataFrame:
    return clonotypes.orderBy(F.desc("clonotype_size"), "clonotype_id")


def divergence(df: DataFrame, mismatches: int = 1, order: str = "row_id", most_shm: float = 5.0) -> DataFrame:
    """members and CDR3_nt_mindiffrate: percent of edits of the CDR3 against that of the clonotype's least mutated
    row; NaN for single reads and where that row has more than most_shm."""
    found = members(df, mismatches, order)
    best = found.groupBy("clonotype_id").agg(F.min_by(F.struct("cdr3", "V_SHM"), F.struct("V_SHM", order)).alias("r"), F.count(F.lit(1)).alias("_n"))
    rate = 100.0 * F.levenshtein(F.col("cdr3"), F.col("r.cdr3")) / F.length("r.cdr3")
    known = (F.col("_n") > 1) & (F.col("r.V_SHM") <= most_shm)
    return found.join(best, "clonotype_id").withColumn("CDR3_nt_mindiffrate", F.when(known, rate).otherwise(F.lit(float("nan")))).drop("r", "_n")


def count_by_edits(df: DataFrame, by: list[str], edits: int = 6) -> DataFrame:
    """(by.., clonotypes): chains of CDR3s of one J within so many edits; empty CDR3s do not count."""
    rows = df.filter("coalesce(cdr3, '') <> ''")
    nodes = rows.groupBy(*by, "j_call", "cdr3").agg(F.min("row_id").alias("_node"))
    found = linked(nodes, edit_links(nodes, [*by, "j_call"], "cdr3", "_node", edits), "_node", "_root")
    return found.groupBy(*by).agg(F.count_distinct("_root").alias("clonotypes"))
