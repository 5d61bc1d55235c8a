"""Expression counts, allele usage and co-expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloneframe.functions.names import call_column, gene_of, natural_key
from cloneframe.operators import filters

HETEROZYGOUS = 0.1


def tallies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def most_common(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The most frequent value, the smallest of equals."""
    return df.groupBy(*(by or [])).agg(F.mode(column, True).alias(column))


def called(df: DataFrame, gene_type: str) -> DataFrame:
    return df.filter(F.coalesce(call_column(gene_type), F.lit("")) != "")


def expression_counts(df: DataFrame, gene_type: str, genes: DataFrame | None = None, **d_filters) -> DataFrame:
    """(gene, count), in natural order of use; with genes (column name) just those, zeros kept."""
    call = call_column(gene_type)
    counts = tallies(called(filters.expression(df, gene_type, **d_filters), gene_type), call).withColumnRenamed(call, "gene")
    if genes is not None:
        counts = genes.select(F.col("name").alias("gene")).distinct().join(counts, "gene", "left").select("gene", F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    return counts


def allele_ratio(counts: DataFrame, least: float) -> DataFrame:
    """Alleles with at least this share of their gene's most frequent one."""
    top = F.max("count").over(Window.partitionBy(gene_of(F.col("gene"))))
    return counts.withColumn("_top", top).filter(F.coalesce(F.try_divide("count", "_top"), F.lit(0.0)) >= least).drop("_top")


def in_natural_order(counts: DataFrame, column: str = "gene") -> DataFrame:
    return counts.orderBy(natural_key(F.col(column)), column)


def allele_matrix(df: DataFrame, x: str, y: str, alleles: list[str], order: list[str] | None = None, **limits) -> DataFrame:
    """Row per gene of type x, column per allele of type y: rows with both. Genes without any keep a row of zeros."""
    a, b = call_column(x), call_column(y)
    rows = called(filters.allele_usage(df, x, y, **limits), x)
    table = rows.groupBy(F.col(a).alias("gene")).agg(*(F.count_if(F.col(b) == n).alias(n) for n in alleles))
    if order is None:
        return table
    place = F.create_map(*(F.lit(v) for i, n in enumerate(order) for v in (n, i)))
    number = F.coalesce(F.try_to_number(F.substring_index(F.col("gene"), "*", -1), F.lit("9999999")).cast("long"), F.lit(0).cast("long"))
    return table.orderBy(F.coalesce(place[gene_of(F.col("gene"))], F.lit(1_000_000)), number, "gene")


def allele_totals(df: DataFrame, y: str) -> DataFrame:
    return tallies(called(df, y), call_column(y)).withColumnRenamed(call_column(y), "allele")


def expression_by_gene(df: DataFrame, gene_type: str) -> DataFrame:
    """(gene, allele, count) of alleles with a tenth or more of their gene's most frequent one."""
    call = call_column(gene_type)
    counts = tallies(called(df, gene_type), call).select(gene_of(F.col(call)).alias("gene"), F.col(call).alias("allele"), "count")
    top = F.max("count").over(Window.partitionBy("gene"))
    return counts.withColumn("_top", top).filter(F.col("count") >= HETEROZYGOUS * F.col("_top")).drop("_top")


def heterozygous(expressed: DataFrame, most: int = 5) -> DataFrame:
    """(gene, alleles, total) of genes with two alleles, the most expressed first."""
    pairs = expressed.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "allele"))).alias("a"), F.sum("count").alias("total")).filter(F.size("a") == 2)
    return pairs.orderBy(F.desc("total"), "gene").limit(most).select("gene", F.transform("a", lambda x: x["allele"]).alias("alleles"), "total")


def coexpression(df: DataFrame, one: str, two: str) -> DataFrame:
    a, b = call_column(one), call_column(two)
    return called(called(df, one), two).groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))
