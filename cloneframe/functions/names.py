"""Gene and record names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gene_of(name: Column) -> Column:
    """The gene of an allele name."""
    return F.substring_index(name, "*", 1)


def same_gene(a: Column, b: Column) -> Column:
    return gene_of(a) == gene_of(b)


def allele_of(name: Column) -> Column:
    """What follows the star; empty without one."""
    return F.when(F.contains(name, F.lit("*")), F.substring(name, F.length(gene_of(name)) + 2, F.length(name))).otherwise("")


def allele_of_header(header: Column) -> Column:
    """Second field of a header with bars, else the whole header."""
    return F.coalesce(F.try_element_at(F.split(header, r"\|"), F.lit(2)), header)


def header_name(header: Column) -> Column:
    return F.substring_index(header, ";", 1)


def _field(header: Column, key: str) -> Column:
    """Last value of a key; null without it."""
    return F.try_element_at(F.regexp_extract_all(header, F.lit(f";{key}=([^;]*)"), 1), F.lit(-1))


def header_size(header: Column) -> Column:
    return F.coalesce(_field(header, "size").cast("long"), F.lit(0).cast("long"))


def header_barcode(header: Column) -> Column:
    return F.coalesce(_field(header, "barcode"), F.lit(""))


def group_header(name: Column, barcode: Column, size: Column, cdr3: Column | None = None) -> Column:
    parts = [name, F.lit(";barcode="), barcode, F.lit(";")]
    if cdr3 is not None:
        parts += [F.lit("cdr3="), cdr3, F.lit(";")]
    return F.concat(*parts, F.lit("size="), size.cast("string"), F.lit(";"))


def natural_key(name: Column, width: int = 12) -> Column:
    """Key that orders runs of digits by value: each is padded with zeros."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")


def call_column(gene_type: str) -> str:
    """Column of the calls of V, D or J."""
    if gene_type not in ("V", "D", "J"):
        raise ValueError(f"gene type {gene_type!r}: V, D or J")
    return f"{gene_type.lower()}_call"


def strip_percent(call: Column) -> Column:
    return F.regexp_replace(call, "^%+", "")
