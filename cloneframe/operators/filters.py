"""Row filters. A filter whose column is absent is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneframe.functions.names import call_column
from cloneframe.sources.config import Preprocessing


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def cascade(df: DataFrame, p: Preprocessing = Preprocessing()) -> list[tuple[str, Column]]:
    """(name, condition) of each preprocessing step, in order."""
    inf, have = F.lit(float("inf")), set(df.columns)
    steps = [("has_vj_assignment", (_text("v_call") != "") & (_text("j_call") != ""))]
    if "stop_codon" in have:
        steps.append(("has_no_stop", _text("stop_codon") == "F"))
    if "v_support" in have:
        steps.append(("good_v_evalue", F.coalesce("v_support", inf) <= p.v_evalue))
    if "V_covered" in have:
        steps.append(("good_v_coverage", F.coalesce("V_covered", F.lit(0.0)) >= p.v_coverage))
    if "J_covered" in have:
        steps.append(("good_j_coverage", F.coalesce("J_covered", F.lit(0.0)) >= p.j_coverage))
    return steps


STAGES = ("has_vj_assignment", "has_no_stop", "good_v_evalue", "good_v_coverage", "good_j_coverage")


def filter_table(df: DataFrame, p: Preprocessing = Preprocessing()) -> DataFrame:
    """Rows that pass every step."""
    for _, keep in cascade(df, p):
        df = df.filter(keep)
    return df


def write_stats(stats: DataFrame, path: str) -> None:
    """The counts as one JSON object, keys in the order of the stages."""
    stats.select(F.to_json(F.struct(*stats.columns))).coalesce(1).write.text(path)


def filter_stats(df: DataFrame, p: Preprocessing = Preprocessing()) -> DataFrame:
    """One row: total, rows left after each step, and those left that have a CDR3; one pass, additive over parts."""
    passed, counts = F.lit(True), {}
    for name, keep in cascade(df, p):
        passed = passed & keep
        counts[name] = F.count_if(passed)
    last = F.count_if(passed)
    for name in STAGES:  # a skipped step keeps what the one before it kept
        counts.setdefault(name, None)
    before, out = F.count(F.lit(1)), []
    for name in STAGES:
        before = counts[name] if counts[name] is not None else before
        out.append(before.alias(name))
    cdr3 = F.count_if(passed & (_text("cdr3") != "")) if "cdr3" in df.columns else F.lit(0).cast("long")
    del last
    return df.agg(F.count(F.lit(1)).alias("total"), *out, cdr3.alias("has_cdr3"))


def zero(df: DataFrame, column: str) -> DataFrame:
    """Rows without an error in column (a missing count is not zero)."""
    return df.filter(F.coalesce(column, F.lit(-1)) == 0) if column in df.columns else df


def good_d(df: DataFrame, evalue: float, coverage: float, errors: bool = True) -> DataFrame:
    """Rows whose D assignment is trusted."""
    if errors:
        df = zero(df, "D_errors")
    if "d_support" in df.columns:
        df = df.filter(F.coalesce("d_support", F.lit(float("inf"))) <= evalue)
    if "D_covered" in df.columns:
        df = df.filter(F.coalesce("D_covered", F.lit(0.0)) >= coverage)
    return df


def allele_usage(df: DataFrame, x: str, y: str, d_evalue: float = 1e-4, d_coverage: float = 65.0) -> DataFrame:
    for g in dict.fromkeys((x, y)):
        df = good_d(df, d_evalue, d_coverage) if g == "D" else zero(df, f"{g}_errors")
    return df


def expression(df: DataFrame, gene_type: str, d_evalue: float | None = None, d_coverage: float = 70.0, d_errors: int | None = None) -> DataFrame:
    call_column(gene_type)
    if gene_type != "D":
        return df
    if d_evalue is not None and "d_support" in df.columns:
        df = df.filter(F.coalesce("d_support", F.lit(float("inf"))) <= d_evalue)
    if "D_covered" in df.columns:
        df = df.filter(F.coalesce("D_covered", F.lit(0.0)) >= d_coverage)
    if d_errors is not None and "D_errors" in df.columns:
        df = df.filter(F.coalesce("D_errors", F.lit(-1)).between(0, d_errors))
    return df


def haplotype(df: DataFrame, d_evalue: float = 1e-4, d_coverage: float = 65.0) -> DataFrame:
    for g in "VJ":
        df = zero(df, f"{g}_errors")
    return good_d(df, d_evalue, d_coverage)


def upstream(df: DataFrame, max_v_errors: float | None = 1.0, limits: dict[str, float] | None = None) -> DataFrame:
    """limits: most of a mutation rate by its column, such as FR1_SHM; missing rates do not pass."""
    inf = F.lit(float("inf"))
    for c, most in ({"V_SHM": max_v_errors} | (limits or {})).items():
        if most is not None and c in df.columns:
            df = df.filter(F.coalesce(c, inf) <= most)
    return df


def restrict(df: DataFrame, names: DataFrame, column: str = "v_call") -> DataFrame:
    """Rows whose call is in names (column name)."""
    return df.join(names.select(F.col("name").alias(column)).distinct(), column, "left_semi")
