"""Columns that the analyses need, added to a rearrangement (AIRR) table.

Germline tables are small (name, sequence); their anchors are computed once and joined by broadcast, everything else
is expressions of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneframe.functions import alignment, cdr3, names
from cloneframe.functions.sequence import translate
from cloneframe.operators.small import small

SEGMENTS = ("V", "D", "J")
LOCI_OF = {"Ig": ("IGH", "IGK", "IGL"), "TCR": ("TRA", "TRB", "TRG", "TRD")}


def _have(df: DataFrame, c: str, default) -> Column:
    return F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)


def aliases(database: DataFrame) -> DataFrame:
    """(alias, name): a gene may be called by its whole header, its first two fields, its allele or its gene."""
    fields = F.split("name", r"\|")
    allele = names.allele_of_header(F.col("name"))
    every = F.array("name", F.array_join(F.slice(fields, 1, 2), "_"), allele, names.gene_of(allele))
    ranked = database.select("name", F.posexplode(every).alias("_r", "alias"))
    return ranked.groupBy("alias").agg(F.min_by("name", F.struct("_r", "name")).alias("name"))


def anchors(database: DataFrame, segment: str, loci: tuple[str, ...]) -> DataFrame:
    """(name, length, locus, anchor): nucleotides before the CDR3 starts (V) or ends (J); no row where it is not found."""
    find = cdr3.start_in_v if segment == "V" else cdr3.end_in_j
    each = F.array(*(F.struct(F.lit(x).alias("locus"), find(F.col("sequence"), x).alias("anchor")) for x in loci))
    return database.select("name", F.explode(each).alias("a")).select("name", "a.locus", "a.anchor").filter("anchor > 0")


def headers(df: DataFrame) -> DataFrame:
    c = F.col("sequence_id")
    return df.withColumns({"count": names.header_size(c), "barcode": names.header_barcode(c), "sequence_id": names.header_name(c)})


def augment(df: DataFrame, v: DataFrame, d: DataFrame, j: DataFrame, sequence_type: str = "Ig") -> DataFrame:
    """df with count, barcode, V/J_SHM, V/D/J_errors and _covered, CDR3 columns, V_CDR3_start, V_nt; calls by allele."""
    have = df.columns
    df = df.withColumns({c: names.strip_percent(F.coalesce(c, F.lit(""))) for c in ("v_call", "d_call", "j_call") if c in have})
    df = headers(df)
    df = df.withColumns({f"{s}_SHM": alignment.shm(_have(df, f"{s.lower()}_identity", None).cast("double")) for s in "VJ"})
    loci = LOCI_OF[sequence_type]
    for s, db in zip(SEGMENTS, (v, d, j), strict=True):
        p = s.lower()
        full = aliases(db).join(db.select("name", F.length("sequence").alias(f"_{p}_len")), "name").select(F.col("alias").alias(f"{p}_call"), F.col("name").alias(f"_{p}_name"), f"_{p}_len")
        df = df.join(small(full, "gene database"), f"{p}_call", "left")
        g = _have(df, f"{p}_germline_alignment", "")
        df = df.withColumns({f"{s}_errors": alignment.errors(g, _have(df, f"{p}_sequence_alignment", "")), f"{s}_covered": alignment.coverage(g, F.coalesce(f"_{p}_len", F.lit(0)))})
        if s != "D":
            at = anchors(db, s, loci).select(F.col("name").alias(f"_{p}_name"), "locus", F.col("anchor").alias(f"_{p}_anchor"))
            df = df.join(small(at, "gene database"), [f"_{p}_name", "locus"], "left")
    df = _cdr3(df)
    df = df.withColumn("V_nt", F.replace(_have(df, "v_sequence_alignment", ""), F.lit("-"), F.lit("")))
    df = df.withColumn("d_support", _have(df, "d_support", float("inf")).cast("double"))
    stop = F.lower(_have(df, "stop_codon", "").cast("string"))
    df = df.withColumn("stop_codon", F.when(stop.isin("t", "true"), "T").when(stop.isin("f", "false"), "F").otherwise(F.upper(stop)))
    short = {f"{p}_call": F.when(F.col(f"{p}_call") == "", "").otherwise(names.allele_of_header(F.coalesce(f"_{p}_name", f"{p}_call"))) for p in "vdj"}
    return df.withColumns(short).drop(*(f"_{p}_{c}" for p in "vdj" for c in ("name", "len", "anchor")))


def _cdr3(df: DataFrame) -> DataFrame:
    n = lambda c: _have(df, c, 0).cast("long")
    s = lambda c: _have(df, c, "")
    at = alignment.query_position(n("v_germline_start"), n("v_sequence_start"), s("v_germline_alignment"), s("v_sequence_alignment"), F.col("_v_anchor"))
    # beyond the aligned part the reference and the read go on side by side
    start = F.when(at < 0, n("v_sequence_end") + F.col("_v_anchor") - n("v_germline_end")).otherwise(at)
    called = (s("v_call") != "") & (s("j_call") != "") & (s("locus") != "") & (s("sequence") != "")
    start = F.when(called & (n("v_germline_start") > 0) & (n("v_sequence_start") > 0) & (F.coalesce("_v_anchor", F.lit(0)) > 0), start)
    stop = alignment.query_position(n("j_germline_start"), n("j_sequence_start"), s("j_germline_alignment"), s("j_sequence_alignment"), F.col("_j_anchor"))
    stop = F.when((n("j_germline_start") > 0) & (n("j_sequence_start") > 0) & (F.coalesce("_j_anchor", F.lit(0)) > 0) & (stop >= 0), stop)
    df = df.withColumns({"_start": start, "_stop": stop})
    good = F.coalesce((F.col("_start") >= 0) & (F.col("_start") + 1 <= F.col("_stop")) & (F.col("_stop") <= F.length("sequence")), F.lit(False))
    cut = F.substring(F.col("sequence"), (F.col("_start") + 1).cast("int"), (F.col("_stop") - F.col("_start")).cast("int"))
    return df.withColumns({
        "V_CDR3_start": F.coalesce(F.col("_start") - n("v_sequence_start") + 1, F.lit(0)).cast("long"),
        "cdr3": F.when(good, cut).otherwise(s("cdr3")),
        "cdr3_aa": F.when(good, translate(cut)).otherwise(s("cdr3_aa")),
        "cdr3_start": F.when(good, F.col("_start") + 1).otherwise(n("cdr3_start")),
        "cdr3_end": F.when(good, F.col("_stop")).otherwise(n("cdr3_end")),
    }).drop("_start", "_stop")
