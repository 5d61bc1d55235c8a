"""Tab-separated tables: assignments in, any table out, and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hadoop's own codec of this name needs a native library; this one comes with Spark, which also reads its files.
ZSTD = "org.apache.parquet.hadoop.codec.ZstandardCodec"

# Columns of rearrangement tables, by type; others are read as strings.
DOUBLES = ("v_identity", "d_identity", "j_identity", "v_support", "d_support", "j_support", "V_SHM", "J_SHM", "V_covered", "D_covered", "J_covered", "FR1_SHM", "CDR1_SHM", "FR2_SHM", "CDR2_SHM", "FR3_SHM", "V_aa_mut", "J_aa_mut")
LONGS = ("count", "V_errors", "D_errors", "J_errors", "V_CDR3_start", "cdr3_start", "cdr3_end", *(f"{g}_{part}_{side}" for g in "vdj" for part in ("germline", "sequence") for side in ("start", "end")))
NEVER_NULL = ("v_call", "d_call", "j_call", "cdr3", "cdr3_aa", "locus", "stop_codon", "sequence_id", "barcode")


def field_type(name: str) -> T.DataType:
    return T.DoubleType() if name in DOUBLES else T.LongType() if name in LONGS else T.StringType()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header, gzipped or not; empty and NA are null, types by name."""
    header = spark.read.text(path).limit(1).first()
    names = header[0].split("\t") if header else []
    schema = T.StructType([T.StructField(n, field_type(n)) for n in names])
    return spark.read.schema(schema).option("header", True).option("sep", "\t").option("nullValue", "NA").option("quote", "").csv(path)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in NEVER_NULL if c in df.columns})


def write_table(df: DataFrame, path: str, compressed: bool = False, files: int | None = None) -> None:
    """A header and df's rows, in each file of the folder path; files: so many, else one a partition of df."""
    out = df if files is None else df.repartition(files)
    out.write.option("header", True).option("sep", "\t").option("emptyValue", "").option("compression", "gzip" if compressed else "none").csv(path)


def blocks(df: DataFrame, group: str, order: list[str], head: str | None = None, header: bool = False) -> DataFrame:
    """(value): tab-separated rows in order, with an empty line between groups, under a line that names the group
    (head) or one with the names of the columns (header). A line is a row, so a group of any size spreads over tasks."""
    cols = [c for c in df.columns if c != group or head is None]
    line = F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols))
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(order)]
    none = [F.lit(None).cast(df.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(order)]
    g = F.col(f"`{group}`").alias("_g")
    rows = df.select(g, F.lit(1).alias("_kind"), *keys, line.alias("value"))
    groups = df.select(g).distinct()
    parts = [rows]
    first = groups.agg(F.min("_g").alias("_first"))  # one row
    parts.append(groups.join(F.broadcast(first), F.col("_g") != F.col("_first")).select("_g", F.lit(-1).alias("_kind"), *none, F.lit("").alias("value")))
    if head is not None:
        parts.append(groups.select("_g", F.lit(0).alias("_kind"), *none, F.concat(F.lit(head), F.col("_g").cast("string")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if header:
        top = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[group].dataType).alias("_g"), F.lit(-2).alias("_kind"), *none, F.lit("\t".join(cols)).alias("value"))
        out = out.unionByName(top)
    return out.orderBy(F.col("_g").asc_nulls_first(), "_kind", *(f"_k{i}" for i in range(len(order)))).select("value")


def write_text(df: DataFrame, path: str, compression: str = "none") -> None:
    """df's lines in the folder path; its files, in order of their names, hold them in df's order."""
    df.write.option("compression", compression).text(path)
