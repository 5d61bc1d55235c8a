"""Consensus of regions before the V gene."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneframe.functions import kernels
from cloneframe.operators import filters

LONGEST = 10


def target(df: DataFrame, part: str) -> Column:
    """UTR, leader, or both on end."""
    need = {"UTR": ["UTR"], "leader": ["leader"], "UTR+leader": ["UTR", "leader"]}[part]
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"upstream regions need columns {missing}")
    return F.concat(*(F.coalesce(c, F.lit("")) for c in need))


def long_enough(df: DataFrame, part: str = "UTR", least: int = 1) -> DataFrame:
    """Rows with target, of genes with `least` rows or more, whose UTR is not shorter than the tenth longest of their
    gene (the shortest, if fewer); of leaders, all."""
    rows = df.withColumn("target", target(df, part)).filter("coalesce(v_call, '') <> ''")
    if least > 1:
        rows = rows.join(rows.groupBy("v_call").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("v_call"), "v_call", "left_semi")
    if part != "leader":
        size = F.length(F.coalesce("UTR", F.lit("")))
        rank = F.row_number().over(Window.partitionBy("v_call").orderBy(F.desc(size), "row_id"))
        shortest = rows.select("v_call", size.alias("_size"), rank.alias("_n")).filter(F.col("_n") <= LONGEST).groupBy("v_call").agg(F.min("_size").alias("_least"))
        rows = rows.join(shortest, "v_call").filter(size >= F.col("_least")).drop("_least")
    return rows.filter("target <> ''")


def consensus(df: DataFrame, part: str = "UTR", threshold: float = 75.0, most_v_errors: float | None = 1.0, drop_n: bool = False, program: str = "builtin", seed: int = 1, least: int = 1) -> DataFrame:
    """(name, sequence, rows) per gene; leading N go. Each gene's consensus is made of a fixed sample of its rows."""
    rows = long_enough(filters.upstream(df, most_v_errors), part, least)
    order = Window.partitionBy("v_call").orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id")
    some = rows.withColumns({"_rank": F.row_number().over(order), "_all": F.count(F.lit(1)).over(Window.partitionBy("v_call"))}).filter(F.col("_rank") <= kernels.LAST_SAMPLE)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("_rank")["target"].tolist()
        made = s[0] if len(set(s)) == 1 else kernels.iterative_consensus(s, threshold / 100, kernels.aligner(program))
        return pd.DataFrame({"name": [pdf["v_call"].iloc[0]], "sequence": [made.lstrip("N")], "rows": [pdf["_all"].iloc[0]]})

    out = some.select("v_call", "target", "_rank", "_all").groupBy("v_call").applyInPandas(fold, "name string, sequence string, rows long")
    return out.filter(~F.contains("sequence", F.lit("N"))) if drop_n else out
