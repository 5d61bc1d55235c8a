"""Distance matrices and clusters of each gene's sequences, of a fixed sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneframe.functions import kernels
from cloneframe.functions.names import call_column
from cloneframe.operators.discovery import sampled

# Fixed value: the shades, from equal to farthest.
SHADES = " ░▒▓█"


def clusters(df: DataFrame, gene_type: str = "V", genes: list[str] | None = None, least: int = 200, shown: int = 300, least_cluster: int = 5, ignore_j: bool = False, strict: bool = True, seed: int = 1) -> DataFrame:
    """(gene, n_sequences, n_clusters, clusters, distances) of genes with `least` rows or more; a sample of `shown` each.
    strict: no clusters, as kernels.cut_by_ratio says."""
    call, column = call_column(gene_type), f"{gene_type}_nt"
    if missing := [c for c in (call, column) if c not in df.columns]:
        raise ValueError(f"cluster plots need columns {missing}")
    if not ignore_j and "J_SHM" in df.columns:
        df = df.filter(F.coalesce("J_SHM", F.lit(float("inf"))) == 0)
    rows = df.filter(f"coalesce({call}, '') <> ''")
    if genes is not None:
        rows = rows.filter(F.col(call).isin(genes))
    big = rows.groupBy(call).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(call)
    some = sampled(rows.join(big, call, "left_semi"), [call], shown, seed)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        d = kernels.distances(pdf.sort_values("_rank")["s"].tolist())
        ids = kernels.cut_by_ratio(d, least_cluster, strict=strict)
        return pd.DataFrame({"gene": [pdf["gene"].iloc[0]], "n_sequences": [len(d)], "n_clusters": [len(set(ids) - {0})], "clusters": [ids], "distances": [d.astype(float).tolist()]})

    some = some.select(F.col(call).alias("gene"), F.coalesce(column, F.lit("")).alias("s"), "_rank")
    return some.groupBy("gene").applyInPandas(fold, "gene string, n_sequences long, n_clusters long, clusters array<long>, distances array<array<double>>")


def distance_pairs(df: DataFrame, by: str, text: str, band: float = 0.2) -> DataFrame:
    """(by, a, b, d) of distinct texts of a group: edit distance, at most one above the largest band share of a length."""
    one = df.select(by, F.col(text).alias("a")).distinct()
    cap = one.groupBy(by).agg(F.max(F.bround(band * F.length("a"), 0).cast("int")).alias("_cap"))
    pairs = one.join(one.withColumnRenamed("a", "b"), by).filter("a < b").join(cap, by)
    return pairs.select(by, "a", "b", F.least(F.levenshtein("a", "b"), F.col("_cap") + 1).alias("d"))


def heatmap(result, width: int = 60, height: int = 30) -> str:
    """Text picture of a row of clusters(): the darker, the farther apart; every so many-th row and column is shown."""
    d = result["distances"]
    n = len(d)
    top = max((x for r in d for x in r), default=0) or 1
    out = [f"{result['gene']}: {result['n_sequences']} sequences, {result['n_clusters']} clusters", f"Distance matrix {n}×{n}"]
    last = len(SHADES) - 1
    for i in range(0, n, max(1, n // height)):
        out.append("".join(SHADES[min(last, round(d[i][j] / top * last))] for j in range(0, n, max(1, n // width))))
    return "\n".join(out)
