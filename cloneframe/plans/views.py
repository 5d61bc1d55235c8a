"""Tables derived from the driver's tables by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def _nt(x: str) -> str:
    """32 pseudo-random bases of an integer expression."""
    return f"translate(md5(cast({x} as {{S}})),'{HEX}','{BASES}')"


VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    # rearrangement assignments, one row per order
    "assignments": ("orders", {
        "row_id": "o_orderkey",
        "sequence_id": f"concat('r',cast(o_orderkey as {{S}}),';size=',cast(o_orderkey % 9 + 1 as {{S}}),';barcode=',substr({_nt('o_custkey')},1,6),';')",
        "v_call": "concat('IGHV',cast(o_custkey % 8 + 1 as {S}),'*0',cast(o_custkey % 3 + 1 as {S}))",
        "d_call": "case when o_orderkey % 19 = 0 then '' else concat('IGHD',cast(o_orderkey % 5 + 1 as {S}),'*01') end",
        "j_call": "case when o_orderkey % 23 = 0 then '' else concat('IGHJ',cast(o_orderkey % 6 + 1 as {S}),'*0',cast(o_orderkey % 5 % 2 + 1 as {S})) end",
        "cdr3": f"case when o_orderkey % 11 = 7 then '' else concat(substr({_nt('o_custkey % 40')},1,cast(11 + o_custkey % 3 as int)),substr('ACGT',cast(o_orderkey % 4 + 1 as int),1)) end",
        "stop_codon": "case when o_orderkey % 13 = 0 then 'T' else 'F' end",
        "v_support": "case when o_orderkey % 17 = 0 then null when o_orderkey % 11 = 0 then 0.5e0 else 1e-6 end",
        "V_covered": "cast(80 + o_orderkey % 21 as double)",
        "J_covered": "cast(50 + o_orderkey % 51 as double)",
        "D_covered": "cast(50 + o_orderkey % 51 as double)",
        "d_support": "case when o_orderkey % 7 = 0 then null else 1e-5 end",
        "V_SHM": "cast(o_orderkey % 40 as double)/2e0",
        "J_SHM": "cast(o_orderkey % 3 as double)",
        "V_errors": "cast(o_orderkey % 3 as int)",
        "D_errors": "cast(o_orderkey % 2 as int)",
        "J_errors": "cast(o_orderkey % 4 as int)",
        "barcode": f"substr({_nt('o_custkey')},1,6)",
    }),
    # nucleotide strings: s, an edited copy t, gapped rows g and q
    "strings": ("orders", {
        "row_id": "o_orderkey",
        "s": f"concat({_nt('o_orderkey')},{_nt('o_custkey')})",
        "t": f"concat(substr({_nt('o_orderkey')},1,9),substr('ACGTN',cast(o_orderkey % 5 + 1 as int),1),substr({_nt('o_orderkey')},11,22),{_nt('o_custkey')})",
        "g": f"concat(substr({_nt('o_orderkey')},1,5),case when o_orderkey % 3 = 0 then '--' else '' end,substr({_nt('o_orderkey')},6,10))",
        "q": f"concat(substr({_nt('o_custkey')},1,2),substr({_nt('o_orderkey')},3,case when o_orderkey % 3 = 0 then 13 else 11 end),case when o_orderkey % 4 = 0 then '-' else 'A' end)",
        "name": f"concat('IGHV',cast(o_orderkey % 12 + 1 as {{S}}),'-',cast(o_orderkey % 31 as {{S}}),'*0',cast(o_orderkey % 3 + 1 as {{S}}),case when o_orderkey % 4 = 0 then '_S1234' else '' end)",
        "header": f"concat('r',cast(o_orderkey as {{S}}),case when o_orderkey % 3 = 0 then concat(';size=',cast(o_orderkey % 9 as {{S}})) else '' end,case when o_orderkey % 2 = 0 then concat(';barcode=',substr({_nt('o_custkey')},1,6),';') else '' end)",
        "bars": "concat('ACC',cast(o_orderkey as {S}),case when o_orderkey % 2 = 0 then concat('|IGHV',cast(o_orderkey % 9 as {S}),'*01|x') else '' end)",
        "dotted": f"lower(concat(substr({_nt('o_orderkey')},1,6),'..',substr({_nt('o_orderkey')},7,9),'.x'))",
    }),
    # reads with few distinct sequences
    "reads": ("orders", {
        "ord": "o_orderkey",
        "name": "concat('read',cast(o_orderkey as {S}))",
        "sequence": f"concat(substr({_nt('o_custkey % 300')},1,6),repeat('G',cast(o_orderkey % 3 as int)),substr({_nt('o_custkey % 90')},1,cast(20 + 4 * (o_orderkey % 3) as int)))",
    }),
    # aligned rows of genes, with ragged ends, gaps and ambiguous bases
    "aligned": ("orders", {
        "grp": "o_custkey % 25",
        "row": f"substr(concat(substr({_nt('o_custkey % 25')},1,cast(4 + o_orderkey % 3 as int)),substr('ACGTN-',cast(o_orderkey % 6 + 1 as int),1),substr({_nt('o_custkey % 25')},9,20)),1,cast(26 - o_orderkey % 5 as int))",
    }),
    # germline candidates
    "candidates": ("supplier", {
        "idx": "s_suppkey",
        "name": "concat('IGHV',cast(s_suppkey % 9 + 1 as {S}),'*0',cast(s_suppkey % 4 + 1 as {S}),case when s_suppkey % 5 = 0 then concat('_S',cast(s_suppkey as {S})) else '' end)",
        "consensus": f"substr({_nt('s_suppkey % 40')},1,cast(28 + s_suppkey % 4 as int))",
        "cluster": "case s_suppkey % 4 when 0 then 'all' when 1 then '0-2' when 2 then 'db' else 'cl1' end",
        "cluster_size": "s_suppkey * 7 % 300",
        "exact": "s_suppkey * 13 % 150",
        "Ds_exact": "s_suppkey * 5 % 40",
        "Js_exact": "s_suppkey % 7",
        "CDR3s_exact": "s_suppkey * 3 % 50",
        "clonotypes": "s_suppkey * 11 % 90",
        "CDR3_start": "cast(20 + s_suppkey % 9 as int)",
        "CDR3_shared_ratio": "case when s_suppkey % 6 = 0 then '0.90' else '0.25' end",
        "has_stop": "case when s_suppkey % 8 = 0 then 1 else 0 end",
        "database_diff": "case when s_suppkey % 3 = 0 then 0 else s_suppkey % 3 end",
    }),
    "j_candidates": ("supplier", {
        "name": "concat('IGHJ',cast(s_suppkey % 6 + 1 as {S}),'*',cast(s_suppkey as {S}))",
        "source": "concat('IGHJ',cast(s_suppkey % 6 + 1 as {S}),'*01')",
        "exact": "s_suppkey * 17 % 400",
        "CDR3s_exact": "s_suppkey * 3 % 50",
        "consensus": f"substr({_nt('s_suppkey % 30')},1,12)",
    }),
    # two gene databases, and found genes to be renamed
    "database_a": ("nation", {
        "ord": "cast(n_nationkey as bigint)",
        "name": "concat('IGHV',cast(n_nationkey % 5 + 1 as {S}),'*0',cast(n_nationkey % 3 + 1 as {S}))",
        "sequence": f"substr({_nt('n_nationkey % 22')},1,cast(24 + n_nationkey % 3 as int))",
    }),
    "database_b": ("nation", {
        "ord": "cast(n_nationkey as bigint)",
        "name": "concat('IGHV',cast(n_nationkey % 4 + 1 as {S}),'*0',cast(n_nationkey % 2 + 1 as {S}))",
        "sequence": f"case when n_nationkey % 3 = 0 then concat('C',substr({_nt('n_nationkey')},2,cast(23 + n_nationkey % 3 as int))) else substr({_nt('n_nationkey % 20')},1,cast(24 + n_nationkey % 3 as int)) end",
    }),
    "found": ("supplier", {
        "ord": "s_suppkey",
        "name": "concat('new',cast(s_suppkey as {S}))",
        "sequence": f"concat(substr({_nt('s_suppkey % 22')},1,20),substr({_nt('s_suppkey')},1,4))",
    }),
    "prefixes": ("supplier", {
        "ord": "s_suppkey",
        "name": "concat('g',cast(s_suppkey as {S}))",
        "sequence": f"substr({_nt('s_suppkey % 35')},1,cast(12 + s_suppkey % 9 as int))",
    }),
    # upstream regions
    "leaders": ("orders", {
        "row_id": "o_orderkey",
        "v_call": "concat('IGHV',cast(o_custkey % 8 + 1 as {S}),'*0',cast(o_custkey % 3 + 1 as {S}))",
        "V_SHM": "cast(o_orderkey % 8 as double)/4e0",
        "UTR": f"substr({_nt('o_custkey % 24')},1,cast(10 + o_orderkey % 13 as int))",
        "leader": f"substr({_nt('o_custkey % 24')},1,9)",
    }),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e.replace('{S}', 'string')} as {c}" for c, e in columns.items()))


def sql(name: str) -> str:
    """DuckDB subquery of a view."""
    table, columns = VIEWS[name]
    return "(select " + ", ".join(f"{e.replace('{S}', 'varchar')} as {c}" for c, e in columns.items()) + f" from {table}) {name}"
