"""Registered queries of sources, sinks and the augmentation of rearrangement tables, and their SQL.

Files go to the shared folder and are read back, so a query's rows have been through both ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneframe.functions import names
from cloneframe.operators import augment, clonoquery, clonotypes, databases, filters, haplotypes, merging, usage
from cloneframe.plans import catalogue
from cloneframe.plans.scratch import scratch_path
from cloneframe.plans.views import sql, view
from cloneframe.sources import config, fastx, tables

A, S, DA = sql("assignments"), sql("strings"), sql("database_a")


def files(name: str, source: str, text: str | None) -> Callable:
    """Register f(df of view source, a new folder) as a query, with its SQL."""

    def put(f: Callable[[DataFrame, str], DataFrame]) -> Callable:
        catalogue._QUERIES[name] = lambda spark, sf_dir: f(view(spark, sf_dir, source), scratch_path(spark, name))
        if text:
            catalogue._SQL[name] = text
        return f

    return put


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


# FASTA and FASTQ ------------------------------------------------------------------------------------------------------


@files("fasta_read", "strings", f"select concat('r', row_id) as name, s as sequence from {S}")
def fasta_read(df: DataFrame, path: str) -> DataFrame:
    """Records with a description, in lower case, over two lines, some files gzipped."""
    text = df.select(F.col("row_id"), F.concat(F.lit(">r"), F.col("row_id").cast("string"), F.lit(" text;size=1;\n"), F.lower(F.left("s", F.lit(30))), F.lit("\n"), F.expr("substr(s, 31)")).alias("value"))
    for part, kind in ((0, "none"), (1, "gzip")):
        text.filter(F.col("row_id") % 2 == part).select("value").write.option("compression", kind).mode("append").text(path)
    return fastx.read(df.sparkSession, path).select("name", "sequence")


@files("fastq_read", "strings", f"select concat('r', row_id) as name, s as sequence from {S}")
def fastq_read(df: DataFrame, path: str) -> DataFrame:
    """Records whose quality lines begin like records."""
    quality = F.concat(F.when(F.col("row_id") % 2 == 0, "@").otherwise(">"), F.expr("repeat('I', cast(length(s) - 1 as int))"))
    df.select(F.concat(F.lit("@r"), F.col("row_id").cast("string"), F.lit(" 1:N\n"), F.lower("s"), F.lit("\n+\n"), quality)).write.text(path)
    return fastx.read(df.sparkSession, path).select("name", "sequence")


@files("fasta_write", "strings", f"select zipped, name, s as sequence, place from (select concat('r', row_id) as name, s, row_number() over (order by row_id desc) as place from {S}), (values (false), (true)) t(zipped)")
def fasta_write(df: DataFrame, path: str) -> DataFrame:
    """Plain and gzipped files, which hold the records in order."""
    out = None
    for zipped in (False, True):
        fastx.write(df.select(F.concat(F.lit("r"), F.col("row_id").cast("string")).alias("name"), F.col("s").alias("sequence"), (-F.col("row_id")).alias("ord")), f"{path}/{zipped}", compressed=zipped)
        got = fastx.read(df.sparkSession, f"{path}/{zipped}")
        sizes = got.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(catalogue.Window.orderBy("file").rowsBetween(catalogue.Window.unboundedPreceding, -1))  # a row per file
        starts = sizes.select("file", F.coalesce(before, F.lit(0)).alias("before"))
        got = got.join(F.broadcast(starts), "file").select(F.lit(zipped).alias("zipped"), "name", "sequence", (F.col("before") + F.col("ord") + 1).alias("place"))
        out = got if out is None else out.unionByName(got)
    return out


@files("fasta_map", "database_a", f"select name, sequence from {DA} qualify row_number() over (partition by name order by ord desc) = 1")
def fasta_map(df: DataFrame, path: str) -> DataFrame:
    """Of records with one name, the last of the file."""
    fastx.write(df.select("name", "sequence", "ord"), path)
    return fastx.last_by_name(fastx.read(df.sparkSession, path).withColumn("file", F.regexp_extract("file", "part-([0-9]+)", 1))).select("name", "sequence")


@files("fasta_nonempty", "database_a", f"select 'all' as which, count(*) > 0 as has from {DA} union all select 'none', false")
def fasta_nonempty(df: DataFrame, path: str) -> DataFrame:
    found = []
    for which, rows in (("all", df), ("none", df.filter("ord < 0"))):
        fastx.write(rows.select("name", "sequence", "ord"), f"{path}/{which}")
        found.append((which, fastx.has_records(fastx.read(df.sparkSession, f"{path}/{which}"))))
    return df.sparkSession.createDataFrame(found, "which string, has boolean")


HOLES = f"(select ord, name, case when ord % 6 = 5 then '' else sequence end as sequence from {DA})"
PROBLEMS = f"select 'empty' as problem, name, sequence from {HOLES} where sequence = ''" + "".join(f" union all select 'duplicate {c}', name, sequence from (select *, row_number() over (partition by {c} order by ord) as n from {HOLES}) where n > 1" for c in ("name", "sequence"))


@files("fasta_problems", "database_a", PROBLEMS)
def fasta_problems(df: DataFrame, path: str) -> DataFrame:
    df.select(F.lit("f").alias("file"), "ord", "name", F.when(F.col("ord") % 6 == 5, "").otherwise(F.col("sequence")).alias("sequence")).write.parquet(path)
    return fastx.problems(df.sparkSession.read.parquet(path))


catalogue.query("db_sanitized", "strings", f"select row_id, case when contains(bars, '|') then split_part(bars, '|', 2) else bars end as name, upper(replace(dotted, '.', '')) as sequence from (select row_id, bars, case when row_id % 7 = 0 then '...' else dotted end as dotted from {S}) where row_id % 7 <> 0")(
    lambda df: databases.sanitize(df.select("row_id", F.col("bars").alias("name"), F.when(F.col("row_id") % 7 == 0, "...").otherwise(F.col("dotted")).alias("sequence")))
)


@files("paired_merge", "strings", f"select concat('r', row_id) as name, s as sequence from {S} where row_id % 9 <> 0")
def paired_merge(df: DataFrame, path: str) -> DataFrame:
    """Pairs that overlap by 24 bases; those of every ninth row do not overlap, nor could they by chance: their second
    read is of the one base that is rarest, two of ten at most, at the end of the first."""
    name = F.concat(F.lit("r"), F.col("row_id").cast("string"))
    end = F.substring("s", 35, 10)
    rarest = F.array_min(F.array(*(F.struct(F.length(F.regexp_replace(end, f"[^{x}]", "")).alias("n"), F.lit(x).alias("x")) for x in "ACGT")))["x"]
    far = F.when(F.col("row_id") % 9 == 0, F.translate(F.repeat(rarest, F.lit(44)), "ACGT", "TGCA")).otherwise(F.reverse(F.translate(F.expr("substr(s, 21)"), "ACGT", "TGCA")))
    for end, text in ((1, F.left("s", F.lit(44))), (2, far)):
        df.select(F.concat(F.lit("@"), name, F.lit(f"/{end}\n"), text, F.lit("\n+\n"), F.expr("repeat('I', 44)"))).write.text(f"{path}/{end}")
    return merging.merge_pairs(*(fastx.read(df.sparkSession, f"{path}/{end}") for end in (1, 2)))


# tables and reports -----------------------------------------------------------------------------------------------------

TSV = "sequence_id, v_call, cdr3, v_support, \"V_SHM\", \"V_errors\""


@files("tsv_files", "assignments", f"select zipped, sequence_id, v_call, cdr3, v_support, \"V_SHM\", cast(\"V_errors\" as bigint) as \"V_errors\" from {A}, (values (false), (true)) t(zipped)")
def tsv_files(df: DataFrame, path: str) -> DataFrame:
    """Tables with NA and empty fields, plain and gzipped; missing strings come back as empty ones."""
    rows = df.select("sequence_id", "v_call", F.when(F.col("cdr3") == "", F.lit(None)).otherwise(F.col("cdr3")).alias("cdr3"), F.coalesce(F.col("v_support").cast("string"), F.lit("NA")).alias("v_support"), "V_SHM", "V_errors")
    out = None
    for zipped in (False, True):
        tables.write_table(rows, f"{path}/{zipped}", zipped)
        got = tables.read_assignments(df.sparkSession, f"{path}/{zipped}").withColumn("zipped", F.lit(zipped))
        out = got if out is None else out.unionByName(got)
    return out


MEMBER = "concat_ws(chr(9), cast(clonotype_id as varchar), cast(row_id as varchar), cdr3)"


@files("members_file", "assignments", catalogue.ONE + f"select {MEMBER} as line from members union all select concat_ws(chr(9), 'clonotype_id', 'row_id', 'cdr3') union all select '' from (select distinct clonotype_id from members) where clonotype_id > (select min(clonotype_id) from members)")
def members_file(df: DataFrame, path: str) -> DataFrame:
    found = clonotypes.members(filters.filter_table(df)).select("clonotype_id", "row_id", "cdr3")
    tables.write_text(tables.blocks(found, "clonotype_id", ["row_id"], header=True), path)
    return _lines(df.sparkSession, path)


FOUND = catalogue.PAIRS.format(near=catalogue.APART + " <= 1")


@files("clonoquery_file", "assignments", f"with m as ({FOUND}) select concat('# Query: ', query_id) as line from (select distinct query_id from m) union all select cast(row_id as varchar) from m union all select '' from (select distinct query_id from m) where query_id > (select min(query_id) from m)")
def clonoquery_file(df: DataFrame, path: str) -> DataFrame:
    clonoquery.write(df.filter("row_id % 20 = 0"), df, path, ["row_id"], 1)
    return _lines(df.sparkSession, path)


STATS = [*filters.STAGES, "has_cdr3"]


@files("filter_stats_json", "assignments", "select concat('{', " + ", ',', ".join(f"'\"{n}\":', {n}" for n in ["total", *STATS]) + f", '}}') as line from ({catalogue._SQL['filter_cascade_stats']})")
def filter_stats_json(df: DataFrame, path: str) -> DataFrame:
    filters.write_stats(filters.filter_stats(df), path)
    return _lines(df.sparkSession, path)


HAPLO_LINES = f"select concat_ws(chr(9), haplotype1, haplotype2, type, cast(count1 as varchar), cast(count2 as varchar)) as line from ({catalogue.HAPLO}) union all values (concat_ws(chr(9), 'haplotype1', 'haplotype2', 'type', 'count1', 'count2')), ('# V haplotype from {catalogue.HET[0]} and {catalogue.HET[1]}')"


@files("haplotype_file", "assignments", HAPLO_LINES)
def haplotype_file(df: DataFrame, path: str) -> DataFrame:
    found = haplotypes.entries(usage.coexpression(df, "J", "V"), usage.expression_by_gene(df, "V"), catalogue.HET, "J", "V").select("haplotype1", "haplotype2", "type", "count1", "count2")
    block = haplotypes.Block("V", catalogue.HET, [tuple(r) for r in found.collect()])  # genes of a locus
    spark = df.sparkSession
    tables.write_text(spark.createDataFrame([(x,) for x in block.tsv(True).splitlines()], "value string").coalesce(1), path)
    return _lines(spark, path)


DEFAULTS = {"iterations": "3", "seed": "1", "ignore_j": "false", "subsample": "1000", "germline_filter.unique_js": "9", "germline_filter.cluster_size": "50", "pre_germline_filter.unique_cdr3s": "2", "preprocessing_filter.v_evalue": "0.001", "j_discovery.propagate": "true"}


@files("config_merged", "database_a", "values " + ", ".join(f"('{k}', '{v}')" for k, v in DEFAULTS.items()))
def config_merged(df: DataFrame, path: str) -> DataFrame:
    """Settings of a document that names two of them, written and read again."""
    import tomllib

    made = config.parse(tomllib.loads(config.dumps(config.parse(tomllib.loads("iterations = 3\n[germline_filter]\nunique_js = 9\n")))))

    def of(key: str) -> str:
        at = made
        for part in key.split("."):
            at = getattr(at, part)
        return str(at).lower() if isinstance(at, bool) else str(at)

    return df.sparkSession.createDataFrame([(k, of(k)) for k in DEFAULTS], "col0 string, col1 string")


# augmentation -----------------------------------------------------------------------------------------------------------

BARS = f"(select ord, concat('ACC', ord, case when ord % 4 = 0 then '' else concat('|IGHV', ord % 5, '*0', ord % 3, '|x') end) as name from {DA})"
ALLELE = "case when contains(name, '|') then split_part(name, '|', 2) else name end"
ALIAS = " union all ".join(f"select {e} as alias, name, {r} as r from {BARS}" for r, e in enumerate(["name", "case when contains(name, '|') then concat(split_part(name, '|', 1), '_', split_part(name, '|', 2)) else name end", ALLELE, f"split_part({ALLELE}, '*', 1)"]))
catalogue.query("gene_aliases", "database_a", f"select alias, arg_min(name, (r, name)) as name from ({ALIAS}) group by 1")(
    lambda df: augment.aliases(df.select(F.concat(F.lit("ACC"), F.col("ord").cast("string"), F.when(F.col("ord") % 4 == 0, "").otherwise(F.concat(F.lit("|IGHV"), (F.col("ord") % 5).cast("string"), F.lit("*0"), (F.col("ord") % 3).cast("string"), F.lit("|x")))).alias("name")))
)
catalogue.query("call_cleanup", "strings", f"select row_id, regexp_replace(name, '^%+', '') as call from (select row_id, concat(repeat('%', cast(row_id % 3 as int)), name) as name from {S})")(
    lambda df: df.select("row_id", names.strip_percent(F.concat(F.expr("repeat('%', cast(row_id % 3 as int))"), "name")).alias("call"))
)
catalogue.query("default_columns", "assignments", f"select row_id, coalesce(v_support, 0) as v_support, 7 as missing from {A}")(lambda df: df.select("row_id", augment._have(df, "v_support", 0.0).alias("v_support"), augment._have(df, "missing", 7).alias("missing")))

NT = "translate(md5(concat('{p}', cast({k} as {{S}}))),'0123456789abcdef','ACGTACGTACGTACGT')"
GENES = {  # a V that ends in its anchor, a J that begins with the CDR3's last bases
    "V": (12, f"concat({NT.format(p='V', k='k')},'C','TATTACTGTGCG')"),
    "D": (4, f"substr({NT.format(p='D', k='k')},1,12)"),
    "J": (5, f"concat('AC','C','TGGGGC',substr({NT.format(p='J', k='k')},1,9))"),
}


def gene(p: str, at: str) -> str:
    """SQL of the sequence of gene number at."""
    return GENES[p][1].replace("k as", f"({at}) as")


AIRR = {
    "row_id": "row_id",
    "sequence_id": "concat('r',cast(row_id as {S}),';size=',cast(row_id % 7 as {S}),';barcode=AC;')",
    "locus": "'IGH'",
    "v_call": "concat(repeat('%',cast(row_id % 2 as int)),'X',cast(row_id % 12 as {S}),'|IGHV',cast(row_id % 12 as {S}),'*01|z')",
    "d_call": "case when row_id % 5 = 0 then '' else concat('IGHD',cast(row_id % 4 as {S}),'*01') end",
    "j_call": "concat('IGHJ',cast(row_id % 5 as {S}),'*01')",
    # the read: three bases, the V with one substitution in every other row, the CDR3's middle, the J
    "v_part": "case when row_id % 2 = 0 then {V} else concat(substr({V},1,7),case when substr({V},8,1) = 'A' then 'C' else 'A' end,substr({V},9)) end",
    "middle": "substr(s,1,cast(6 + row_id % 9 as int))",
    "v_identity": "case when row_id % 4 = 0 then null else 98.5e0 end",
    "j_identity": "100e0",
    "stop_codon": "case row_id % 3 when 0 then 'true' when 1 then 'F' else '' end",
}
AIRR_SQL = "(select " + ", ".join(f"{e} as {c}" for c, e in AIRR.items()) + ", {V} as v_gene, {J} as j_gene from {source}) airr"


def airr(source: str, kind: str) -> str:
    return AIRR_SQL.replace("{source}", source).replace("{V}", gene("V", "row_id % 12")).replace("{J}", gene("J", "row_id % 5")).replace("{S}", kind)


def _augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The augmentation of whole rows, from gapped alignments with one inserted base in every third row's J."""
    df = spark.sql(f"select * from {airr('{strings}', 'string')}", strings=view(spark, sf_dir, "strings"))
    dbs = [spark.range(GENES[p][0]).withColumnRenamed("id", "k").select(F.expr(f"concat('{'X' if p == 'V' else ''}',{'cast(k as string),' if p == 'V' else ''}'{'|' if p == 'V' else ''}IGH{p}',cast(k as string),'*01{'|z' if p == 'V' else ''}')").alias("name"), F.expr(gene(p, "k").replace("{S}", "string")).alias("sequence")) for p in "VDJ"]
    rows = df.withColumns({
        "sequence": F.expr("concat('GGG', v_part, middle, j_gene)"),
        "v_germline_alignment": F.col("v_gene"), "v_sequence_alignment": F.col("v_part"),
        "v_germline_start": F.lit(1), "v_germline_end": F.length("v_gene"), "v_sequence_start": F.lit(4), "v_sequence_end": F.length("v_part") + 3,
        "j_germline_alignment": F.expr("case when row_id % 3 = 0 then concat(substr(j_gene, 1, 10), '-', substr(j_gene, 11)) else j_gene end"),
        "j_sequence_alignment": F.expr("case when row_id % 3 = 0 then concat(substr(j_gene, 1, 10), 'T', substr(j_gene, 11)) else j_gene end"),
        "j_germline_start": F.lit(1), "j_sequence_start": F.length("v_part") + F.length("middle") + 4,
    }).withColumn("sequence", F.expr("case when row_id % 3 = 0 then concat('GGG', v_part, middle, substr(j_gene, 1, 10), 'T', substr(j_gene, 11)) else sequence end")).drop("v_part", "middle", "v_gene", "j_gene")
    out = augment.augment(rows, *dbs)
    return out.select("row_id", "sequence_id", "count", "barcode", "v_call", "d_call", "j_call", "V_SHM", "J_SHM", "V_errors", "D_errors", "J_errors", "V_covered", "J_covered", "D_covered", "V_CDR3_start", "cdr3", "cdr3_aa", "cdr3_start", "cdr3_end", "V_nt", "d_support", "stop_codon")


CDR3 = "concat(right(v_part, 3), middle, 'ACC')"
AUGMENTED = f"""
select row_id, concat('r', row_id) as sequence_id, row_id % 7 as count, 'AC' as barcode, concat('IGHV', row_id % 12, '*01') as v_call, d_call, j_call,
  coalesce(100 - v_identity, 0) as "V_SHM", 0e0 as "J_SHM", cast(row_id % 2 as bigint) as "V_errors", cast(0 as bigint) as "D_errors", cast(case when row_id % 3 = 0 then 1 else 0 end as bigint) as "J_errors",
  100e0 as "V_covered", 100e0 as "J_covered", 0e0 as "D_covered", cast(length(v_part) - 3 as bigint) as "V_CDR3_start",
  {CDR3} as cdr3, {catalogue.AMINO.replace('length(s)', f'length({CDR3})').replace('substr(s,', f'substr({CDR3},')} as cdr3_aa,
  cast(length(v_part) + 1 as bigint) as cdr3_start, cast(length(v_part) + 3 + length(middle) + 3 as bigint) as cdr3_end, v_part as "V_nt", cast('inf' as double) as d_support, case row_id % 3 when 0 then 'T' when 1 then 'F' else '' end as stop_codon
from {airr(S, 'varchar')}
"""
catalogue._QUERIES["augment"] = _augmented
catalogue._SQL["augment"] = AUGMENTED
