"""Registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloneframe.functions import alignment, cdr3, names, sequence
from cloneframe.operators import assign, clonoquery, clonotypes, clusterplots, consensus, copies, databases, discovery, filters, germline, haplotypes, upstream, usage
from cloneframe.plans.views import sql, view
from cloneframe.sources.config import GermlineCriteria

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, source: str, text: str | None = None) -> Callable:
    """Register f(df of view source) as a query, with its SQL."""

    def put(f: Callable[[DataFrame], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(view(spark, sf_dir, source))
        if text:
            _SQL[name] = text
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


A, S, R, L, C, J = sql("assignments"), sql("strings"), sql("reads"), sql("aligned"), sql("candidates"), sql("j_candidates")

# filters -------------------------------------------------------------------------------------------------------------

PASSED = ["v_call <> '' and j_call <> ''", "stop_codon = 'F'", "coalesce(v_support, 1e300) <= 1e-3", "V_covered >= 90", "J_covered >= 60"]
ALL = " and ".join(PASSED)
ROW = "row_id, v_call, d_call, j_call, cdr3, V_SHM"

query("filter_table", "assignments", f"select {ROW} from {A} where {ALL}")(lambda df: filters.filter_table(df).select(*ROW.split(", ")))
query("filter_cascade_stats", "assignments", "select count(*) as total, " + ", ".join(f"count(*) filter ({' and '.join(PASSED[: i + 1])}) as {n}" for i, n in enumerate(filters.STAGES)) + f", count(*) filter ({ALL} and cdr3 <> '') as has_cdr3 from {A}")(filters.filter_stats)
query("exact_rows", "assignments", f"select {ROW} from {A} where V_errors = 0")(lambda df: filters.zero(df, "V_errors").select(*ROW.split(", ")))
D_GOOD = "D_errors = 0 and coalesce(d_support, 1e300) <= 1e-4 and D_covered >= 65"
query("haplotype_filter", "assignments", f"select {ROW} from {A} where V_errors = 0 and J_errors = 0 and {D_GOOD}")(lambda df: filters.haplotype(df).select(*ROW.split(", ")))
query("upstream_filter", "assignments", f"select {ROW} from {A} where V_SHM <= 1 and J_SHM <= 1")(lambda df: filters.upstream(df, 1.0, {"J_SHM": 1.0}).select(*ROW.split(", ")))
query("restrict_names", "assignments", f"select {ROW} from {A} where v_call in (select distinct v_call from {A} where row_id % 977 = 0)")(lambda df: filters.restrict(df, df.filter("row_id % 977 = 0").select(F.col("v_call").alias("name"))).select(*ROW.split(", ")))

# usage ---------------------------------------------------------------------------------------------------------------


def _counts(call: str, where: str = "true") -> str:
    return f"select {call} as gene, count(*) as count from {A} where {call} <> '' and {where} group by 1"


GENE = "split_part(gene, '*', 1)"
for _g in "vdj":
    query(f"expression_counts_{_g}", "assignments", _counts(f"{_g}_call", "coalesce(d_support, 1e300) <= 1e-4 and D_covered >= 70 and D_errors <= 1" if _g == "d" else "true"))(
        lambda df, g=_g.upper(): usage.expression_counts(df, g, **({"d_evalue": 1e-4, "d_errors": 1} if g == "D" else {}))
    )
RATIO = f"select gene, count from (select *, max(count) over (partition by {GENE}) as top from ({_counts('v_call')})) where count >= 0.97 * top"
query("expression_allele_ratio", "assignments", RATIO)(lambda df: usage.allele_ratio(usage.expression_counts(df, "V"), 0.97))
LISTED = "select * from (values ('IGHJ1*01'), ('IGHJ3*02'), ('IGHJ9*01')) t(name)"
query("expression_gene_list", "assignments", f"select name as gene, coalesce(count, 0) as count from ({LISTED}) left join ({_counts('j_call')}) on gene = name")(
    lambda df: usage.expression_counts(df, "J", df.sparkSession.createDataFrame([("IGHJ1*01",), ("IGHJ3*02",), ("IGHJ9*01",)], "name string"))
)
JS = [f"IGHJ{i}*0{k}" for i in (1, 2, 3) for k in (1, 2)]
query("allele_matrix", "assignments", "select v_call as gene, " + ", ".join(f"count(*) filter (j_call = '{n}') as \"{n}\"" for n in JS) + f" from {A} where V_errors = 0 and J_errors = 0 and v_call <> '' group by 1")(lambda df: usage.allele_matrix(df, "V", "J", JS))
query("allele_matrix_d", "assignments", "select v_call as gene, " + ", ".join(f"count(*) filter (d_call = 'IGHD{n}*01') as \"IGHD{n}*01\"" for n in (1, 2)) + f" from {A} where V_errors = 0 and {D_GOOD} and v_call <> '' group by 1")(lambda df: usage.allele_matrix(df, "V", "D", ["IGHD1*01", "IGHD2*01"]))
query("allele_totals", "assignments", f"select j_call as allele, count(*) as count from {A} where j_call <> '' group by 1")(lambda df: usage.allele_totals(df, "J"))
query("most_common_cdr3", "assignments", f"select v_call, (list(cdr3 order by n desc, cdr3))[1] as cdr3 from (select v_call, cdr3, count(*) as n from {A} where cdr3 <> '' group by 1, 2) group by 1")(lambda df: usage.most_common(df.filter("cdr3 <> ''"), "cdr3", ["v_call"]))
COEX = f"select v_call, j_call, count(*) as count from {A} where v_call <> '' and j_call <> '' group by 1, 2"
query("coexpression", "assignments", COEX)(lambda df: usage.coexpression(df, "V", "J"))
BYGENE = "select {g} as gene, {c} as allele, count from (select *, max(count) over (partition by {g}) as top from (select {c}, split_part({c}, '*', 1) as {g}, count(*) as count from {A} where {c} <> '' group by 1, 2)) where count >= 0.1 * top"
query("expression_by_gene", "assignments", BYGENE.format(g="gg", c="j_call", A=A))(lambda df: usage.expression_by_gene(df, "J"))
query("het_genes", "assignments", f"select gene, list(allele order by count desc, allele) as alleles, cast(sum(count) as bigint) as total from ({BYGENE.format(g='gg', c='j_call', A=A)}) group by 1 having count(*) = 2 order by total desc, gene limit 5")(lambda df: usage.heterozygous(usage.expression_by_gene(df, "J")))

HET = ("IGHJ1*01", "IGHJ1*02")
HAPLO = f"""
with co as (select v_call as allele, cast(count(*) filter (j_call = '{HET[0]}') as bigint) as c1, cast(count(*) filter (j_call = '{HET[1]}') as bigint) as c2 from {A} where v_call <> '' and j_call <> '' group by 1),
t as (select e.*, coalesce(c1, 0) as c1, coalesce(c2, 0) as c2, coalesce(c1, 0) / (coalesce(c1, 0) + coalesce(c2, 0) + 1) >= 0.1 as r1, coalesce(c2, 0) / (coalesce(c1, 0) + coalesce(c2, 0) + 1) >= 0.1 as r2
  from ({BYGENE.format(g='gg', c='v_call', A=A)}) e left join co using (allele)),
k as (select *, row_number() over (partition by gene order by count desc, allele) as place from t where r1 or r2),
n as (select gene, count(*) as n, sum(r1::int + r2::int) as tr, bool_or(r1 <> r2) as single,
  count(*) = 2 and bool_and(case place when 1 then r1 and not r2 else r2 and not r1 end) as straight,
  count(*) = 2 and bool_and(case place when 1 then r2 and not r1 else r1 and not r2 end) as crossed,
  max(case place when 1 then allele end) as a1, max(case place when 2 then allele end) as a2, max(case place when 1 then c1 end) as p1, max(case place when 1 then c2 end) as p2, max(case place when 2 then c1 end) as q1, max(case place when 2 then c2 end) as q2 from k group by gene)
select gene, place, case when straight then a1 when crossed then a2 when r1 then allele else '' end as haplotype1,
  case when straight then a2 when crossed then a1 when r2 then allele else '' end as haplotype2,
  case when n = 1 then case when r1 and r2 then 'homozygous' else 'deletion' end when straight or crossed then 'heterozygous' when single and tr > 2 then 'duplication' else 'unknown' end as type,
  case when straight then p1 when crossed then p2 else c1 end as count1, case when straight then q2 when crossed then q1 else c2 end as count2
from k join n using (gene) where not (straight or crossed) or place = 1
"""
query("haplotype_entries", "assignments", HAPLO)(lambda df: haplotypes.entries(usage.coexpression(df, "J", "V"), usage.expression_by_gene(df, "V"), HET, "J", "V"))

# clonotypes ----------------------------------------------------------------------------------------------------------

CLONES = """
with recursive rows as (select * from {a} where {where}),
nodes as (select v_call, j_call, cdr3, min(row_id) as node from rows group by 1, 2, 3),
links as (select x.node as a, y.node as b from nodes x join nodes y on x.v_call = y.v_call and x.j_call = y.j_call and {near}),
walk as (select node as a, node as b from nodes union select walk.a, links.b from walk join links on walk.b = links.a),
comp as (select a as node, min(b) as clonotype_id from walk group by 1),
members as (select rows.*, clonotype_id from rows join nodes using (v_call, j_call, cdr3) join comp using (node))
"""
HAM1 = "length(x.cdr3) = length(y.cdr3) and x.node <> y.node and hamming(x.cdr3, y.cdr3) <= {m}"
CALLED = "v_call <> '' and j_call <> '' and cdr3 <> ''"
ONE = CLONES.format(a=A, where=f"{ALL} and cdr3 <> ''", near=HAM1.format(m=1))
REP = "select clonotype_id, clonotype_size, row_id, v_call, j_call, cdr3, V_SHM from (select *, count(*) over (partition by clonotype_id) as clonotype_size, row_number() over (partition by clonotype_id order by V_SHM, row_id) as n from members) where n = 1"
CLONE = ("clonotype_id", "clonotype_size", "row_id", "v_call", "j_call", "cdr3", "V_SHM")
query("clonotypes", "assignments", ONE + REP)(lambda df: clonotypes.call(filters.filter_table(df)).select(*CLONE))
query("clonotypes_all", "assignments", CLONES.format(a=A, where=CALLED, near=HAM1.format(m=2)) + REP)(lambda df: clonotypes.call(df, 2).select(*CLONE))
query("clonotypes_exact", "assignments", CLONES.format(a=A, where=CALLED, near=HAM1.format(m=0)) + REP)(lambda df: clonotypes.call(df, 0).select(*CLONE))
query("clonotypes_sorted", "assignments", ONE + f"select * from ({REP}) order by clonotype_size desc, clonotype_id limit 20")(lambda df: clonotypes.by_size(clonotypes.call(filters.filter_table(df)).select(*CLONE)).limit(20))
query("clonotype_members", "assignments", ONE + "select clonotype_id, row_id from members")(lambda df: clonotypes.members(filters.filter_table(df)).select("clonotype_id", "row_id"))
DIVERGENCE = """, best as (select clonotype_id, count(*) as n, arg_min(cdr3, (V_SHM, row_id)) as ref, min(V_SHM) as shm from members group by 1)
select row_id, clonotype_id, case when n > 1 and shm <= 5 then 100.0e0 * levenshtein(cdr3, ref) / length(ref) end as mindiffrate from members join best using (clonotype_id)"""
query("clonotype_divergence", "assignments", ONE.rstrip() + DIVERGENCE)(lambda df: clonotypes.divergence(filters.filter_table(df)).select("row_id", "clonotype_id", F.nanvl("CDR3_nt_mindiffrate", F.lit(None)).alias("mindiffrate")))
EDIT = CLONES.format(a=A, where="cdr3 <> '' and v_call <> ''", near="x.node <> y.node and levenshtein(x.cdr3, y.cdr3) <= 6")
query("count_clonotypes", "assignments", EDIT + "select v_call, count(distinct clonotype_id) as clonotypes from members group by 1")(lambda df: clonotypes.count_by_edits(df.filter("v_call <> ''"), ["v_call"]))

# clonoquery ----------------------------------------------------------------------------------------------------------

APART = "case when q.cdr3 = '' then 0 else hamming(q.cdr3, r.cdr3) end"
PAIRS = f"select q.row_id as query_id, r.row_id as row_id, r.V_SHM from (select * from {A}) q join (select * from {A}) r on q.v_call = r.v_call and q.j_call = r.j_call and length(q.cdr3) = length(r.cdr3) where q.v_call <> '' and q.row_id % 20 = 0 and {{near}}"


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query rows of a search, whose ids are divisible by 20, and all rows."""
    return df.filter("row_id % 20 = 0"), df


def _found(df: DataFrame, mismatches: float, core: clonoquery.Core | None = None) -> DataFrame:
    return clonoquery.matches(*_split(df), mismatches, core).select("query_id", "row_id", "V_SHM")


query("clonoquery", "assignments", PAIRS.format(near=f"{APART} <= 1"))(lambda df: _found(df, 1))
query("clonoquery_frac", "assignments", PAIRS.format(near=f"{APART} <= floor(0.2e0 * length(q.cdr3))"))(lambda df: _found(df, 0.2))
query("clonoquery_core", "assignments", PAIRS.format(near=f"{APART} <= 3 and (substr(q.cdr3, 1, 4) = substr(r.cdr3, 1, 4) or substr(q.cdr3, 9) = substr(r.cdr3, 9))"))(lambda df: _found(df, 3, clonoquery.Core(4, 8)))
query("clonoquery_summary", "assignments", f"select q.row_id as query_id, count(m.row_id) as size, coalesce(round_even(avg(m.V_SHM), 2), 0) as \"avg_V_SHM\" from {A.replace(') assignments', ') q')} left join ({PAIRS.format(near=APART + ' <= 1')}) m on m.query_id = q.row_id where q.v_call <> '' and q.row_id % 20 = 0 group by 1")(
    lambda df: clonoquery.summary(_split(df)[0], _found(df, 1))
)

# copies --------------------------------------------------------------------------------------------------------------

query("dereplicate", "reads", f"select '' as barcode, sequence, arg_min(name, ord) as name, count(*) as size, min(ord) as first from {R} group by sequence")(copies.dereplicate)
query("dereplicate_barcode", "reads", f"select barcode, regexp_replace(rest, '^[Gg]+', '') as sequence, arg_min(name, ord) as name, count(*) as size, min(ord) as first from (select *, substr(sequence, 1, 6) as barcode, substr(sequence, 7) as rest from {R} where length(sequence) >= 28) group by 1, 2")(lambda df: copies.dereplicate(df, 6, True, 28))
query("dereplicated_headers", "reads", f"select concat(arg_min(name, ord), ';barcode=', substr(sequence, 1, 6), ';size=', count(*), ';') as header from {R} group by substr(sequence, 1, 6), substr(sequence, 7)")(lambda df: copies.dereplicate(df, 6).select(copies.dereplicated_header().alias("header")))
query("trim_g", "reads", f"select ord, regexp_replace(substr(sequence, 7), '^[Gg]+', '') as sequence from {R} where regexp_replace(substr(sequence, 7), '^[Gg]+', '') <> ''")(lambda df: copies.trim_g(df.withColumn("sequence", F.expr("substr(sequence, 7)"))).select("ord", "sequence"))
SESSION = f"select ord, barcode, 1 + cast(sum(jump) over (partition by barcode order by n, ord) as bigint) as session from (select *, case when n - lag(n) over (partition by barcode order by n, ord) > 2 then 1 else 0 end as jump from (select ord, substr(sequence, 1, 6) as barcode, length(sequence) - 6 as n from {R}))"
query("length_sessions", "reads", SESSION)(lambda df: copies.length_sessions(copies.barcoded(df, 6), ["barcode"]).select("ord", "barcode", "session"))
query("barcode_groups", "reads", f"select concat(arg_min(name, ord), ';barcode=', substr(sequence, 1, 6), ';size=', count(*), ';') as header, arg_min(regexp_replace(substr(sequence, 7), '^[Gg]+', ''), ord) as sequence, count(*) as size from {R} group by substr(sequence, 1, 6)")(
    lambda df: copies.group_reads(df, 6, trim_g=True, consensus=False)
)
query("barcode_consensus", "reads")(lambda df: copies.group_reads(df, 6, trim_g=True))

# strings -------------------------------------------------------------------------------------------------------------


def _c(name: str) -> Column:
    return F.col(name)


def expression(name: str, text: str, made: Callable[[], dict[str, Column]]) -> None:
    """A query of expressions over the strings."""
    query(name, "strings", f"select row_id, {text} from {S}")(lambda df: df.select("row_id", *(c.alias(n) for n, c in made().items())))


# The standard genetic code by amino acid, apart from the library's own table.
OF_AMINO = {
    "F": "TTT TTC", "L": "TTA TTG CTT CTC CTA CTG", "I": "ATT ATC ATA", "M": "ATG", "V": "GTT GTC GTA GTG", "S": "TCT TCC TCA TCG AGT AGC", "P": "CCT CCC CCA CCG", "T": "ACT ACC ACA ACG",
    "A": "GCT GCC GCA GCG", "Y": "TAT TAC", "*": "TAA TAG TGA", "H": "CAT CAC", "Q": "CAA CAG", "N": "AAT AAC", "K": "AAA AAG", "D": "GAT GAC", "E": "GAA GAG", "C": "TGT TGC", "W": "TGG",
    "R": "CGT CGC CGA CGG AGA AGG", "G": "GGT GGC GGA GGG",
}
CODONS = "map {" + ", ".join(f"'{c}': '{a}'" for a, cs in OF_AMINO.items() for c in cs.split()) + "}"
AMINO = f"array_to_string(list_transform(range(0, length(s) // 3), lambda i: ({CODONS})[substr(s, 3 * i + 1, 3)]), '')"
expression("translate", f"{AMINO} as aa, contains({AMINO}, '*') as stop", lambda: dict(aa=sequence.translate(_c("s")), stop=sequence.has_stop(_c("s"))))
expression("reverse_complement", "reverse(translate(s, 'ACGT', 'TGCA')) as rc", lambda: dict(rc=sequence.reverse_complement(_c("s"))))
expression("edit_distance", "cast(levenshtein(s, t) as int) as d, cast(least(levenshtein(substr(s, 1, 12), substr(s, 9, 12)), 5) as int) as capped, cast(hamming(s, t) as int) as h", lambda: dict(d=sequence.edit_distance(_c("s"), _c("t")), capped=sequence.edit_distance(F.substring("s", 1, 12), F.substring("s", 9, 12), 4), h=sequence.hamming(_c("s"), _c("t"))))
HASH = "concat('S', lpad(cast(cast(concat('0x', right(sha256(s), 4)) as int) % 10000 as varchar), 4, '0'))"
expression("seq_hash", f"{HASH} as hash, concat(split_part(name, '_S', 1), '_', {HASH}) as unique_name", lambda: dict(hash=sequence.sequence_hash(_c("s")), unique_name=sequence.unique_name(_c("name"), _c("s"))))
expression("gene_family", "split_part(name, '*', 1) as gene, split_part(name, '*', 2) as allele", lambda: dict(gene=names.gene_of(_c("name")), allele=names.allele_of(_c("name"))))
expression("header_parse", "split_part(header, ';', 1) as name, coalesce(try_cast(nullif(regexp_extract(header, ';size=([0-9]+)', 1), '') as bigint), 0) as size, regexp_extract(header, ';barcode=([^;]*)', 1) as barcode", lambda: dict(name=names.header_name(_c("header")), size=names.header_size(_c("header")), barcode=names.header_barcode(_c("header"))))
expression("header_allele", "case when contains(bars, '|') then split_part(bars, '|', 2) else bars end as allele, upper(replace(dotted, '.', '')) as bases, regexp_replace(upper(dotted), '[^ACGTUN]', 'N', 'g') as clean", lambda: dict(allele=names.allele_of_header(_c("bars")), bases=sequence.sanitize_gapped(_c("dotted")), clean=sequence.sanitize_nucleotides(_c("dotted"))))
expression("natural_key", "array_to_string(list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda p: case when regexp_matches(p, '^[0-9]') then lpad(p, 12, '0') else p end), '') as natural_key", lambda: dict(natural_key=names.natural_key(_c("name"))))
expression("group_header", "concat(name, ';barcode=', substr(s, 1, 4), ';size=', row_id, ';') as h, concat(name, ';barcode=', substr(s, 1, 4), ';cdr3=', substr(t, 1, 5), ';size=', row_id, ';') as hc", lambda: dict(h=names.group_header(_c("name"), F.substring("s", 1, 4), _c("row_id")), hc=names.group_header(_c("name"), F.substring("s", 1, 4), _c("row_id"), F.substring("t", 1, 5))))
expression("pseudo_cdr3", "substr(s, length(s) - 40 + 1, 20) as c", lambda: dict(c=sequence.pseudo_cdr3(_c("s"), 40, 20)))


def _barcodes() -> dict[str, Column]:
    five, three, short = sequence.barcode_of_group(_c("s"), 8), sequence.barcode_of_group(_c("s"), -8), sequence.barcode_of_copy(F.substring("s", 1, 5), 8)
    return {"five": five[0], "five_rest": five[1], "three": three[0], "three_rest": three[1], "short": short[0], "short_rest": short[1]}


expression("barcodes", "substr(s, 1, 8) as five, substr(s, 9) as five_rest, right(s, 8) as three, left(s, length(s) - 8) as three_rest, substr(s, 1, 5) as short, '' as short_rest", _barcodes)
MERGE = "case when list_bool_or(list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1) <> substr(t, i, 1) and substr(t, i, 1) <> 'N')) then null else s end"
expression("merge_n", f"{MERGE} as merged", lambda: dict(merged=sequence.merge_n(_c("s"), _c("t"))))
ZIP = "least(length(g), length(q))"
expression("alignment_errors", f"cast(len(list_filter(range(1, {ZIP} + 1), lambda i: substr(g, i, 1) <> substr(q, i, 1))) as bigint) as errors, 100.0e0 * length(replace(g, '-', '')) / 20 as coverage", lambda: dict(errors=alignment.errors(_c("g"), _c("q")), coverage=alignment.coverage(_c("g"), F.lit(20))))
GAP = "length(replace(substr(g, 1, i), '-', ''))"
expression("query_position", f"coalesce(list_transform(list_filter(range(0, {ZIP} + 1), lambda i: {GAP} = 7)[1:1], lambda i: length(replace(substr(q, 1, i), '-', '')) + 4)[1], -1) as position", lambda: dict(position=alignment.query_position(F.lit(1), F.lit(5), _c("g"), _c("q"), F.lit(7))))
TAIL = f"right({AMINO}, 15)"
HEAVY = r"regexp_extract({x}, '[FY][FHVWY]C([ADEGIKMNRSTV*]|$)')"
expression("cdr3_anchor_k", f"cast(case when regexp_matches({TAIL}, '[FSVY][CFHNVY][CDFGLSW]') then 3 * (length({AMINO}) - length({TAIL}) + strpos({TAIL}, regexp_extract({TAIL}, '[FSVY][CFHNVY][CDFGLSW]')) + 2) else 0 end as int) as start", lambda: dict(start=cdr3.start_in_v(_c("s"), "IGK")))
expression("cdr3_anchor_b", f"cast(case when contains(right({AMINO}, 8), 'C') then 3 * (length({AMINO}) - length(right({AMINO}, 8)) + strpos(right({AMINO}, 8), 'C')) else 0 end as int) as start", lambda: dict(start=cdr3.start_in_v(_c("s"), "TRB")))
FRAMES = [AMINO.replace("substr(s,", f"substr(substr(s, {f + 1}),").replace("length(s)", f"(length(s) - {f})") for f in range(3)]
expression("cdr3_end", "cast(coalesce(" + ", ".join(f"case when strpos({a}, 'FG') > 0 then (strpos({a}, 'FG') - 1) * 3 + {f} end" for f, a in enumerate(FRAMES)) + ", 0) as int) as stop", lambda: dict(stop=cdr3.end_in_j(_c("s"), "IGK")))
LIGHT = "regexp_matches(substr({a}, i, 3), '^[CDY][CFHSY][CFGW]$') and not regexp_matches(substr({a}, i + 1, 3), '^[CDY][CFHSY][CFGW]$')"  # a lookahead by places


def _read_sql(a: str, f: int, locus: str) -> str:
    """struct(start, end) of the CDR3 in frame f, whose amino acids are column a."""
    if locus == "IGL":
        return f"(list_transform(list_filter(range(1, length({a}) + 1), lambda i: {LIGHT.format(a=a)} and regexp_matches(substr({a}, i + 3), '^.{{4,15}}[FS]G')), lambda i: {{{{'start': 3 * (i + 2) + {f}, 'end': 3 * (i + 2 + length(regexp_extract(substr({a}, i + 3), '^(.{{4,15}})[FS]G', 1))) + {f}}}}}))[1]".replace("{{", "{").replace("}}", "}")
    found = []
    for lead, inner, tail in {"IGH": [("[FY][FHVWY]C", "[ADEGIKMNRSTV].{3,31}", "W[GAV]"), ("C", ".[RK].{3,30}", "[WF]G.G")], "IGK": [("[FSVY][CFHNVY][CDFGLSW]", ".{4,15}", "[FLV][GRV]")]}[locus]:
        whole = f"regexp_extract({a}, '{lead}{inner}{tail}')"
        start = f"(strpos({a}, {whole}) - 1 + {len(lead.split(']')) - 1 + lead.count('C') if lead[-1] == 'C' else 3})"
        found.append(f"case when {whole} <> '' then {{'start': 3 * {start} + {f}, 'end': 3 * ({start} + length(regexp_extract({a}, '{lead}({inner}){tail}', 1))) + {f}}} end")
    return f"coalesce({', '.join(found)})"


def _best_sql(locus: str) -> str:
    return f"coalesce(list_min(list_filter([{', '.join(_read_sql(f'a{f}', f, locus) for f in range(3))}], lambda x: x is not null)), {{'start': 0, 'end': 0}})"


AMINOS = f"(select row_id, {', '.join(f'{x} as a{f}' for f, x in enumerate(FRAMES))} from {S})"
READS_SQL = "select row_id, " + ", ".join(f"cast({k}.start as int) as {k}_start, cast({k}.end as int) as {k}_end" for k in ("heavy", "kappa", "lambda_")) + f" from (select row_id, {_best_sql('IGH')} as heavy, {_best_sql('IGK')} as kappa, {_best_sql('IGL')} as lambda_ from {AMINOS})"


def _in_reads(df: DataFrame) -> DataFrame:
    made = df.select("row_id", *(cdr3.find_in_read(_c("s"), x).alias(n) for n, x in (("heavy", "IGH"), ("kappa", "IGK"), ("lambda_", "IGL"))))
    return made.select("row_id", *(F.col(f"{n}.{e}").alias(f"{n}_{e}") for n in ("heavy", "kappa", "lambda_") for e in ("start", "end")))


query("cdr3_in_reads", "strings", READS_SQL)(_in_reads)
T15, H15, T8 = "right(a0, 15)", "length(a0) - length(right(a0, 15))", "right(a0, 8)"


def _after(pattern: str) -> str:
    """Bases before the end of a pattern's first match in the tail."""
    return f"case when regexp_matches({T15}, '{pattern}') then 3 * ({H15} + strpos({T15}, regexp_extract({T15}, '{pattern}')) - 1 + length(regexp_extract({T15}, '{pattern}'))) end"


HEAVY_V = f"case when regexp_matches({T15}, '[FY][FHVWY]C([ADEGIKMNRSTV*]|$)') then 3 * ({H15} + case when regexp_extract({T15}, '[FY][FHVWY]C([ADEGIKMNRSTV*]|$)', 1) = '' then length({T15}) else strpos({T15}, regexp_extract({T15}, '[FY][FHVWY]C([ADEGIKMNRSTV*]|$)')) + 2 end) when regexp_matches({T15}, 'C.[RK]') then 3 * ({H15} + strpos({T15}, regexp_extract({T15}, 'C.[RK]'))) end"
LIGHT_V = f"3 * ({H15} + (list_filter(range(1, length({T15}) + 1), lambda i: {LIGHT.format(a=T15)}))[1] + 2)"
V_SQL = {"IGH": HEAVY_V, "IGK": _after("[FSVY][CFHNVY][CDFGLSW]"), "IGL": LIGHT_V, "TRA": f"case when contains({T8}, 'C') then 3 * (length(a0) - length({T8}) + strpos({T8}, 'C')) end", "TRG": _after("[YFH]C"), "TRD": _after("[YFH]C")}
V_SQL["TRB"] = V_SQL["TRA"]


def _j_sql(pattern: str) -> str:
    return "coalesce(" + ", ".join(f"case when regexp_matches(a{f}, '{pattern}') then 3 * (strpos(a{f}, regexp_extract(a{f}, '{pattern}')) - 1) + {f} end" for f in range(3)) + ", 0)"


ANCHORS = "select row_id, " + ", ".join([*(f"cast(coalesce({V_SQL[x]}, 0) as int) as \"start_{x}\"" for x in cdr3.LOCI), *(f"cast({_j_sql('W[GAV]' if x == 'IGH' else 'FG')} as int) as \"end_{x}\"" for x in cdr3.LOCI)]) + f" from {AMINOS}"
query("cdr3_anchors", "strings", ANCHORS)(lambda df: df.select("row_id", *(cdr3.start_in_v(_c("s"), x).alias(f"start_{x}") for x in cdr3.LOCI), *(cdr3.end_in_j(_c("s"), x).alias(f"end_{x}") for x in cdr3.LOCI)))

# consensus -----------------------------------------------------------------------------------------------------------

CONSENSUS = f"""
with sizes as (select grp, count(*) as n, max(length(row)) as cols from {L} group by 1),
places as (select grp, i, substr(row, i, 1) as b from (select grp, row, unnest(range(1, length(row) + 1)) as i from {L})),
counted as (select grp, i, b, count(*) as c from places group by 1, 2, 3),
columns as (select c.grp, c.i, n, cols - c.i as r, sum(c) filter (b <> '-') as there, {', '.join(f"coalesce(sum(c) filter (b = '{x}'), 0) as n{x}" for x in 'ACGTN')} from counted c join sizes using (grp) group by 1, 2, 3, 4),
active as (select *, n - there as gap, case when r <= 10 then greatest(1, round_even(0.05 * n, 0), max(there) over (partition by grp order by r rows unbounded preceding)) else n end as a from columns),
best as (select *, list_max([(greatest(0, gap - (n - a)), 6, '-'), (nA, 5, 'A'), (nC, 4, 'C'), (nG, 3, 'G'), (nT, 2, 'T'), (nN, 1, 'N')]) as m from active)
select grp, coalesce(string_agg(case when m[1] / (case when r < 10 then a else n end) >= 0.7 then replace(m[3], '-', '') else 'N' end, '' order by i), '') as consensus from best group by 1
"""
query("consensus_columns", "aligned", CONSENSUS)(lambda df: consensus.column_consensus(df, ["grp"], "row"))

# discovery -----------------------------------------------------------------------------------------------------------

LABELS = "list_filter([" + "".join(f"case when V_SHM >= {lo} and V_SHM < {lo + 2} then '{lo}-{lo + 2}' end, " for lo in (0, 2, 4, 6, 8, 10, 12, 14, 16, 18)) + "case when V_SHM >= 0 and V_SHM < 100 then 'all' end], lambda x: x is not null)"
query("window_siblings", "assignments", f"select v_call, w as \"window\", count(*) as n from (select v_call, unnest({LABELS}) as w from {A}) group by 1, 2 having count(*) >= 5")(discovery.sibling_sizes)


def _group_stats(df: DataFrame) -> DataFrame:
    everywhere = df.filter("cdr3 <> ''").groupBy("cdr3").agg(F.count(F.lit(1)).alias("all"))
    own = df.filter("cdr3 <> ''").groupBy("v_call", "cdr3").agg(F.count(F.lit(1)).alias("own"))
    return discovery.group_stats(df, ["v_call"], own.join(everywhere, "cdr3").select("v_call", "cdr3", (F.col("all") - F.col("own")).alias("left")), 70.0, 0)


GROUP_STATS = f"""
with own as (select v_call, cdr3, count(*) as own, sum(count(*)) over (partition by cdr3) - count(*) as rest from {A} where cdr3 <> '' group by 1, 2),
shared as (select v_call, count(*) filter (rest > 0) as s from own group by 1),
base as (select v_call, count(*) as rows, count(distinct nullif(j_call, '')) as "unique_J", count(distinct nullif(cdr3, '')) as "unique_CDR3",
  count(distinct case when D_errors = 0 and D_covered >= 70 and coalesce(d_support, 1e300) <= 1e-4 then nullif(d_call, '') end) as "unique_D",
  count(distinct nullif(barcode, '')) as unique_barcodes, count(distinct (j_call, cdr3)) filter (cdr3 <> '') as clonotypes from {A} group by 1)
select base.*, case when "unique_CDR3" = 0 then 0 else s / "unique_CDR3" end as "shared_CDR3_ratio" from base join shared using (v_call)
"""
query("group_stats", "assignments", GROUP_STATS)(_group_stats)

CRITERIA = GermlineCriteria()
PER_ENTRY = [("too_low_CDR3s_exact", "CDR3s_exact < 5"), ("too_low_Js_exact", "Js_exact < 3"), ("too_high_CDR3_shared_ratio", "cast(CDR3_shared_ratio as double) > 0.8"), ("has_stop", "has_stop <> 0 and whitelist_diff <> 0"), ("too_low_cluster_size", "cluster_size < 50 and whitelist_diff <> 0")]
WHITE = "(select *, case when consensus in (select consensus from {c} where idx % 10 = 1) then 0 else -1 end as whitelist_diff from {c}) w".format(c=C)
ENTRY = "select *, " + " + ".join(f"case when {r} then 1 else 0 end" for _, r in PER_ENTRY) + " as is_filtered, concat(" + ", ".join(f"case when {r} then '{n};' else '' end" for n, r in PER_ENTRY) + f") as why_filtered from {WHITE}"


def _annotated(df: DataFrame) -> DataFrame:
    return germline.annotate(df, CRITERIA, df.filter("idx % 10 = 1").select(F.col("consensus").alias("sequence")))


query("germline_per_entry", "candidates", f"select idx, whitelist_diff, is_filtered, why_filtered from ({ENTRY})")(lambda df: _annotated(df).select("idx", "whitelist_diff", "is_filtered", "why_filtered"))
REL = "x.{c} / r.{c}"
PAIR = f"""
with e as ({ENTRY}),
s as (select *, whitelist_diff = 0 as white, coalesce(database_diff = 0, false) as db, contains(cluster, 'all') or contains(cluster, 'db') as accurate, split_part(name, '*', 1) as gene, substr(consensus, 1, CDR3_start) as cut from e),
p as (select r.idx as ref, x.idx as cand, coalesce(
  case when not x.white and r.cluster_size >= x.cluster_size then case when r.consensus = x.consensus then concat('identical_to=', r.name) when starts_with(r.consensus, x.consensus) then concat('identical_to=', r.name, ',truncated') end end,
  case when r.db and x.db and x.accurate and r.cluster_size + x.cluster_size > 0 and x.cluster_size / (r.cluster_size + x.cluster_size) < 0.02
    and least(levenshtein(left(r.cut, least(length(r.cut), length(x.cut))), left(x.cut, least(length(r.cut), length(x.cut)))), levenshtein(right(r.cut, least(length(r.cut), length(x.cut))), right(x.cut, least(length(r.cut), length(x.cut))))) <= 1
    then concat('xmap_ratio=', printf('%.4f', x.cluster_size / (r.cluster_size + x.cluster_size)), ',other=', r.name) end,
  case when r.gene = x.gene and r.clonotypes > 0 and x.clonotypes / r.clonotypes < 0.12 then concat('clonotype_ratio=', printf('%.4f', x.clonotypes / r.clonotypes), ',other=', r.name) end,
  case when r.gene = x.gene and r.exact > 0 and x.exact / r.exact < 0.12 then concat('ex_occ_ratio=', printf('%.1f', x.exact / r.exact), ',other=', r.name) end,
  case when r.gene = x.gene and x.cluster_size <= r.cluster_size and r.Ds_exact >= 10 and x.Ds_exact / r.Ds_exact < 0.3 then concat('Ds_exact_ratio=', printf('%.1f', x.Ds_exact / r.Ds_exact), ',other=', r.name) end) as reason
  from s r join s x on r.idx <> x.idx where r.is_filtered = 0)
"""
query("germline_pairs", "candidates", PAIR + "select * from p where reason is not null")(lambda df: germline.pair_reasons(_annotated(df), CRITERIA))
FOLD = PAIR.replace("with e as", "with recursive e as", 1) + """,
o as (select *, row_number() over (order by ref, cand) as n from p where reason is not null),
walk as (select cast(0 as bigint) as n, cast([] as struct(cand bigint, reason varchar)[]) as fallen
  union all select o.n, case when len(list_filter(fallen, lambda f: f.cand = o.ref)) > 0 then fallen else list_append(fallen, {'cand': o.cand, 'reason': o.reason}) end from walk join o on o.n = walk.n + 1),
ended as (select fallen from walk order by n desc limit 1)
select idx, cast(is_filtered + len(list_filter(fallen, lambda f: f.cand = idx)) as int) as is_filtered,
  concat(why_filtered, array_to_string(list_transform(list_filter(fallen, lambda f: f.cand = idx), lambda f: concat(f.reason, ';')), '')) as why_filtered from e, ended
"""
query("germline_filtered", "candidates", FOLD)(lambda df: germline.eliminate(_annotated(df), CRITERIA).select("idx", "is_filtered", "why_filtered"))
query("dedup_consensus", "candidates", f"select idx, name, consensus from {C} qualify row_number() over (partition by consensus order by cluster_size desc, name, idx) = 1")(lambda df: germline.best_per_consensus(df).select("idx", "name", "consensus"))
query("unique_names", "candidates", f"select idx, concat(name, case when n > 1 then chr(cast(63 + n as int)) else '' end) as name from (select idx, name, row_number() over (partition by name order by idx) as n from (select idx, concat(name, 'r', cast(floor(idx / 500) as int)) as name from {C}))")(
    lambda df: discovery.unique_names(df.select("idx", F.concat("name", F.lit("r"), F.floor(F.col("idx") / 500).cast("int").cast("string")).alias("name")))
)
query("j_allele_filter", "j_candidates", f"select name, source, exact from {J} qualify exact >= 0.2 * max(exact) over (partition by split_part(source, '*', 1))")(lambda df: discovery.j_allele_ratio(df).select("name", "source", "exact"))
query("j_cross_pairs", "j_candidates", f"with c as (select * from {J}) select r.name as ref, x.name as cand, r.exact as ref_exact from c r join c x on (-r.exact, r.name) < (-x.exact, x.name) where hamming(right(r.consensus, 4), right(x.consensus, 4)) <= 1 and r.exact + x.exact > 0 and x.exact / (r.exact + x.exact) < 0.1")(discovery.j_cross_pairs)
JWALK = f"""
with recursive c as (select * from {J}),
pairs as (select r.name as ref, x.name as cand, row_number() over (order by r.exact desc, r.name, x.name) as n from c r join c x on (-r.exact, r.name) < (-x.exact, x.name)
  where hamming(right(r.consensus, 4), right(x.consensus, 4)) <= 1 and r.exact + x.exact > 0 and x.exact / (r.exact + x.exact) < 0.1),
walk as (select cast(0 as bigint) as n, cast([] as varchar[]) as gone union all select p.n, case when list_contains(gone, p.ref) then gone else list_append(gone, p.cand) end from walk join pairs p on p.n = walk.n + 1)
select name, exact from c where not list_contains((select gone from walk order by n desc limit 1), name)
"""
query("j_cross_map", "j_candidates", JWALK)(lambda df: discovery.j_cross_mapping(df).select("name", "exact"))

# databases -----------------------------------------------------------------------------------------------------------

DA, DB, FOUND, PRE = sql("database_a"), sql("database_b"), sql("found"), sql("prefixes")


def pair(name: str, text: str | None, f: Callable[[DataFrame, DataFrame], DataFrame], a: str = "database_a", b: str = "database_b") -> None:
    _QUERIES[name] = lambda spark, sf_dir: f(view(spark, sf_dir, a), view(spark, sf_dir, b))
    if text:
        _SQL[name] = text


SAME = f"""
with b as (select * from {DB} qualify row_number() over (partition by sequence order by ord desc) = 1),
a as (select *, row_number() over (partition by sequence order by ord) as n from {DA}),
m as (select case when a.name is null then 'only_b' when b.name is null then 'only_a' else 'identical' end as category, a.name as a_name, b.name as b_name, coalesce(a.sequence, b.sequence) as sequence, a.ord as a_ord, b.ord as b_ord
  from a full join b on a.sequence = b.sequence and a.n = 1)
"""
pair("dbdiff_identical", SAME + "select * from m", databases.pair_identical)
COST = "5 * least(hamming(left(x.sequence, k), left(y.sequence, k)), hamming(right(x.sequence, k), right(y.sequence, k))) + greatest(length(x.sequence), length(y.sequence)) - k"


def _rest(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = databases.pair_identical(a, b)
    return tuple(m.filter(f"category = 'only_{s}'").select(F.col(f"{s}_ord").alias("ord"), F.col(f"{s}_name").alias("name"), "sequence") for s in "ab")


pair("dbdiff_similar_cost", SAME + f"select a_ord, b_ord, a_name, b_name, cast(cost as int) as cost from (select x.a_ord, y.b_ord, x.a_name, y.b_name, least(length(x.sequence), length(y.sequence)) as k, {COST} as cost from m x join m y on x.category = 'only_a' and y.category = 'only_b') where cost <= 60", lambda a, b: databases.similar_costs(*_rest(a, b), 60))
pair("db_intersect", f"select distinct sequence from {DA} intersect select sequence from {DB}", lambda a, b: a.select("sequence").intersect(b.select("sequence")))
query("db_duplicates", "database_a", f"select 'name' as kind, name, null as other from {DA} qualify row_number() over (partition by name order by ord) = 2 union all select 'sequence', name, other from (select name, first_value(name) over (partition by sequence order by ord) as other, row_number() over (partition by sequence order by ord) as n from {DA}) where n > 1")(databases.duplicates)
NEAR = f"""
with p as (select f.*, d.name as d, d.ord as dord, levenshtein(f.sequence, d.sequence) as dist from (select * from {FOUND}) f, (select * from {DA}) d),
n as (select *, split_part(d, '*', 1) as gene from p qualify row_number() over (partition by ord order by dist, dord) = 1)
select ord, name, sequence, gene, cast(dist as int) as distance, concat(gene, '*', printf('%02d', row_number() over (partition by gene order by dist, ord))) as new_name from n
"""
pair("rename_nearest", NEAR, databases.rename, "found", "database_a")
query("prefix_pairs", "prefixes", f"with p as (select * from {PRE}) select x.ord as short, y.ord as long from p x join p y on x.ord <> y.ord and starts_with(y.sequence, x.sequence) and (length(x.sequence) < length(y.sequence) or x.ord < y.ord)")(databases.prefix_pairs)
UNION = f"""
with recursive p as (select *, row_number() over (order by ord) as n from {PRE}),
walk as (select cast(0 as bigint) as n, cast([] as struct(name varchar, s varchar)[]) as kept
  union all select p.n, case when len(list_filter(kept, lambda k: starts_with(k.s, p.sequence) or starts_with(p.sequence, k.s))) = 0 then list_append(kept, {{'name': p.name, 's': p.sequence}})
    else list_append(list_filter(kept, lambda k: not (starts_with(k.s, p.sequence) or starts_with(p.sequence, k.s))),
      {{'name': list_filter(kept, lambda k: starts_with(k.s, p.sequence) or starts_with(p.sequence, k.s))[-1].name,
        's': list_max(list_append(list_transform(list_filter(kept, lambda k: starts_with(k.s, p.sequence) or starts_with(p.sequence, k.s)), lambda k: {{'n': length(k.s), 's': k.s}}), {{'n': length(p.sequence), 's': p.sequence}})).s}}) end
  from walk join p on p.n = walk.n + 1)
select u.name as name, u.s as sequence from (select unnest(kept) as u from walk where n = (select max(n) from walk))
"""
query("prefix_union", "prefixes", UNION)(databases.union)
query("distinct_sequences", "prefixes", f"select distinct sequence from {PRE}")(lambda df: df.select("sequence").distinct())

# distances, upstream regions, kernels ----------------------------------------------------------------------------------

DIST = f"with o as (select distinct v_call, cdr3 as a from {A} where cdr3 <> ''), c as (select v_call, max(cast(round_even(0.2e0 * length(a), 0) as int)) as cap from o group by 1) select v_call, x.a, y.a as b, cast(least(levenshtein(x.a, y.a), cap + 1) as int) as d from o x join o y using (v_call) join c using (v_call) where x.a < y.a"
query("distance_matrix", "assignments", DIST)(lambda df: clusterplots.distance_pairs(df.filter("cdr3 <> ''"), "v_call", "cdr3"))
UP = sql("leaders")
query("upstream_longest", "leaders", f"select row_id, v_call, \"UTR\" as target from (select *, (list(length(\"UTR\") order by length(\"UTR\") desc) over (partition by v_call order by length(\"UTR\") desc rows between unbounded preceding and unbounded following)) as ls from {UP} where V_SHM <= 1) where length(\"UTR\") >= ls[least(10, len(ls))]")(lambda df: upstream.long_enough(filters.upstream(df, 1.0)).select("row_id", "v_call", "target"))
query("upstream_target", "leaders", f"select row_id, concat(\"UTR\", leader) as target from {UP}")(lambda df: df.select("row_id", upstream.target(df, "UTR+leader").alias("target")))
query("upstream_consensus", "leaders")(upstream.consensus)
query("cluster_plots", "assignments")(lambda df: clusterplots.clusters(df.withColumn("V_nt", F.col("cdr3")), least=5, ignore_j=True, strict=False).select("gene", "n_sequences", "n_clusters", "clusters"))


EDITED = "case row_id % 3 when 0 then t when 1 then concat(substr(s, 1, 20), substr(s, 24)) else concat(substr(s, 1, 30), 'TTGAC', substr(s, 31)) end"


def _kernel(df: DataFrame) -> DataFrame:
    """Affine alignment and kinds of change of each string and a copy with a substitution, a loss or an insertion."""
    import pandas as pd

    from cloneframe.functions import kernels

    def run(batches):
        for pdf in batches:
            made = kernels.align_many(pdf["s"].tolist(), pdf["e"].tolist())
            yield pd.DataFrame({"row_id": pdf["row_id"], "score": [m[2] for m in made], "errors": [m[3] for m in made], "change": [kernels.describe_rows(m[0], m[1]) for m in made]})

    made = df.select("row_id", "s", F.expr(EDITED).alias("e")).mapInPandas(run, "row_id long, score long, errors long, change string")
    # where a gap may stand in several places, only its kind is defined
    return made.withColumn("change", F.when(F.col("row_id") % 3 == 0, F.col("change")).otherwise(F.regexp_replace("change", "[^a-z;]", "")))


SUBST = "case when substr(s, 10, 1) = substr(t, 10, 1) then 0 else 1 end"
query("affine_align", "strings", f"select row_id, cast(case row_id % 3 when 0 then length(s) - 4 * {SUBST} when 1 then length(s) - 3 - 8 else length(s) - 10 end as bigint) as score, cast(case row_id % 3 when 0 then {SUBST} when 1 then 3 else 5 end as bigint) as errors, case row_id % 3 when 0 then case when {SUBST} = 0 then '' else concat('10', substr(s, 10, 1), '>', substr(t, 10, 1)) end when 1 then 'del' else 'ins' end as change from {S}")(_kernel)


def _pseudo_reads(df: DataFrame) -> DataFrame:
    """Assignments with V_nt and J_nt made of their genes' names; two V reads in three have another base."""
    gene = F.expr("translate(md5(v_call), '0123456789abcdef', 'ACGTACGTACGTACGT')")
    read = F.when(F.col("row_id") % 3 == 0, gene).otherwise(F.concat(F.substring(gene, 1, 9), F.expr("substr('ACGT', cast(row_id % 4 + 1 as int), 1)"), F.substring(gene, 11, 22)))
    rows = df.withColumns({"V_nt": read, "V_CDR3_start": F.lit(28).cast("long"), "locus": F.lit("IGH"), "J_nt": F.expr("translate(md5(j_call), '0123456789abcdef', 'ACGTACGTACGTACGT')"), "gene": gene})
    return rows


def _discover(df: DataFrame, j: bool = False) -> DataFrame:
    """Alleles of the assignments' genes."""
    rows = _pseudo_reads(df)
    if j:
        db = df.filter("j_call <> ''").select(F.col("j_call").alias("name"), F.expr("translate(md5(j_call), '0123456789abcdef', 'ACGTACGTACGTACGT')").alias("sequence")).distinct()
        return discovery.discover_j(rows, db)
    db = rows.select(F.col("v_call").alias("name"), F.col("gene").alias("sequence")).distinct()
    return discovery.discover_v(rows, db)


query("discover_v", "assignments")(_discover)
J_NT = "translate(md5({x}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
J_FOUND = f"(select j_call as name, j_call as source, count(*) as exact, count(distinct nullif(cdr3, '')) as \"CDR3s_exact\", {J_NT.format(x='j_call')} as consensus from {A} where j_call <> '' and J_errors = 0 group by 1 having count(*) >= 3)"
query("discover_j", "assignments", JWALK.replace(f"c as (select * from {J})", f"c as (select * from {J_FOUND} qualify exact >= 0.2 * max(exact) over (partition by split_part(source, '*', 1)))").replace("select name, exact from c", "select * from c"))(lambda df: _discover(df, True))
HAPLOTYPE_COLUMNS = "block int, gene_type string, haplotype1 string, haplotype2 string, type string, count1 long, count2 long"


def _haplotypes(df: DataFrame) -> DataFrame:
    blocks = haplotypes.analyse(df)
    return df.sparkSession.createDataFrame([(i, b.gene_type, *r) for i, b in enumerate(blocks) for r in b.rows], HAPLOTYPE_COLUMNS)


query("haplotypes", "assignments")(_haplotypes)


GENE_NT = "concat(translate(md5(concat('{p}', cast({k} as {{S}}))), '0123456789abcdef', 'ACGTACGTACGTACGT'), translate(md5(concat('{p}+', cast({k} as {{S}}))), '0123456789abcdef', 'ACGTACGTACGTACGT'))"
V_GENE, J_GENE, D_GENE = GENE_NT.format(p="V", k="row_id % 60"), f"substr({GENE_NT.format(p='J', k='row_id % 31')}, 1, 40)", f"substr({GENE_NT.format(p='D', k='row_id % 11')}, 1, 14)"


def _assign(df: DataFrame) -> DataFrame:
    """Assignment of a read of each row, made of one of 60 V genes, one of 11 D and one of 31 J genes."""
    at = lambda e: F.expr(e.replace("{S}", "string"))
    genes = [df.sparkSession.range(n).withColumnRenamed("id", "row_id").select(F.concat(F.lit(f"IGH{p}"), F.col("row_id").cast("string"), F.lit("*01")).alias("name"), at(e).alias("sequence")) for p, n, e in (("V", 60, V_GENE), ("D", 11, D_GENE), ("J", 31, J_GENE))]
    reads = df.select(F.concat(F.lit("read"), F.col("row_id").cast("string")).alias("name"), F.concat(at(V_GENE), F.lit("AC"), at(D_GENE), F.lit("CA"), at(J_GENE)).alias("sequence"))
    return assign.assign(reads, *genes).select("sequence_id", "v_call", "j_call", "v_identity", "j_identity")


query("assign_vdj", "strings", f"select concat('read', row_id) as sequence_id, concat('IGHV', row_id % 60, '*01') as v_call, concat('IGHJ', row_id % 31, '*01') as j_call, 100.0e0 as v_identity, 100.0e0 as j_identity from {S}")(_assign)
