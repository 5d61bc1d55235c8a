"""Haplotypes from co-expression with heterozygous genes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneframe.functions.names import allele_of, call_column, gene_of
from cloneframe.operators import filters, usage

EXPRESSED = 0.1


def entries(coexpressed: DataFrame, targets: DataFrame, het: tuple[str, str], het_type: str, target_type: str, strict: bool = True) -> DataFrame:
    """(gene, place, haplotype1, haplotype2, type, count1, count2) of the target genes' alleles.

    coexpressed has counts by (het call, target call), targets (gene, allele, count). strict keeps the published order
    of counts where the second allele is on the first haplotype.
    """
    h, t = call_column(het_type), call_column(target_type)
    by = coexpressed.groupBy(F.col(t).alias("allele")).agg(*(F.sum(F.when(F.col(h) == a, F.col("count")).otherwise(0)).alias(f"c{i}") for i, a in enumerate(het, 1)))
    rows = targets.join(by, "allele", "left").na.fill(0, ["c1", "c2"])
    total = F.col("c1") + F.col("c2") + 1
    rows = rows.withColumns({"r1": F.col("c1") / total >= EXPRESSED, "r2": F.col("c2") / total >= EXPRESSED}).filter("r1 or r2")
    w = Window.partitionBy("gene")
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("count"), "allele")))
    rows = rows.withColumn("list", F.sort_array(F.collect_list(F.struct("place", "r1", "r2", "allele", "c1", "c2")).over(w)))
    n = F.size("list")
    flag = lambda i, a, b: (F.get("list", F.lit(i))["r1"] == a) & (F.get("list", F.lit(i))["r2"] == b)
    straight = (n == 2) & flag(0, True, False) & flag(1, False, True)
    crossed = (n == 2) & flag(0, False, True) & flag(1, True, False)
    single = F.exists("list", lambda x: x["r1"] != x["r2"])
    true = F.aggregate("list", F.lit(0), lambda s, x: s + x["r1"].cast("int") + x["r2"].cast("int"))
    kind = (
        F.when(n == 1, F.when(F.col("r1") & F.col("r2"), "homozygous").otherwise("deletion"))
        .when(straight | crossed, "heterozygous")
        .when(single & (true > 2), "duplication")
        .otherwise("unknown")
    )
    item = lambda i, c: F.get("list", F.lit(i))[c]
    pair = straight | crossed
    one = F.when(straight, item(0, "allele")).when(crossed, item(1, "allele")).when(F.col("r1"), F.col("allele")).otherwise("")
    two = F.when(straight, item(1, "allele")).when(crossed, item(0, "allele")).when(F.col("r2"), F.col("allele")).otherwise("")
    crossed_counts = (item(0, "c2"), item(1, "c1")) if strict else (item(1, "c1"), item(0, "c2"))
    count1 = F.when(straight, item(0, "c1")).when(crossed, crossed_counts[0]).otherwise(F.col("c1"))
    count2 = F.when(straight, item(1, "c2")).when(crossed, crossed_counts[1]).otherwise(F.col("c2"))
    return rows.filter(~pair | (F.col("place") == 1)).select("gene", "place", one.alias("haplotype1"), two.alias("haplotype2"), kind.alias("type"), count1.alias("count1"), count2.alias("count2"))


def in_order(rows: DataFrame, genes: list[str]) -> DataFrame:
    """Rows by a list of genes, then by allele number; unknown genes last, alleles without a number as 999."""
    name: Column = F.when(F.col("haplotype1") != "", F.col("haplotype1")).otherwise(F.col("haplotype2"))
    place = F.create_map(*(F.lit(v) for i, g in enumerate(genes) for v in (g, i)))
    number = F.when(allele_of(name).rlike("^[0-9]+$"), allele_of(name).cast("int")).otherwise(999)
    return rows.orderBy(F.coalesce(place[gene_of(name)], F.lit(1_000_000)), number)


@dataclass
class Block:
    """Haplotypes of one gene type by a heterozygous gene's two alleles."""

    gene_type: str
    het: tuple[str, str]
    rows: list[tuple] = field(default_factory=list)  # haplotype1, haplotype2, type, count1, count2

    def switch(self) -> None:
        self.het = self.het[::-1]
        self.rows = [(b, a, k, m, n) for a, b, k, n, m in self.rows]

    # The column names and the comment line.
    def tsv(self, header: bool = False) -> str:
        top = ["\t".join(("haplotype1", "haplotype2", "type", "count1", "count2"))] if header else []
        return "\n".join([*top, f"# {self.gene_type} haplotype from {self.het[0]} and {self.het[1]}", *("\t".join(map(str, r)) for r in self.rows)]) + "\n"


def analyse(df: DataFrame, d_evalue: float = 1e-4, d_coverage: float = 65.0, restrict: DataFrame | None = None, genes: list[str] | None = None, v_gene: str | None = None, strict: bool = True) -> list[Block]:
    """Blocks J by V, D by J and V by J of the first pair of heterozygous J and V genes without a conflict (the last
    pair without any). Aggregates come from Spark; at most 25 pairs of genes are looked at."""
    rows = filters.haplotype(df, d_evalue, d_coverage)
    if restrict is not None:
        rows = filters.restrict(rows, restrict)
    rows = rows.persist()
    try:
        return _search(rows, genes, v_gene, strict)
    finally:
        rows.unpersist()


def _search(rows: DataFrame, genes: list[str] | None, v_gene: str | None, strict: bool) -> list[Block]:
    expressed = {g: usage.expression_by_gene(rows, g) for g in "VDJ"}
    hets = {g: [tuple(r.alleles) for r in usage.heterozygous(expressed[g]).collect()] or [None] for g in "VJ"}
    if v_gene:
        named = [tuple(r.alleles) for r in usage.heterozygous(expressed["V"], 10_000).collect() if v_gene == r.gene or v_gene in r.alleles]
        hets["V"] = named or hets["V"]
    best: list[Block] = []
    for j in hets["J"]:
        for v in hets["V"]:
            het = {"V": v, "J": j}
            blocks = []
            for target, by in (("J", "V"), ("D", "J"), ("V", "J")):
                if het[by] is None:
                    continue
                found = entries(usage.coexpression(rows, by, target), expressed[target], het[by], by, target, strict)
                found = in_order(found, genes) if genes else found.orderBy("gene", "place")
                blocks.append(Block(target, het[by], [tuple(r) for r in found.select("haplotype1", "haplotype2", "type", "count1", "count2").collect()]))
            used = {a for pair in (v, j) if pair for a in pair}
            conflict = any(name in used and k != "heterozygous" for b in blocks if b.gene_type != "D" for x, y, k, *_ in b.rows for name in (x, y))
            if not best or not conflict:
                best = blocks
            if not conflict:
                return _phase(best)
    return _phase(best)


def _phase(blocks: list[Block]) -> list[Block]:
    """J's haplotypes are switched where they name V's heterozygous pair in the other order."""
    if len(blocks) == 3 and any((x, y) == blocks[2].het[::-1] for x, y, *_ in blocks[0].rows):
        blocks[0].switch()
    return blocks
