"""Command line: python -m cloneframe.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneframe import __version__
from cloneframe.functions.names import natural_key
from cloneframe.operators import clonoquery, clonotypes, clusterplots, copies, databases, filters, haplotypes, merging, upstream, usage
from cloneframe.plans import pipeline
from cloneframe.session import session
from cloneframe.sources import config, fastx, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cloneframe")
    p.add_argument("--master", default=None, help="Spark master; the environment's by default")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *files: str, **options) -> None:
        q = sub.add_parser(name, help=text)
        for f in files:
            q.add_argument(f)
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            if isinstance(v, bool):
                q.add_argument(flag, action="store_true")
            else:
                q.add_argument(flag, default=v, type=str if v is None else type(v))

    add("init", "lay down a run's folder", "folder", "reads", database="database")
    add("run", "run a folder's pipeline", "folder")
    add("clonotypes", "call clonotypes", "table", "out", mismatches=1.0, limit=0, members=None, sort=False, mindiffrate=False)
    add("clonoquery", "find a query's clonotypes in a table", "table", "query", "out", mismatches=1.0, minimum_count=0, summary=None)
    add("count", "count expressed genes", "table", "out", gene="V", allele_ratio=0.0, d_evalue=1e-4, d_coverage=70.0, d_errors=0, database=None)
    add("dbdiff", "compare two gene databases", "a", "b")
    add("upstream", "consensus of regions before V", "table", "out", part="UTR", threshold=75.0, max_v_errors=1.0, discard_ambiguous=False)
    add("plotalleles", "co-expression of alleles", "table", "out", alleles="", x="V", gene="J", d_evalue=1e-4, d_coverage=65.0)
    add("haplotype", "haplotypes", "table", d_evalue=1e-4, d_coverage=65.0, restrict=None, order=None, v_gene=None)
    add("clusterplot", "clusters of a gene's sequences", "table", "out", gene_type="V", genes=None, minimum_group_size=200, size=300, ignore_j=False, heatmap=False)
    add("dereplicate", "one read per barcode and sequence", "reads", "out", barcode_length=0, trim_g=False, minimum_length=0, limit=0)
    add("merge", "merge paired reads", "first", "second", "out", program="builtin", threads=4)
    add("union", "union of gene databases", "out")
    sub.choices["union"].add_argument("databases", nargs="+")
    add("version", "the version")
    return p


def _clonotypes(a, spark) -> int:
    df = tables.read_assignments(spark, a.table).withColumn("row_id", F.monotonically_increasing_id())
    m = round(a.mismatches)
    out = clonotypes.by_size(clonotypes.call(df, m)) if a.sort else clonotypes.call(df, m).orderBy("clonotype_id")
    if a.limit:
        out = out.limit(a.limit)
    tables.write_table(out, a.out)
    if a.members:
        found = clonotypes.divergence(df, m) if a.mindiffrate else clonotypes.members(df, m)
        tables.write_text(tables.blocks(found, "clonotype_id", ["row_id"], header=True), a.members)
    return 0


def _clonoquery(a, spark) -> int:
    ref, query = (tables.read_assignments(spark, t).withColumn("row_id", F.monotonically_increasing_id()) for t in (a.table, a.query))
    found = clonoquery.matches(query, ref, a.mismatches, None, a.minimum_count)
    tables.write_text(tables.blocks(found, "query_id", ["row_id"], "# Query: "), a.out)
    if a.summary:
        tables.write_table(clonoquery.summary(query, found), a.summary)
    return 0


def _genes(spark, path: str | None) -> DataFrame | None:
    return fastx.read(spark, path).select("name") if path else None


def _count(a, spark) -> int:
    counts = usage.expression_counts(tables.read_assignments(spark, a.table), a.gene, _genes(spark, a.database), d_evalue=a.d_evalue, d_coverage=a.d_coverage, d_errors=a.d_errors)
    if a.allele_ratio:
        counts = usage.allele_ratio(counts, a.allele_ratio)
    tables.write_table(usage.in_natural_order(counts), a.out)
    return 0


def _dbdiff(a, spark) -> int:
    one, two = (fastx.read(spark, p) for p in (a.a, a.b))
    diff = databases.compare(one, two)
    print(databases.report(diff), end="")
    return databases.exit_code(diff)


def _upstream(a, spark) -> int:
    df = tables.read_assignments(spark, a.table).withColumn("row_id", F.monotonically_increasing_id())
    fastx.write(upstream.consensus(df, a.part, a.threshold, a.max_v_errors, a.discard_ambiguous), a.out, "name")
    return 0


def _plotalleles(a, spark) -> int:
    df = tables.read_assignments(spark, a.table)
    alleles = a.alleles.split(",") if a.alleles else [r[0] for r in usage.allele_totals(df, a.gene).orderBy(natural_key(F.col("allele"))).select("allele").collect()]
    tables.write_table(usage.allele_matrix(df, a.x, a.gene, alleles, d_evalue=a.d_evalue, d_coverage=a.d_coverage), a.out)
    return 0


def _haplotype(a, spark) -> int:
    order = Path(a.order).read_text().split() if a.order else None
    blocks = haplotypes.analyse(tables.read_assignments(spark, a.table), a.d_evalue, a.d_coverage, _genes(spark, a.restrict), order, a.v_gene)
    for i, b in enumerate(blocks):
        print(b.tsv(header=i == 0), end="")
    return 0


def _clusterplot(a, spark) -> int:
    df = tables.read_assignments(spark, a.table).withColumn("row_id", F.monotonically_increasing_id())
    found = clusterplots.clusters(df, a.gene_type, a.genes.split(",") if a.genes else None, a.minimum_group_size, a.size, ignore_j=a.ignore_j)
    tables.write_table(found.select("gene", "n_sequences", "n_clusters"), a.out)
    if a.heatmap:
        for r in found.orderBy("gene").toLocalIterator():
            print(clusterplots.heatmap(r))
    return 0


def _dereplicate(a, spark) -> int:
    made = copies.dereplicate(fastx.read(spark, a.reads, a.limit), a.barcode_length, a.trim_g, a.minimum_length)
    fastx.write(made.select("first", copies.dereplicated_header().alias("name"), "sequence"), a.out, "first")
    return 0


def _merge(a, spark) -> int:
    if a.program == "builtin":
        one, two = (fastx.read(spark, p) for p in (a.first, a.second))
        fastx.write(merging.merge_pairs(one, two), a.out, "name")
    else:
        merged, total = merging.merge_files(a.first, a.second, a.out, a.program, a.threads)
        print(f"{merged} of {total} pairs merged")
    return 0


def _union(a, spark) -> int:
    parts = [fastx.read(spark, p).withColumn("ord", F.col("ord") + i * 10**9) for i, p in enumerate(a.databases)]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    fastx.write(databases.union(every), a.out, "name")
    return 0


def _run(a, spark) -> int:
    kept = pipeline.Run(spark, a.folder, config.load(Path(a.folder, "config.toml"))).run()
    print(filters.filter_stats(kept).first().asDict())
    return 0


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "init":
        pipeline.init(a.folder, *(f"{a.database}/{g}.fasta" for g in "VDJ"), a.reads)
        return 0
    try:
        return globals()[f"_{a.command}"](a, session(a.master))
    except (ValueError, FileNotFoundError) as e:
        print(f"cloneframe: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
