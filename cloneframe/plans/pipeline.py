"""The iterative run: assignments from reads, filters, counts, V and J discovery, germline filters, final database.

A stage is a table in the run's folder. One that has been written in full (_SUCCESS) is read instead of made again, so
a run goes on where it was stopped, and every stage cuts the lineage of those before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneframe.functions.names import call_column
from cloneframe.operators import assign, augment, clonotypes, clusterplots, copies, databases, discovery, filters, germline, usage
from cloneframe.sources import config as cfg
from cloneframe.sources import fastx, tables

EXPRESSION_RATIO = 0.2
READS = ("reads.fasta.gz", "reads.fastq.gz", "reads.fasta", "reads.fastq")


@dataclass
class Run:
    """A run's folder, with database/{V,D,J}.fasta, reads or a rearrangement table, and config.toml."""

    spark: SparkSession
    root: str
    config: cfg.Config

    def done(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self.done(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def database(self, gene: str) -> DataFrame:
        found = fastx.read(self.spark, f"{self.root}/database/{gene}.fasta")
        return databases.sanitize(fastx.last_by_name(fastx.validate(found))).select("name", "sequence", "ord")

    def reads(self) -> DataFrame:
        for name in READS:
            if Path(self.root, name).exists():
                reads = fastx.read(self.spark, f"{self.root}/{name}", self.config.limit)
                break
        else:
            raise FileNotFoundError(f"none of {', '.join(READS)} in {self.root}")
        c = self.config
        if c.race_g:
            reads = copies.trim_g(reads)
        if c.barcode_length:
            cdr3 = None
            if c.group_by_cdr3 == "pseudo":
                from cloneframe.functions.sequence import pseudo_cdr3

                cdr3 = pseudo_cdr3(F.col("sequence"), c.pseudo_cdr3_start, c.pseudo_cdr3_end)
            elif c.group_by_cdr3 == "real":
                from cloneframe.functions.cdr3 import find_in_read

                at = find_in_read(F.col("sequence"), "IGH")
                cdr3 = F.when(at["end"] > 0, F.substring(F.col("sequence"), at["start"] + 1, at["end"] - at["start"])).otherwise("")
            grouped = copies.group_reads(reads, c.barcode_length, cdr3, c.group_trim_g, c.group_minimum_length, c.barcode_consensus)
            return grouped.select(F.col("header").alias("name"), "sequence")
        return reads.select("name", "sequence")

    def assignments(self, v: DataFrame, d: DataFrame, j: DataFrame) -> DataFrame:
        """Of airr.tsv or airr.tsv.gz where the folder has one; else of the reads, by the built-in assignment, or by the
        program that the setting spark.cloneframe.assigner names."""
        for name in ("airr.tsv.gz", "airr.tsv"):
            if Path(self.root, name).exists():
                return tables.read_assignments(self.spark, f"{self.root}/{name}")
        c = self.config
        if self.spark.conf.get("spark.cloneframe.assigner", "builtin") == "igblastn":
            return assign.assign_by_program(self.reads(), v, d, j, c.mismatch_penalty, c.sequence_type, c.species)
        return assign.assign(self.reads(), v, d, j, c.mismatch_penalty)

    def iteration(self, n: int, v: DataFrame, d: DataFrame, j: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pre-filtered V, V, J) databases that iteration n ends with."""
        at, c = f"iteration-{n:02d}", self.config
        raw = self.stage(f"{at}/airr", lambda: self.assignments(v, d, j))
        rows = self.stage(f"{at}/assigned", lambda: augment.augment(raw, v, d, j, c.sequence_type).withColumn("row_id", F.monotonically_increasing_id()))
        kept = self.stage(f"{at}/filtered", lambda: filters.filter_table(rows, c.preprocessing_filter))
        self.stage(f"{at}/stats", lambda: filters.filter_stats(rows, c.preprocessing_filter))
        self.stage(f"{at}/exact", lambda: filters.zero(kept, "V_errors"))
        self.counts(at, kept)
        found = self.stage(f"{at}/candidates", lambda: discovery.discover_v(kept, v, c.ignore_j, c.d_coverage, c.consensus_threshold / 100, c.seed, c.multialign_program, c.subsample))
        white = v if c.germline_filter.whitelist else None
        out = []
        for name, criteria in (("pregermline", c.pre_germline_filter), ("germline", c.germline_filter)):
            both = self.stage(f"{at}/annotated_V_{name}", lambda k=criteria: germline.eliminate(germline.annotate(found, k, white), k))
            best = germline.best_per_consensus(both.filter("is_filtered = 0"))
            db = best.select("name", F.col("consensus").alias("sequence"), F.col("idx").alias("ord"))
            if c.rename:
                db = databases.rename(db, v).select(F.col("new_name").alias("name"), "sequence", "ord")
            out.append(self.stage(f"{at}/new_V_{name}", lambda x=db: x))
        new_j = j
        if n == 1:
            js = c.j_discovery
            if "J_nt" in kept.columns or "j_sequence_alignment" in kept.columns:
                found_j = self.stage(f"{at}/new_J", lambda: discovery.discover_j(kept, j, c.consensus_threshold / 100, js.allele_ratio, js.cross_mapping_ratio, c.seed, c.multialign_program, c.subsample))
                if not self.done(f"{self.root}/{at}/new_J.fasta"):
                    fastx.write(found_j.select("name", F.col("consensus").alias("sequence")), f"{self.root}/{at}/new_J.fasta", "name")
                if js.propagate and not found_j.isEmpty():
                    new_j = found_j.select("name", F.col("consensus").alias("sequence"), F.lit(0).cast("long").alias("ord"))
        self.stage(f"{at}/clusterplots", lambda: clusterplots.clusters(kept, ignore_j=c.ignore_j, seed=c.seed).select("gene", "n_sequences", "n_clusters"))
        return out[0], out[1], new_j

    def counts(self, at: str, kept: DataFrame) -> None:
        for g in "VDJ":
            if call_column(g) in kept.columns:
                self.stage(f"{at}/expressed_{g}", lambda x=g: usage.allele_ratio(usage.expression_counts(kept, x), EXPRESSION_RATIO))

    def run(self) -> DataFrame:
        """The final filtered assignments; the folder holds every stage's table."""
        v, d, j = (self.database(g) for g in "VDJ")
        final = v
        for n in range(1, self.config.iterations + 1):
            v, final, j = self.iteration(n, v, d, j)
        raw = self.stage("final/airr", lambda: self.assignments(final, d, j))
        rows = self.stage("final/assigned", lambda: augment.augment(raw, final, d, j, self.config.sequence_type).withColumn("row_id", F.monotonically_increasing_id()))
        kept = self.stage("final/filtered", lambda: filters.filter_table(rows, self.config.preprocessing_filter))
        self.stage("final/clonotypes", lambda: clonotypes.call(kept))
        self.counts("final", kept)
        return kept


def init(root: str, v: str, d: str, j: str, reads: str) -> None:
    """Lay down a run's folder."""
    target = Path(root)
    (target / "database").mkdir(parents=True)
    for gene, source in zip("VDJ", (v, d, j), strict=True):
        if not Path(source).exists():
            raise FileNotFoundError(source)
        (target / "database" / f"{gene}.fasta").write_bytes(Path(source).read_bytes())
    ends = [e for e in READS if reads.endswith(e.removeprefix("reads"))]
    (target / (ends[0] if ends else "reads.fasta")).write_bytes(Path(reads).read_bytes())
    cfg.write_default(target / "config.toml")
