"""V, D and J assignment of reads: seeds, then an affine alignment to the best genes, or an installed program.

The built-in search is an approximation of the usual search tools: scores and E-values follow the same model, but heuristics differ, so
tables made elsewhere are the preferred input. Germline databases are a few hundred alleles; they travel with the
function, reads stream through it.
"""

from __future__ import annotations

import io
import math
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneframe.functions import kernels
from cloneframe.functions.names import strip_percent
from cloneframe.operators.small import bounded

# Karlin-Altschul parameters of match 1, mismatch -3.
LAMBDA, K = 1.374, 0.711
SEED = {"v": 11, "d": 6, "j": 9}
TRIED = 3
SEQUENCE_TYPES = ("Ig", "TCR")
LOCUS = re.compile("IG[HKL]|TR[ABGD]")
FIELDS = ("call", "identity", "support", "germline_alignment", "sequence_alignment", "germline_start", "germline_end", "sequence_start", "sequence_end")
KINDS = ("string", "double", "double", "string", "string", "long", "long", "long", "long")
SCHEMA = "sequence_id string, sequence string, locus string, stop_codon string, " + ", ".join(f"{p}_{f} {k}" for p in "vdj" for f, k in zip(FIELDS, KINDS, strict=True))

NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Index:
    """Seeds of a gene database."""

    genes: list[tuple[str, str]]
    k: int
    mismatch: int = kernels.MISMATCH

    def __post_init__(self):
        self.places: dict[str, list[tuple[int, int]]] = {}
        for g, (_, s) in enumerate(self.genes):
            for i in range(len(s) - self.k + 1):
                self.places.setdefault(s[i : i + self.k], []).append((g, i))

    def best(self, read: str, start: int) -> dict | None:
        """Best alignment of a gene to read[start:], or None."""
        votes: dict[tuple[int, int], int] = {}
        for i in range(start, len(read) - self.k + 1):
            for g, j in self.places.get(read[i : i + self.k], ()):
                votes[g, i - j] = votes.get((g, i - j), 0) + 1
        of_gene: dict[int, tuple[int, int]] = {}
        for (g, shift), n in votes.items():
            of_gene[g] = max(of_gene.get(g, (0, 0)), (n, -shift))
        tried = sorted(of_gene.items(), key=lambda x: (-x[1][0], self.genes[x[0]][0]))[:TRIED]
        made = [a for g, (_, shift) in tried if (a := self._align(g, read, -shift, start))]
        return max(made, key=lambda a: a["score"], default=None)

    def _align(self, g: int, read: str, shift: int, start: int) -> dict | None:
        name, gene = self.genes[g]
        lo, hi = max(start, shift), min(len(read), shift + len(gene))
        if hi - lo < self.k:
            return None
        x, y, *_ = kernels.align(gene[lo - shift : hi - shift], read[lo:hi], self.mismatch)
        total, top, first, span = 0, 0, 0, (0, 0)  # the part with the highest score
        gap = False
        for i, (a, b) in enumerate(zip(x, y, strict=True)):
            open_ = a == "-" or b == "-"
            total += (kernels.EXTEND if gap else kernels.OPEN) if open_ else kernels.MATCH if a == b else self.mismatch
            gap = open_
            if total <= 0:
                total, first, gap = 0, i + 1, False
            elif total > top:
                top, span = total, (first, i + 1)
        if not top:
            return None
        p, q = span
        g0, r0 = lo - shift + len(x[:p].replace("-", "")), lo + len(y[:p].replace("-", ""))
        x, y = x[p:q], y[p:q]
        n = sum(a == b for a, b in zip(x, y, strict=True))
        size = sum(len(s) for _, s in self.genes)
        return {
            "call": name, "identity": 100.0 * n / len(x), "support": K * len(read) * size * math.exp(-LAMBDA * top), "score": top,
            "germline_alignment": x, "sequence_alignment": y, "germline_start": g0 + 1, "germline_end": g0 + len(x.replace("-", "")),
            "sequence_start": r0 + 1, "sequence_end": r0 + len(y.replace("-", "")),
        }


def records(database: DataFrame, what: str = "gene database") -> list[tuple[str, str]]:
    """A gene database on the driver, of checked size. A header with bars goes by its first two fields, joined by _;
    an empty database is an error."""
    bounded(database, what)
    name = F.regexp_replace(strip_percent(database["name"]), r"(?s)^([^|]*)\|([^|]*).*$", "$1_$2")
    found = [(r[0], r[1]) for r in database.select(name, "sequence").orderBy("name").collect()]
    if not found:
        raise ValueError(f"{what} is empty")
    return found


def locus_of(call: str) -> str:
    """The locus in a gene's name, else what its last field starts with."""
    found = LOCUS.search(call)
    return found[0] if found else call.split("|")[-1][:3]


def _finished(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.astype({f"{p}_{f}": "int64" for p in "vdj" for f, k in zip(FIELDS, KINDS, strict=True) if k == "long"})


def assign(reads: DataFrame, v: DataFrame, d: DataFrame, j: DataFrame, penalty: int = 0) -> DataFrame:
    """Rearrangement table of reads (name, sequence). penalty: what a mismatch costs, where it is not 0."""
    genes = {p: records(db, f"{p.upper()} gene database") for p, db in zip("vdj", (v, d, j), strict=True)}
    mismatch = -abs(penalty) or kernels.MISMATCH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {p: Index(g, SEED[p], mismatch) for p, g in genes.items()}
        for pdf in batches:
            rows = []
            for name, read in zip(pdf["name"], pdf["sequence"], strict=True):
                row: dict = {"sequence_id": name, "sequence": read}
                hits = {"v": index["v"].best(read, 0)}
                end = hits["v"]["sequence_end"] if hits["v"] else 0
                hits["j"] = index["j"].best(read, end)
                until = hits["j"]["sequence_start"] - 1 if hits["j"] else len(read)
                hits["d"] = index["d"].best(read[:until], end)
                for p, hit in hits.items():
                    for f, kind in zip(FIELDS, KINDS, strict=True):
                        row[f"{p}_{f}"] = hit[f] if hit else ("" if kind == "string" else None if kind == "double" else 0)
                row["locus"] = locus_of(row["v_call"] or row["j_call"])
                frame = (hits["v"]["sequence_start"] - hits["v"]["germline_start"]) % 3 if hits["v"] else 0
                codons = {read[i : i + 3] for i in range(frame, len(read) - 2, 3)}
                row["stop_codon"] = "T" if codons & {"TAA", "TAG", "TGA"} else "F"
                rows.append(row)
            yield _finished(pd.DataFrame(rows, columns=NAMES))

    return reads.select("name", "sequence").mapInPandas(run, SCHEMA)


def assign_by_program(reads: DataFrame, v: DataFrame, d: DataFrame, j: DataFrame, penalty: int = 0, sequence_type: str = "Ig", species: str = "") -> DataFrame:
    """The same columns by igblastn, which with makeblastdb has to be installed on every executor. Each task lays its
    databases down in a folder of its own, which goes with the task, and runs the program once a batch of reads."""
    if sequence_type not in SEQUENCE_TYPES:
        raise ValueError(f"no sequence type {sequence_type!r}; known: {', '.join(SEQUENCE_TYPES)}")
    genes = {p: records(db, f"{p} gene database") for p, db in zip("VDJ", (v, d, j), strict=True)}
    return reads.select("name", "sequence").mapInPandas(lambda batches: _by_program(batches, genes, penalty, sequence_type, species), SCHEMA)


def _by_program(batches: Iterator[pd.DataFrame], genes: dict[str, list[tuple[str, str]]], penalty: int, sequence_type: str, species: str) -> Iterator[pd.DataFrame]:
    for program in ("makeblastdb", "igblastn"):
        if not shutil.which(program):
            raise FileNotFoundError(f"{program} is not installed; assign needs no program")
    with tempfile.TemporaryDirectory() as folder:
        for p, found in genes.items():
            Path(folder, f"{p}.fasta").write_text("".join(f">%{name}\n{re.sub('[^ACGTUN]', 'N', s.upper())}\n" for name, s in found))
            subprocess.run(["makeblastdb", "-parse_seqids", "-dbtype", "nucl", "-in", f"{folder}/{p}.fasta", "-out", f"{folder}/{p}"], check=True, capture_output=True)
        Path(folder, "aux").touch()
        command = ["igblastn", *_options(folder, penalty, sequence_type, species)]
        for pdf in batches:
            fasta = "".join(f">{n}\n{s}\n" for n, s in zip(pdf["name"], pdf["sequence"], strict=True))
            yield _of_airr(subprocess.run(command, input=fasta, check=True, capture_output=True, text=True).stdout)


def _options(folder: str, penalty: int, sequence_type: str, species: str) -> list[str]:
    out = [x for p in "VDJ" for x in (f"-germline_db_{p}", f"{folder}/{p}", f"-num_alignments_{p}", "1")]
    out += ["-auxiliary_data", f"{folder}/aux", "-ig_seqtype", sequence_type, "-domain_system", "imgt", "-num_threads", "1", "-outfmt", "19", "-query", "-"]
    return out + (["-penalty", str(penalty)] if penalty > 0 else []) + (["-organism", species] if species else [])


def _of_airr(text: str) -> pd.DataFrame:
    """The table's columns of a program's tab-separated text; what it leaves out is empty, null or 0, as in assign."""
    rows = pd.read_csv(io.StringIO(text), sep="\t", dtype=str, keep_default_na=False).reindex(columns=NAMES)
    for name, kind in zip(NAMES, (c.split()[1] for c in SCHEMA.split(", ")), strict=True):
        if kind == "string":
            rows[name] = rows[name].fillna("")
        else:
            rows[name] = pd.to_numeric(rows[name], errors="coerce")
            if kind == "long":
                rows[name] = rows[name].fillna(0)
    return _finished(rows)
