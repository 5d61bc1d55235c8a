"""Paired reads merged by their overlap, in place or by an installed program."""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneframe.functions.sequence import reverse_complement

# Counts in the logs of the two programs.
LOGS = {"pear": (r"Assembled reads \.*: ([\d,]+) / ([\d,]+)",), "flash": (r"Combined pairs:\s+(\d+)", r"Total pairs:\s+(\d+)")}


def overlap(a: str, b: str, least: int = 10, share: float = 0.1) -> str | None:
    """a and b joined by their longest overlap with at most `share` mismatches; a's bases stand."""
    for n in range(min(len(a), len(b)), least - 1, -1):
        most = int(share * n)
        wrong = 0
        for x, y in zip(a[-n:], b[:n], strict=True):
            wrong += x != y
            if wrong > most:
                break
        if wrong <= most:
            return a + b[n:]
    return None


def merge_pairs(first: DataFrame, second: DataFrame, least: int = 10, share: float = 0.1) -> DataFrame:
    """(name, sequence) of pairs that overlap. first and second have name and sequence, joined by name without /1, /2."""
    key = F.regexp_replace("name", r"/[12]$", "")
    pairs = first.select(key.alias("name"), F.col("sequence").alias("a")).join(second.select(key.alias("name"), reverse_complement(F.col("sequence")).alias("b")), "name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [overlap(a, b, least, share) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pd.DataFrame({"name": pdf["name"], "sequence": made}).dropna()

    return pairs.mapInPandas(run, "name string, sequence string")


def parse_log(program: str, text: str) -> tuple[int, int]:
    """(merged, total) of a program's log; 0 where a count is missing."""
    found = [g for p in LOGS[program] if (m := re.search(p, text)) for g in m.groups()]
    numbers = [int(x.replace(",", "")) for x in found]
    return tuple((numbers + [0, 0])[:2])


def merge_files(first: str, second: str, out: str, program: str = "pear", threads: int = 4, longest_overlap: int = 300) -> tuple[int, int]:
    """Merge two FASTQ files by an installed program into the gzipped file out; (merged, total)."""
    if program not in LOGS:
        raise ValueError(f"no merge program {program!r}; known: {', '.join(LOGS)}")
    if not shutil.which(program):
        raise FileNotFoundError(f"{program} is not installed; merge_pairs needs no program")
    import gzip
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        if program == "pear":
            command, made = ["pear", "-j", str(threads), "-f", first, "-r", second, "-o", f"{d}/m"], f"{d}/m.assembled.fastq"
        else:
            command, made = ["flash", "-t", str(threads), "-M", str(longest_overlap), "-d", d, "-o", "m", first, second], f"{d}/m.extendedFrags.fastq"
        log = subprocess.run(command, capture_output=True, text=True, check=True).stdout
        with gzip.open(out, "wb") as f:
            f.write(Path(made).read_bytes())
    return parse_log(program, log)
