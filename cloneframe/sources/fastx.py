"""FASTA and FASTQ as a Spark data source, and FASTA as a sink.

`spark.dataSource.register(Fastx)` once, then `spark.read.format("fastx").option("limit", n).load(path)` gives
(file, ord, name, sequence): the name is the text up to the first blank, sequences are upper case, ord grows along a
file. A path may be a folder; files may be gzipped, and are streamed. A plain FASTA file of more than `split` bytes
(an option) is read in ranges, its records' ord being their places in bytes; any other file is one partition, and ord
counts its records. FASTQ has no safe place to cut at, as a quality line may begin like a record.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

SPLIT = 64 << 20
SCHEMA = "file string, ord long, name string, sequence string"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The files of a path, in order of their names."""
    system, inner = _system(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def records(stream: io.BufferedReader, limit: int = 0) -> Iterator[tuple[str, str]]:
    """(name, sequence) of a stream, FASTA or FASTQ by its first byte."""
    first = stream.peek(1)[:1]
    if not first:
        return
    read = {b">": _fasta, b"@": _fastq}.get(first)
    if read is None:
        raise ValueError(f"neither FASTA nor FASTQ: begins with {first!r}")
    for n, (header, sequence) in enumerate(read(io.TextIOWrapper(stream, "utf-8"))):
        if limit and n >= limit:
            return
        yield (header.split() or [""])[0], sequence.upper()


def _fasta(lines: io.TextIOWrapper) -> Iterator[tuple[str, str]]:
    header, parts = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if header is not None:
                yield header, "".join(parts)
            header, parts = line[1:], []
        else:
            parts.append(line.strip())
    if header is not None:
        yield header, "".join(parts)


def _fastq(lines: io.TextIOWrapper) -> Iterator[tuple[str, str]]:
    while header := lines.readline().rstrip("\r\n"):
        sequence = lines.readline().rstrip("\r\n")
        plus = lines.readline()
        if not header.startswith("@") or not plus.startswith("+"):
            raise ValueError(f"broken FASTQ record at {header!r}")
        lines.readline()
        yield header[1:], sequence


def open_records(path: str, limit: int = 0) -> Iterator[tuple[str, str]]:
    system, inner = _system(path)
    with system.open_input_stream(inner, compression=None) as raw:
        stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        yield from records(io.BufferedReader(stream, 1 << 20), limit)


def range_records(path: str, start: int, stop: int) -> Iterator[tuple[int, str, str]]:
    """(place, name, sequence) of the FASTA records that begin in bytes start to stop of a plain file."""
    system, inner = _system(path)
    with system.open_input_file(inner) as raw:
        raw.seek(max(0, start - 1))
        stream = io.BufferedReader(raw, 1 << 20)
        at = max(0, start - 1)
        if start:
            at += len(stream.readline())  # the end of the line before, or an empty rest of it
        begin, header, parts = 0, None, []
        while line := stream.readline():
            if line.startswith(b">"):
                if header is not None:
                    yield begin, (header.split() or [""])[0], "".join(parts).upper()
                if at >= stop:
                    return
                begin, header, parts = at, line[1:].decode().strip(), []
            elif header is not None:
                parts.append(line.decode().strip())
            at += len(line)
        if header is not None:
            yield begin, (header.split() or [""])[0], "".join(parts).upper()


def _rows(path: str, limit: int) -> Iterator[tuple]:
    for n, (name, sequence) in enumerate(open_records(path, limit)):
        yield path, n, name, sequence


class _File(InputPartition):
    """A file, or the records that begin in a range of one."""

    def __init__(self, path: str, start: int = 0, stop: int = 0):
        self.path, self.start, self.stop = path, start, stop


def _parts(path: str, size: int) -> list[_File]:
    system, inner = _system(path)
    total = system.get_file_info(inner).size or 0
    if path.endswith(".gz") or total <= size:
        return [_File(path)]
    with system.open_input_stream(inner, compression=None) as raw:
        if raw.read(1) != b">":
            return [_File(path)]
    return [_File(path, a, min(a + size, total)) for a in range(0, total, size)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("limit", 0))
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[_File]:
        return [part for p in files(self.path) for part in ([_File(p)] if self.limit else _parts(p, self.split))]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.stop:
            return ((partition.path, *r) for r in range_records(partition.path, partition.start, partition.stop))
        return _rows(partition.path, self.limit)


class _Stream(DataSourceStreamReader):
    """New files of a folder, in the order of their times and names."""

    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("limit", 0))

    def initialOffset(self) -> dict:
        return {"time": 0, "last": ""}

    def _found(self) -> list[tuple[int, str]]:
        return sorted((_system(p)[0].get_file_info(_system(p)[1]).mtime_ns or 0, p) for p in files(self.path))

    def latestOffset(self) -> dict:
        time, last = max(self._found(), default=(0, ""))
        return {"time": time, "last": last}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(p) for t, p in self._found() if (start["time"], start["last"]) < (t, p) <= (end["time"], end["last"])]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _rows(partition.path, self.limit)


class Fastx(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def read(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    spark.dataSource.register(Fastx)
    found = spark.read.format("fastx").option("limit", limit).load(path)
    return found.orderBy("file", "ord").limit(limit) if limit else found  # of a file no more than limit rows come here


def last_by_name(df: DataFrame) -> DataFrame:
    """A gene database: of records with one name, the last of the file."""
    newest = Window.partitionBy("name").orderBy(F.col("file").desc(), F.col("ord").desc())
    return df.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def write(df: DataFrame, path: str, order: str | list[str] = "ord", compressed: bool = False) -> None:
    """df's name and sequence as FASTA in the folder path; its files, in order of their names, hold them in order."""
    text = df.orderBy(order).select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value"))
    text.write.option("compression", "gzip" if compressed else "none").text(path)


def has_records(df: DataFrame) -> bool:
    return not df.isEmpty()


def problems(df: DataFrame) -> DataFrame:
    """(problem, name, sequence): records without a sequence, and those that repeat an earlier name or sequence."""
    order = F.struct("file", "ord")
    empty = df.filter("sequence = ''").select(F.lit("empty").alias("problem"), "name", "sequence")
    again = [df.withColumn("_n", F.row_number().over(Window.partitionBy(c).orderBy(order))).filter("_n > 1").select(F.lit(f"duplicate {c}").alias("problem"), "name", "sequence") for c in ("name", "sequence")]
    return empty.unionByName(again[0]).unionByName(again[1])


def validate(df: DataFrame) -> DataFrame:
    """df, or an error if it has problems."""
    if first := problems(df).first():
        raise ValueError(f"{first.problem}: {first.name}")
    return df
