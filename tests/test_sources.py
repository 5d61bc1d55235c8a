import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cloneframe.operators import merging
from cloneframe.plans import catalogue, files
from cloneframe.sources import config, fastx, tables
from cloneframe.streaming import counts


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">g1 text\natcg\n>g2\nGG\nCC\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@r1 x\nacgt\n+\nIIII\n@r2\nTT\n+\nII\n")
    a = fastx.read(spark, f"{tmp_path}/a.fasta")
    assert [(r.name, r.sequence) for r in a.orderBy("ord").collect()] == [("g1", "ATCG"), ("g2", "GGCC")]
    assert fastx.read(spark, f"{tmp_path}/a.fasta", 1).count() == 1
    assert [(r.name, r.sequence) for r in fastx.read(spark, f"{tmp_path}/b.fastq.gz").orderBy("ord").collect()] == [("r1", "ACGT"), ("r2", "TT")]
    assert fastx.read(spark, str(tmp_path)).count() == 4
    for zipped in (False, True):
        out = f"{tmp_path}/out{zipped}"
        fastx.write(a, out, compressed=zipped)
        assert [(r.name, r.sequence) for r in fastx.read(spark, out).filter("sequence <> ''").orderBy("ord").collect()] == [("g1", "ATCG"), ("g2", "GGCC")]
    (tmp_path / "empty.fasta").write_text("")
    (tmp_path / "bad.fasta").write_text("ACGT\n")
    assert not fastx.has_records(fastx.read(spark, f"{tmp_path}/empty.fasta"))
    with pytest.raises(Exception, match="neither FASTA nor FASTQ"):
        fastx.read(spark, f"{tmp_path}/bad.fasta").count()


def test_validation_and_last_by_name(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">a\nAC\n>a\nGG\n")
    df = fastx.read(spark, f"{tmp_path}/a.fasta")
    with pytest.raises(ValueError, match="duplicate name"):
        fastx.validate(df)
    assert [r.sequence for r in fastx.last_by_name(df).collect()] == ["GG"]
    (tmp_path / "b.fasta").write_text(">a\nAC\n>b\nGG\n")
    assert fastx.validate(fastx.read(spark, f"{tmp_path}/b.fasta")).count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("sequence_id\tv_call\tcdr3\tv_support\tV_errors\nr1\tNA\t\t1e-5\t2\nr2\tV1\tAC\tNA\t\n")
    rows = tables.read_assignments(spark, f"{tmp_path}/t.tsv").orderBy("sequence_id").collect()
    assert [tuple(r) for r in rows] == [("r1", "", "", 1e-5, 2), ("r2", "V1", "AC", None, None)]
    tables.write_table(spark.createDataFrame(rows), f"{tmp_path}/out", True)
    assert tables.read_table(spark, f"{tmp_path}/out").count() == 2
    b = tables.blocks(spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (2, 3, "z")], "g long, k long, v string"), "g", ["k"], "# ")
    assert [r.value for r in b.collect()] == ["# 1", "1\ty", "2\tx", "", "# 2", "3\tz"]
    b = tables.blocks(spark.createDataFrame([(1, 2, "x"), (2, 3, "z")], "g long, k long, v string"), "g", ["k"], header=True)
    tables.write_text(b, f"{tmp_path}/text")
    files = sorted(p for p in (tmp_path / "text").iterdir() if p.suffix == ".txt")
    assert "".join(p.read_text() for p in files) == "g\tk\tv\n1\t2\tx\n\n2\t3\tz\n"


def test_config(tmp_path):
    c = config.parse({"iterations": 2, "germline_filter": {"unique_js": 9}})
    assert (c.iterations, c.germline_filter.unique_js, c.germline_filter.cluster_size, c.pre_germline_filter.unique_cdr3s) == (2, 9, 50, 2)
    with pytest.warns(UserWarning):
        config.parse({"stranded": True})
    p = tmp_path / "c.toml"
    assert config.write_default(p) and not config.write_default(p) and config.load(p) == config.Config()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fasta").write_text(">r1\nACGT\n>r2\nACGT\n>r3\nGG\n")
    spark.dataSource.register(fastx.Fastx)
    stream = spark.readStream.format("fastx").load(f"{tmp_path}/in")
    q = counts.write(counts.dereplicate(stream), f"{tmp_path}/out", f"{tmp_path}/check", once=True)
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("sequence", "size").collect()
    assert sorted(map(tuple, got)) == [("ACGT", 2), ("GG", 1)]


def test_split_files_limits_and_late_files(spark, tmp_path):
    text = "".join(f">r{i} x\n{'acgt' * (i % 5)}\n{'G' * (i % 7)}\n" for i in range(300)) + ">last\n"
    (tmp_path / "one.fasta").write_text(text)
    (tmp_path / "two.fa").write_text(">z\nAC\n")
    want = [(f"r{i}", "ACGT" * (i % 5) + "G" * (i % 7)) for i in range(300)] + [("last", "")]
    spark.dataSource.register(fastx.Fastx)
    for size in (1, 7, 100):  # every cut, without a task a range
        ranges = [r for a in range(0, len(text), size) for r in fastx.range_records(f"{tmp_path}/one.fasta", a, min(a + size, len(text)))]
        assert [r[1:] for r in ranges] == want and [r[0] for r in ranges] == sorted({r[0] for r in ranges}), size
    for size in (1000, 5000, 1 << 20):
        got = spark.read.format("fastx").option("split", size).load(f"{tmp_path}/one.fasta").orderBy("ord").collect()
        assert [(r.name, r.sequence) for r in got] == want, size
    assert [r.name for r in fastx.read(spark, str(tmp_path), 3).orderBy("ord").collect()] == ["r0", "r1", "r2"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.fasta").write_text(">b\nAC\n")
    stream = fastx._Stream({"path": f"{tmp_path}/in"})
    seen = stream.latestOffset()
    assert [p.path.rsplit("/", 1)[1] for p in stream.partitions(stream.initialOffset(), seen)] == ["b.fasta"]
    (tmp_path / "in/a.fasta").write_text(">a\nAC\n")
    assert [p.path.rsplit("/", 1)[1] for p in stream.partitions(seen, stream.latestOffset())] == ["a.fasta"]


def test_paired_merge_by_chance(spark, tmp_path):
    """First reads that end like a mate of AC alone: the operator joins such a mate, the query's rows have none."""
    ends = ["GTGTGTGTGT", "GTGTGTGGGT", "ACGTACGTAC", "AAAAAAAAAA", "CCCCCGGGGG"]
    df = spark.createDataFrame([(9 * i, "ACGTT" * 6 + "ACGT" + e + "CATTGATTACCATGACCATG") for i, e in enumerate(ends)] + [(1, "ACGTT" * 6 + "GGATACCATGCATTGATTACCATGACCATGACGA")], "row_id long, s string")
    assert merging.overlap("ACGTT" * 6 + "ACGT" + ends[1], "GT" * 22) is not None
    assert [r.name for r in files.paired_merge(df, str(tmp_path)).collect()] == ["r1"]


def test_augment_leaves_views_alone(spark):
    """The query neither replaces nor leaves a temporary view, which another thread's query could read."""
    spark.range(1).createOrReplaceTempView("_strings")
    before = sorted(t.name for t in spark.catalog.listTables())
    assert files._augmented(spark, "/root/testdata/sf0.001").count() > 1
    assert spark.table("_strings").columns == ["id"] and sorted(t.name for t in spark.catalog.listTables()) == before
    spark.catalog.dropTempView("_strings")


def test_clonoquery_file_is_small(spark, tmp_path):
    """Lines grow with the square of a class, the file does not."""
    n, copies = 400, 50
    spark.range(n * copies).selectExpr("id as o_orderkey", f"(id % {n}) % 24 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    df = catalogue.queries()["clonoquery_file"](spark, str(tmp_path))
    stored = sum(Path(p.removeprefix("file://")).stat().st_size for p in df.inputFiles())
    r = df.agg(F.sum(F.length("line") + 1).alias("text"), F.count_if(F.col("line") != "").alias("lines")).first()
    pairs = catalogue.queries()["clonoquery"](spark, str(tmp_path))
    assert r.lines == pairs.count() + pairs.select("query_id").distinct().count()
    assert r.text > 500_000 and stored * 10 < r.text
