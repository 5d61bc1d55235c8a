import random

from cloneframe import cli
from cloneframe.plans import pipeline
from cloneframe.sources import config, fastx


def folder(tmp_path):
    rng = random.Random(1)
    nt = lambda n: "".join(rng.choice("ACG") for _ in range(n))
    genes = {"V": [(f"IGHV{i}*01", nt(120) + "TATTACTGTGCG") for i in range(2)], "D": [("IGHD1*01", nt(20))], "J": [(f"IGHJ{i}*01", nt(10) + "TGGGGC" + nt(30)) for i in range(4)]}
    for g, rows in genes.items():
        (tmp_path / f"{g}.fasta").write_text("".join(f">{n}\n{s}\n" for n, s in rows))
    with open(tmp_path / "reads.fasta", "w") as f:
        for i in range(60):
            f.write(f">r{i};size=1;\n{genes['V'][i % 2][1]}{nt(3)}{genes['D'][0][1]}{nt(2)}{genes['J'][i // 2 % 4][1]}\n")
    return str(tmp_path)


def test_run_and_go_on(spark, tmp_path):
    source, root = folder(tmp_path), f"{tmp_path}/run"
    pipeline.init(root, *(f"{source}/{g}.fasta" for g in "VDJ"), f"{source}/reads.fasta")
    run = pipeline.Run(spark, root, config.load(f"{root}/config.toml"))
    kept = run.run()
    assert kept.count() == 60 and {r.v_call for r in kept.select("v_call").distinct().collect()} == {"IGHV0*01", "IGHV1*01"}
    assert {r.database_diff for r in spark.read.parquet(f"{root}/iteration-01/candidates").collect()} == {0}
    assert spark.read.parquet(f"{root}/final/clonotypes").count() > 0
    new_j = spark.read.parquet(f"{root}/iteration-01/new_J").collect()
    assert new_j and {r.name for r in new_j} <= {f"IGHJ{i}*01" for i in range(4)}
    assert sorted(r.name for r in fastx.read(spark, f"{root}/iteration-01/new_J.fasta").filter("sequence <> ''").collect()) == sorted(r.name for r in new_j)
    before = spark.read.parquet(f"{root}/final/filtered").inputFiles()
    assert run.run().inputFiles() == before  # every stage is read, none made again


def test_command_line(spark, tmp_path, capsys):
    source = folder(tmp_path)
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip()
    assert cli.main(["dbdiff", f"{source}/V.fasta", f"{source}/V.fasta"]) == 0
    assert cli.main(["dbdiff", f"{source}/V.fasta", f"{source}/J.fasta"]) == 1
    assert cli.main(["dereplicate", f"{source}/reads.fasta", f"{source}/derep", "--barcode-length", "4"]) == 0
    assert cli.main(["union", f"{source}/union", f"{source}/V.fasta", f"{source}/V.fasta"]) == 0
    (tmp_path / "t.tsv").write_text("sequence_id\tv_call\tj_call\tcdr3\tV_SHM\nr1\tV1*01\tJ1*01\tAAAC\t0\nr2\tV1*01\tJ1*01\tAAAA\t1\n")
    assert cli.main(["clonotypes", f"{source}/t.tsv", f"{source}/clones", "--members", f"{source}/members"]) == 0
    assert cli.main(["clonoquery", f"{source}/t.tsv", f"{source}/t.tsv", f"{source}/found", "--summary", f"{source}/summary"]) == 0
    assert cli.main(["count", f"{source}/t.tsv", f"{source}/counts"]) == 0
    assert cli.main(["plotalleles", f"{source}/t.tsv", f"{source}/matrix"]) == 0
    assert cli.main(["upstream", f"{source}/t.tsv", f"{source}/up"]) == 1
