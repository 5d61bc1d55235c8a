import collections
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloneframe.functions import kernels
from cloneframe.operators import assign, augment, clonoquery, clonotypes, clusterplots, consensus, copies, databases, discovery, elimination, filters, germline, haplotypes, merging, upstream, usage
from cloneframe.sources.config import GermlineCriteria, Preprocessing


def test_filter_table(spark):
    df = spark.createDataFrame(
        [("V1", "J1", "F", "AAA", 1e-9, 95.0, 70.0), ("V1", "J1", "F", "AAA", 1e-9, 50.0, 70.0), ("V1", "", "F", "AAA", 1e-9, 95.0, 70.0), ("", "J1", "F", "", None, 95.0, None)],
        "v_call string, j_call string, stop_codon string, cdr3 string, v_support double, V_covered double, J_covered double",
    )
    p = Preprocessing(90, 60, 1e-3)
    s = filters.filter_stats(df, p).first()
    assert (s.total, s.has_vj_assignment, s.good_j_coverage, s.has_cdr3) == (4, 2, 1, 1) and filters.filter_table(df, p).count() == 1
    assert filters.filter_stats(df.drop("V_covered"), p).first().good_v_coverage == 2


CLONES = [("IGHV1*01", "IGHJ1*01", "AATGT", 1.0), ("IGHV1*01", "IGHJ1*01", "AATGT", 2.0), ("IGHV1*01", "IGHJ1*01", "CCCCC", 0.5), ("IGHV2*01", "IGHJ2*01", "GGGGG", 1.0), ("IGHV2*01", "IGHJ2*01", "GGGGA", 0.5)]


def clones(spark, rows=CLONES):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, v_call string, j_call string, cdr3 string, V_SHM double")


def test_clonotypes(spark):
    df = clones(spark)
    one = clonotypes.call(df, 1).collect()
    assert len(one) == 3 and max(r.clonotype_size for r in one) == 2 and clonotypes.call(df, 0).count() == 4
    assert {r.clonotype_id: r.row_id for r in one} == {0: 0, 2: 2, 3: 4}
    assert clonotypes.call(df.drop("V_SHM"), 1).count() == 3
    assert clonotypes.call(clones(spark, [*CLONES, ("", "J", "A", 0.0), ("V", "J", "", 0.0), ("V", None, "A", 0.0)]), 1).count() == 3
    rate = {r.row_id: r.CDR3_nt_mindiffrate for r in clonotypes.divergence(df).collect()}
    assert rate[3] == 20 and rate[4] == 0 and rate[2] != rate[2]
    with pytest.raises(ValueError):
        clonotypes.call(df.drop("cdr3"))


def test_linkage_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [("V", rng.choice("JK"), "".join(rng.choice("AC") for _ in range(rng.choice([7, 8]))), 0.0) for _ in range(150)]
    for m in (1, 2):
        got = {r.row_id: r.clonotype_id for r in clonotypes.members(clones(spark, rows), m).collect()}
        root = list(range(len(rows)))
        for _ in rows:
            for i, a in enumerate(rows):
                for j, b in enumerate(rows):
                    if a[1] == b[1] and len(a[2]) == len(b[2]) and sum(x != y for x, y in zip(a[2], b[2], strict=True)) <= m:
                        root[i] = root[j] = min(root[i], root[j])
        assert got == dict(enumerate(root))


def test_count_by_edits(spark):
    df = spark.createDataFrame([(0, "g", "J1", "AAA"), (1, "g", "J1", "AAB"), (2, "g", "J2", "CCC"), (3, "g", "J2", "CCD"), (4, "g", "J2", "")], "row_id long, g string, j_call string, cdr3 string")
    assert clonotypes.count_by_edits(df, ["g"], 1).first().clonotypes == 2


def test_clonoquery(spark):
    schema = "row_id long, v_call string, j_call string, cdr3 string, count long, V_SHM double"
    ref = spark.createDataFrame([(1, "V1", "J1", "AAAA", 5, 1.0), (2, "V1", "J1", "AAAT", 9, 2.0), (3, "V1", "J1", "TTTT", 1, 0.0), (4, "V2", "J1", "AAAA", 1, 0.0)], schema)
    query = spark.createDataFrame([(10, "V1", "J1", "AAAA"), (11, "V9", "J1", "AAAA"), (12, "", "J1", "AAAA")], "row_id long, v_call string, j_call string, cdr3 string")
    size = lambda **k: {r.query_id: r["size"] for r in clonoquery.counts(query, clonoquery.matches(query, ref, **k)).collect()}
    assert size() == {10: 2, 11: 0} and size(min_count=6) == {10: 1, 11: 0} and size(mismatches=0.9) == {10: 2, 11: 0}
    assert size(mismatches=1, core=clonoquery.Core(1, 2)) == {10: 2, 11: 0} and size(mismatches=4, core=clonoquery.Core(1, 3)) == {10: 2, 11: 0}
    s = {r.query_id: r.avg_V_SHM for r in clonoquery.summary(query, clonoquery.matches(query, ref)).collect()}
    assert s == {10: 1.5, 11: 0.0}


def test_clonoquery_blocks(spark, tmp_path):
    """Whole blocks, rows in order over chunks and tasks; an id of two rows has one block."""
    rows = [(i * 7 % 400, f"V{i % 2}", "J1", "AAAA" if i % 3 else "AAAT") for i in range(400)] + [(20, "V1", "J1", "CCCC"), (40, "V1", "J1", "AAAA"), (999, "V1", "J1", "CCCC")]
    ref = spark.createDataFrame(rows, "row_id long, v_call string, j_call string, cdr3 string")
    query = ref.filter("row_id % 20 = 0")
    clonoquery.write(query, ref, f"{tmp_path}/out", ["row_id", "cdr3"], chunk=16, share=700, repeats=2)
    want = {}
    for r in clonoquery.matches(query, ref).collect():
        want.setdefault(r.query_id, []).append((r.row_id, f"{r.row_id}\t{r.cdr3}"))
    assert {20, 40} <= {q for q, n in collections.Counter(r[0] for r in rows).items() if n > 1}
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert len(files) > 3 and {p.suffix for p in files} == {".zstd"}
    lines = [r.value for p in files for r in spark.read.text(str(p)).collect()]
    got = "\n".join(lines).split("\n\n")
    assert {int(re.match("# Query: ([0-9]+)\n", b)[1]): b.split("\n")[1:] for b in got} == {q: [x for _, x in sorted(v)] for q, v in want.items()} and len(got) == len(want)
    assert spark.read.text(f"{tmp_path}/out").count() == len(lines)
    empty = query.filter("row_id < 0")
    clonoquery.write(empty, ref, f"{tmp_path}/none", ["row_id"])
    assert spark.read.text(f"{tmp_path}/none").count() == 0


def test_usage(spark):
    df = spark.createDataFrame([("V1", "J1"), ("V1", "J1"), ("V1", "J2"), ("V2", "J1"), ("", "J1")], "v_call string, j_call string")
    m = {r.gene: (r.J1, r.J2) for r in usage.allele_matrix(df, "V", "J", ["J1", "J2"]).collect()}
    assert m == {"V1": (2, 1), "V2": (1, 0)}
    counts = spark.createDataFrame([("A*01", 100), ("A*02", 40), ("B*01", 50)], "gene string, count long")
    assert {r.gene for r in usage.allele_ratio(counts, 0.5).collect()} == {"A*01", "B*01"}
    order = usage.in_natural_order(spark.createDataFrame([("1-10",), ("1-2",), ("1-1",)], "gene string"))
    assert [r.gene for r in order.collect()] == ["1-1", "1-2", "1-10"]
    listed = usage.expression_counts(df, "V", spark.createDataFrame([("V1",), ("V3",)], "name string"))
    assert {r.gene: r["count"] for r in listed.collect()} == {"V1": 3, "V3": 0}


def test_haplotype_classes(spark):
    rows = [("J1*01", "V1*01", 50), ("J1*02", "V1*02", 40), ("J1*01", "V2*01", 30), ("J1*01", "V3*01", 20), ("J1*02", "V3*01", 20), ("J1*02", "V4*01", 9), ("J1*01", "V4*02", 8), ("J1*01", "V5*01", 9), ("J1*02", "V5*01", 9), ("J1*01", "V5*02", 9)]
    co = spark.createDataFrame(rows, "j_call string, v_call string, count long")
    targets = co.groupBy(F.col("v_call").alias("allele")).agg(F.sum("count").alias("count")).withColumn("gene", F.substring_index("allele", "*", 1))
    got = {(r.haplotype1, r.haplotype2): (r.type, r.count1, r.count2) for r in haplotypes.entries(co, targets, ("J1*01", "J1*02"), "J", "V").collect()}
    assert got[("V1*01", "V1*02")] == ("heterozygous", 50, 40) and got[("V2*01", "")] == ("deletion", 30, 0) and got[("V3*01", "V3*01")] == ("homozygous", 20, 20)
    assert got[("V4*02", "V4*01")] == ("heterozygous", 9, 8) and got[("V5*01", "V5*01")][0] == "duplication" and got[("V5*02", "")][0] == "duplication"
    b = haplotypes.Block("V", ("a", "b"), [("x", "y", "heterozygous", 1, 2)])
    b.switch()
    assert b.rows == [("y", "x", "heterozygous", 2, 1)] and b.tsv(True).startswith("haplotype1\thaplotype2\ttype\tcount1\tcount2")


def test_copies(spark):
    df = spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(["AAACCC", "AAACCC", "AAAGGG", "TT", "AAATTTTTT"])], "ord long, name string, sequence string")
    got = {(r.barcode, r.sequence): (r.name, r["size"]) for r in copies.dereplicate(df, 3).collect()}
    assert got == {("AAA", "CCC"): ("r0", 2), ("AAA", "GGG"): ("r2", 1), ("TT", ""): ("r3", 1), ("AAA", "TTTTTT"): ("r4", 1)}
    assert sorted(r["size"] for r in copies.group_reads(df, 3, consensus=False).collect()) == [1, 4]
    grouped = copies.group_reads(df.filter("length(sequence) > 5"), 3, F.substring("sequence", 1, 3)).collect()
    assert sum(r["size"] for r in grouped) == 4 and all(";cdr3=" in r.header for r in grouped)


def test_consensus_equals_the_kernel(spark):
    rng = random.Random(3)
    groups = {g: ["".join(rng.choice("AACGTN-X") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 40))] for g in range(25)}
    df = spark.createDataFrame([(g, s) for g, rows in groups.items() for s in rows], "g long, s string")
    for threshold in (0.3, 0.7):
        got = {r.g: r.consensus for r in consensus.column_consensus(df, ["g"], "s", threshold).collect()}
        assert got == {g: kernels.consensus(rows, threshold) for g, rows in groups.items()}


CANDIDATE = "idx long, consensus string, name string, cluster string, cluster_size long, exact long, Ds_exact long, CDR3s_exact long, Js_exact long, clonotypes long, CDR3_start long, has_stop long, database_diff long"


def test_germline_filter(spark):
    rows = [(1, "ACGTACGT", "V1*01", "all", 100, 100, 20, 50, 5, 50, 6, 0, 0), (2, "ACGT", "V1*02", "all", 50, 90, 20, 50, 5, 40, 6, 0, 1), (3, "ACGTTCGA", "V1*03", "all", 90, 5, 20, 50, 5, 40, 6, 0, 1), (4, "TTTTTTTT", "V2*01", "2-4", 10, 5, 2, 1, 5, 4, 6, 0, 1)]
    df = spark.createDataFrame(rows, CANDIDATE)
    kept, notes = germline.germline_filter(df, GermlineCriteria())
    why = {r.idx: r.why_filtered for r in notes.collect()}
    assert [r.idx for r in kept.collect()] == [1]
    assert why[2].startswith("identical_to=V1*01,truncated;") and why[3].startswith("ex_occ_ratio=0.1,other=V1*01;") and why[4] == "too_low_CDR3s_exact;too_low_cluster_size;"
    white = df.filter("idx = 2").select(F.col("consensus").alias("sequence"))
    assert {r.idx for r in germline.germline_filter(df, GermlineCriteria(), white)[0].collect()} == {1, 2}


def test_names_and_j(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["g1", "g1", "g1", "g2"])], "idx long, name string")
    assert [r.name for r in discovery.unique_names(df).orderBy("idx").collect()] == ["g1", "g1A", "g1B", "g2"]
    j = spark.createDataFrame([("a", "J1*01", 100, 5, "ACGTAAAA"), ("b", "J1*01", 10, 5, "ACGTCCCC"), ("c", "J1*02", 1, 5, "ACGTAAAC"), ("d", "J2*01", 5, 5, "GGGGAAAT")], "name string, source string, exact long, CDR3s_exact long, consensus string")
    assert {r.name for r in discovery.j_allele_ratio(j, 0.2).collect()} == {"a", "d"}
    assert {r.name for r in discovery.j_cross_mapping(j, 0.1).collect()} == {"a", "b"}


def records(spark, *rows):
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(rows)], "ord long, name string, sequence string")


def test_databases(spark):
    a = records(spark, ("a1", "ACGTACGT"), ("a2", "CCCCCCCC"), ("a3", "GGGGGGGGGGGGGGGG"))
    b = records(spark, ("a1", "ACGTACGT"), ("x2", "CCCCCCCC"), ("b3", "TTTTTTTTTTTTTTTT"))
    diff = databases.compare(a, b)
    assert (len(diff["identical"]), diff["renamed"], diff["only_a"], diff["only_b"], databases.exit_code(diff)) == (2, [("a2", "x2")], ["a3"], ["b3"], 1)
    assert databases.exit_code(databases.compare(a, a)) == 0 and databases.report(diff).startswith("3 vs 3 records. 1 lost, 1 gained, 1 identical, 1 different name, 0 similar")
    near = databases.compare(records(spark, ("a", "ACGTACGT")), records(spark, ("b", "ACGTTCGT")))
    assert near["similar"] == [("a", "b", "ACGT{A → T}CGT")] and "~ a -- b\nACGT{A → T}CGT" in databases.report(near)
    dup = databases.duplicates(records(spark, ("a", "AC"), ("b", "AC"), ("a", "GG"))).collect()
    assert {tuple(r) for r in dup} == {("name", "a", None), ("sequence", "b", "a")}
    named = databases.rename(records(spark, ("x", "ACGTACGG"), ("y", "ACGTACGT")), records(spark, ("V2*01", "ACGTACGT"), ("V9*01", "TTTTTTTT")))
    assert {r.name: r.new_name for r in named.collect()} == {"y": "V2*01", "x": "V2*02"}
    u = databases.union(records(spark, ("p", "ACGT"), ("q", "ACGTAC"), ("r", "GGGG"), ("s", "ACGTA")))
    assert [tuple(r) for r in u.collect()] == [("p", "ACGTAC"), ("r", "GGGG")]
    assert [tuple(r) for r in databases.sanitize(records(spark, ("ACC|IGHV1*01|x", "ac..gt"), ("e", "..."))).select("name", "sequence").collect()] == [("IGHV1*01", "ACGT")]


def test_merging(spark):
    a, b = "ACGTACGTTTGACC", "TTTGACCGGAATT"
    assert merging.overlap(a, b, 5) == "ACGTACGTTTGACCGGAATT" and merging.overlap("AAAA", "CCCC", 2) is None
    assert merging.parse_log("pear", "Assembled reads ...................: 1,200 / 1,500 (80%)") == (1200, 1500)
    assert merging.parse_log("flash", "Total pairs:  10\nCombined pairs:  7") == (7, 10)
    left, right = records(spark, ("r/1", a)), records(spark, ("r/2", "AATTCCGGTCAAA"))
    assert merging.merge_pairs(left, right, 5).first().sequence == "ACGTACGTTTGACCGGAATT"


def test_heatmap_and_upstream(spark):
    assert clusterplots.heatmap({"gene": "G", "n_sequences": 2, "n_clusters": 0, "distances": [[0.0, 1.0], [1.0, 0.5]]}) == "G: 2 sequences, 0 clusters\nDistance matrix 2×2\n █\n█▒"
    df = spark.createDataFrame([(i, "V1", 0.0, "ACGT" * 3 + "A" * (i % 3)) for i in range(30)], "row_id long, v_call string, V_SHM double, UTR string")
    assert upstream.long_enough(df).count() == 10
    with pytest.raises(ValueError):
        upstream.target(df, "leader")


def germline_set():
    rng = random.Random(42)
    nt = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    v = [(f"IGHV{i}*01", nt(240) + "TATTACTGTGCG") for i in range(4)]
    return rng, v, [(f"IGHD{i}*01", nt(20)) for i in range(3)], [(f"IGHJ{i}*01", nt(10) + "TGGGGC" + nt(30)) for i in range(3)]


def test_assign_and_augment(spark):
    rng, v, d, j = germline_set()
    reads = [(f"read{i};size={i + 1};barcode=ACG;", v[i % 4][1] + "AC" + d[i % 3][1] + "G" + j[i % 3][1]) for i in range(12)]
    dbs = [records(spark, *x) for x in (v, d, j)]
    out = augment.augment(assign.assign(records(spark, *reads), *dbs), *dbs).orderBy(F.expr("cast(substring(sequence_id, 5) as int)")).collect()
    for i, r in enumerate(out):
        assert (r.v_call, r.j_call, r["count"], r.barcode) == (v[i % 4][0], j[i % 3][0], i + 1, "ACG")
        assert r.V_errors == 0 and r.V_SHM == 0 and r.V_covered >= 95 and r.V_CDR3_start == 249
        assert r.cdr3 == reads[i][1][249 : len(reads[i][1]) - 36 + 0]


def test_assignment_names_penalty_and_empty_databases(spark):
    rng, v, d, j = germline_set()
    v = [(f"X{i}|{name}|Homo", s) for i, (name, s) in enumerate(v)]
    dbs = [records(spark, *x) for x in (v, d, j)]
    wrong = "ACGT"[("ACGT".index(v[1][1][120]) + 1) % 4]
    read = records(spark, ("r", v[1][1][:120] + wrong + v[1][1][121:] + d[0][1] + j[0][1]))
    row = assign.assign(read, *dbs).first()
    assert (row.v_call, row.locus) == ("X1_IGHV1*01", "IGH") and row.v_identity < 100
    assert assign.assign(read, *dbs, penalty=3).first() == row
    assert "-" in assign.assign(read, *dbs, penalty=500).first().v_germline_alignment  # two gaps cost less than the mismatch
    with pytest.raises(ValueError, match="D gene database is empty"):
        assign.assign(read, dbs[0], dbs[1].limit(0), dbs[2])


def test_assignment_by_a_program(tmp_path, monkeypatch):
    """Small programs in place of the installed ones: the call form, the databases and the reading of the table."""
    (tmp_path / "makeblastdb").write_text("#!/bin/sh\ncp $5 $7.made\n")
    (tmp_path / "igblastn").write_text(
        "#!/bin/sh\necho \"$@\" >> $(dirname $0)/calls\ncat $2.made >> $(dirname $0)/genes\n"
        "printf 'sequence_id\\tsequence\\tlocus\\tv_call\\tv_identity\\tv_germline_start\\trev_comp\\n'\n"
        "while read h; do read s; printf '%s\\t%s\\tIGH\\t%%X\\t98.5\\t3\\tF\\n' \"${h#>}\" $s; done\n"
    )
    for p in ("makeblastdb", "igblastn"):
        (tmp_path / p).chmod(0o755)
    genes = {p: [(f"{p}1*01", "acgtx")] for p in "VDJ"}
    batches = [pd.DataFrame({"name": ["r 1", "r2"], "sequence": ["ACGT", "AC"]}), pd.DataFrame({"name": ["r3"], "sequence": ["A"]})]
    with pytest.raises(FileNotFoundError, match="not installed"):
        list(assign._by_program(iter(batches), genes, 0, "Ig", ""))
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    rows = pd.concat(assign._by_program(iter(batches), genes, 2, "TCR", "human"))
    assert list(rows.columns) == assign.NAMES and rows["sequence_id"].tolist() == ["r 1", "r2", "r3"]
    assert set(rows["v_call"]) == {"%X"} and set(rows["v_identity"]) == {98.5} and set(rows["v_germline_start"]) == {3} and set(rows["j_germline_end"]) == {0} and set(rows["d_call"]) == {""}
    calls = (tmp_path / "calls").read_text().splitlines()
    assert len(calls) == 2 and all(x in calls[0] for x in ("-penalty 2", "-organism human", "-ig_seqtype TCR", "-outfmt 19", "-num_alignments_J 1"))
    assert (tmp_path / "genes").read_text() == ">%V1*01\nACGTN\n" * 2
    with pytest.raises(ValueError, match="sequence type"):
        assign.assign_by_program(None, None, None, None, sequence_type="BCR")


def test_discovery_finds_a_new_allele(spark):
    rng, v, *_ = germline_set()
    known, new = v[0][1], v[0][1][:100] + ("A" if v[0][1][100] != "A" else "C") + v[0][1][101:]
    rows = [(i, v[0][0], f"IGHJ{i % 4}*01", "IGHD1*01", "".join(rng.choice("ACGT") for _ in range(12)), (known, new)[i % 2], float(i % 2), 0.0, i % 2, 252, "IGH") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, v_call string, j_call string, d_call string, cdr3 string, V_nt string, V_SHM double, J_SHM double, V_errors long, V_CDR3_start long, locus string")
    found = discovery.discover_v(df, records(spark, *v), threshold=0.4).collect()
    assert {r.consensus for r in found} <= {known, new} and any(r.name == v[0][0] for r in found)
    split = df.withColumn("V_SHM", F.when(F.col("V_errors") == 1, 3.0).otherwise(0.0))
    names = {r.consensus: (r.database_diff, r.exact, r.Js_exact) for r in discovery.discover_v(split, records(spark, *v)).collect()}
    assert names[new] == (1, 30, 2) and names[known] == (0, 30, 2)


def brute_components(n, linked):
    root = list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_edit_links_equal_brute_force(spark):
    rng = random.Random(2)
    texts = list(dict.fromkeys("".join(rng.choice("ACG") for _ in range(rng.randint(0, 11))) for _ in range(150)))
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "row_id long, g string, cdr3 string")
    for most in (0, 1, 2, 3, 6):
        got = {(r.a, r.b) for r in clonotypes.edit_links(df, ["g"], "cdr3", "row_id", most).collect()}
        assert got == {(j, i) for i in range(len(texts)) for j in range(i) if kernels.edits(texts[i], texts[j], 99) <= most}, most


def test_star_rows_equal_the_kernel(spark):
    rng = random.Random(8)

    def edit(s):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s = s[:i] + rng.choice(["", "A", "GT", s[i]]) + s[i + 1 :]
        return s

    base = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(6)]
    groups = {g: [edit(base[g]) if g else base[g] for _ in range(rng.randint(1, 9))] for g in range(6)}
    rows = [(i, g, s) for i, (g, s) in enumerate((g, s) for g, x in groups.items() for s in x)]
    got = consensus.star_rows(spark.createDataFrame(rows, "ord long, g long, s string").repartition(3), ["g"], "s", "ord").orderBy("ord").collect()
    for g, x in groups.items():
        assert [r.aligned for r in got if r.g == g] == kernels.star_alignment(x)


def test_barcode_consensus_aligns_first(spark):
    rng = random.Random(5)
    core = "".join(rng.choice("ACGT") for _ in range(40))
    lost = core[:12] + core[13:]
    rows = [("TTT", core), ("TTT", lost), ("TTT", core), ("TTT", core), ("CCC", core), ("CCC", lost), ("GGG", lost), ("GGG", lost), ("GGG", lost)]
    df = spark.createDataFrame([(i, f"r{i}", b + s) for i, (b, s) in enumerate(rows)], "ord long, name string, sequence string")
    got = {r.header: (r.sequence, r["size"]) for r in copies.group_reads(df, 3).collect()}
    assert got == {"r4;barcode=CCC;size=2;": (core, 2), "consensus1;barcode=GGG;size=3;": (lost, 3), "consensus2;barcode=TTT;size=4;": (core, 4)}


def test_names_past_ninety_nine_and_prefixes(spark):
    many = records(spark, *((f"x{i}", "ACGTACGT") for i in range(105)))
    named = databases.rename(many, records(spark, ("V2*01", "ACGTACGT"))).collect()
    assert {r.new_name for r in named} == {f"V2*{i:02d}" for i in range(1, 106)}
    rng = random.Random(1)
    rows = [(f"n{i}", "".join(rng.choice("AC") for _ in range(rng.randint(0, 6)))) for i in range(40)]
    got = {tuple(r) for r in databases.prefix_pairs(records(spark, *rows)).collect()}
    assert got == {(i, j) for i, (_, s) in enumerate(rows) for j, (_, t) in enumerate(rows) if i != j and t.startswith(s) and (len(s) < len(t) or i < j)}
    assert [tuple(r) for r in databases.union(records(spark, *rows[:12])).collect()] == databases.merge_prefixes(rows[:12])


def test_j_discovery_from_alignments(spark):
    rows = [(i, "IGHJ1*01" if i % 2 else "IGHJ2*01", 0, f"AAA{'ACGT'[i % 4]}", "ACGTAC-GTTT" if i % 2 else "GGGGTTTTCCCC") for i in range(20)] + [(90, "IGHJ2*01", 0, "C", None)]
    df = spark.createDataFrame(rows, "row_id long, j_call string, J_errors long, cdr3 string, j_sequence_alignment string")
    got = {r.source: (r.name, r.exact, r.consensus) for r in discovery.discover_j(df, records(spark, ("IGHJ1*01", "ACGTACGTTT"), ("IGHJ2*01", "GGGGTTTTCCCA"))).collect()}
    assert got["IGHJ1*01"] == ("IGHJ1*01", 10, "ACGTACGTTT") and got["IGHJ2*01"][1:] == (11, "GGGGTTTTCCCC") and got["IGHJ2*01"][0].startswith("IGHJ2*01_S")
    empty = spark.createDataFrame([(i, "V1", None if i % 2 else "", 0.0) for i in range(8)], "row_id long, v_call string, V_nt string, V_SHM double")
    assert discovery.siblings(empty, records(spark, ("V1", "ACGT"))).count() == 0


def test_upstream_goes_by_the_utr(spark):
    rows = [(i, "V1", 0.0, "A" * (i + 1), "C" * (40 - i)) for i in range(15)] + [(50, "V2", 0.0, "A", "C")]
    df = spark.createDataFrame(rows, "row_id long, v_call string, V_SHM double, UTR string, leader string")
    assert {r.row_id for r in upstream.long_enough(df, "UTR+leader").collect()} == {*range(5, 15), 50}
    assert {r.row_id for r in upstream.long_enough(df, "UTR", 2).collect()} == set(range(5, 15))


def test_cluster_siblings(spark):
    rng = random.Random(3)
    nt = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    known, far = nt(60), nt(60)
    rows = [(i, "V1", f"J{i % 3}", "", nt(9), (known if i % 2 else far)[:-1] + "ACGT"[i % 4], 50.0, 0.0, 3, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, v_call string, j_call string, d_call string, cdr3 string, V_nt string, V_SHM double, J_SHM double, V_errors long, V_CDR3_start long")
    found = {r.cluster: r for r in discovery.discover_v(df, records(spark, ("V1", known)), threshold=0.45, strict=False).collect()}
    assert {r.consensus[:59] for k, r in found.items() if k.startswith("cl")} == {known[:59], far[:59]}
    assert all(r.cluster_size == 20 for k, r in found.items() if k.startswith("cl"))
    assert not any(r.cluster.startswith("cl") for r in discovery.discover_v(df, records(spark, ("V1", known)), threshold=0.45).collect())


def test_many_candidates(spark):
    """More candidates than were walked on the driver before; a chain of names of which every second one stands."""
    rows = [(f"J{i:05}", 10**9 // 11**i if i < 9 else 10**9, "ACGT" if i < 9 else "GG" + "ACGT"[i % 4] * 2) for i in range(5200)]
    df = spark.createDataFrame(rows, "name string, exact long, consensus string")
    got = {r.name for r in discovery.j_cross_mapping(df).collect()}
    assert got == {r[0] for r in rows[9:]} | {"J00000"}
    plan = discovery.j_cross_pairs(df)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(0, 5)], "a long, b long")
    for walked in (0, 3, 100):
        assert {r.node for r in elimination.fallen(links, walked).collect()} == {1, 3, 5, 7, 9}


def test_many_germline_candidates(spark):
    """More candidates than were collected before; of two with one sequence, the smaller falls."""
    made = spark.range(50_100).selectExpr("id as idx", "concat('G', id, '*01') as name", "md5(cast(greatest(id, 1) as string)) as consensus", "'all' as cluster", "500 - id % 2 as cluster_size", "9 as exact", "9 as Ds_exact", "9 as clonotypes", "1 as database_diff", "30 as CDR3_start", "-1 as whitelist_diff", "0 as is_filtered", "'' as why_filtered")
    got = germline.eliminate(made, GermlineCriteria())
    assert got.count() == 50_100 and [(r.idx, r.is_filtered, r.why_filtered) for r in got.filter("is_filtered > 0").collect()] == [(1, 1, "identical_to=G0*01;")]
