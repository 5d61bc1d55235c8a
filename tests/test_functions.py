import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloneframe.functions import alignment, cdr3, kernels, names
from cloneframe.functions import sequence as seq


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(s):
    return F.lit(s)


def test_sequences(spark):
    cases = [
        (seq.translate(lit("ATGAAAGGG")), "MKG"), (seq.translate(lit("TAATAGTGA")), "***"), (seq.translate(lit("at")), ""), (seq.translate(lit("ATGA")), "M"), (seq.translate(lit("GCNRAYTAR")), "AX*"),
        (seq.reverse_complement(lit("ATCG")), "CGAT"), (seq.has_stop(lit("TAA")), True), (seq.has_stop(lit("GGGAC")), False),
        (seq.edit_distance(lit("kitten"), lit("sitting")), 3), (seq.edit_distance(lit("ABC"), lit("XYZ"), 1), 2), (seq.edit_distance(lit("AAAA"), lit("ZZZZ"), 2), 3), (seq.edit_distance(lit("A"), lit("ABCD"), 1), 2),
        (seq.hamming(lit("AAAA"), lit("ABCA")), 2), (seq.hamming(lit(""), lit("")), 0), (seq.safe_divide(lit(10), lit(5)), 2.0), (seq.safe_divide(lit(1), lit(0)), 0.0),
        (seq.sequence_hash(lit("ATCG")), "S2353"), (seq.sanitize_gapped(lit("ac..Gt")), "ACGT"), (seq.sanitize_nucleotides(lit("acgxu")), "ACGNU"),
        (seq.trim_leading_g(lit("GGGAATCG")), "AATCG"), (seq.trim_leading_g(lit("GGGG")), ""), (seq.pseudo_cdr3(lit("A" * 5 + "C" * 10 + "G" * 5), 15, 5), "C" * 10),
        (seq.merge_n(lit("ANCG"), lit("ATCG")), "ATCG"), (seq.merge_n(lit("GGGC"), lit("ATCG")), None), (seq.merge_n(lit("AT"), lit("ATCG")), "ATCG"),
        (seq.fixed(lit(0.125), 2), "0.12"), (seq.fixed(lit(0.375), 2), "0.38"), (seq.fixed(lit(1.0), 1), "1.0"), (seq.fixed(lit(0.05), 1), "0.1"),
    ]
    for column, want in cases:
        assert one(spark, column) == want, want
    with pytest.raises(Exception, match="lengths differ"):
        one(spark, seq.hamming(lit("A"), lit("AB")))


def test_barcodes(spark):
    assert [one(spark, c) for c in seq.barcode_of_group(lit("AAAAATCGATCG"), 5)] == ["AAAAA", "TCGATCG"]
    assert [one(spark, c) for c in seq.barcode_of_group(lit("AAAAATCGATCG"), -4)] == ["ATCG", "AAAAATCG"]
    assert [one(spark, c) for c in seq.barcode_of_group(lit("AA"), 5)] == ["AA", "AA"]
    assert [one(spark, c) for c in seq.barcode_of_copy(lit("AA"), 5)] == ["AA", ""]


def test_names(spark):
    h = lit("myread;size=12;barcode=ACG;")
    assert [one(spark, f(h)) for f in (names.header_name, names.header_size, names.header_barcode)] == ["myread", 12, "ACG"]
    assert [one(spark, f(lit("simple_name"))) for f in (names.header_name, names.header_size, names.header_barcode)] == ["simple_name", 0, ""]
    assert one(spark, names.header_size(lit("x;size=1;size=7"))) == 7
    assert one(spark, names.allele_of_header(lit("A|IGHV1*01|x"))) == "IGHV1*01" and one(spark, names.allele_of_header(lit("plain"))) == "plain"
    assert one(spark, names.natural_key(lit("file2"))) < one(spark, names.natural_key(lit("file10")))
    assert one(spark, names.gene_of(lit("IGHV1*01"))) == "IGHV1" and one(spark, names.allele_of(lit("IGHV1*01"))) == "01" and one(spark, names.allele_of(lit("IGHV1"))) == ""
    assert names.call_column("V") == "v_call"
    with pytest.raises(ValueError):
        names.call_column("X")


def test_alignments(spark):
    assert one(spark, alignment.errors(lit("AT-G"), lit("ATCG"))) == 1 and one(spark, alignment.errors(lit(""), lit("A"))) == 0
    assert one(spark, alignment.coverage(lit("AT-CG"), lit(4))) == 100 and one(spark, alignment.coverage(lit("AT--"), lit(4))) == 50 and one(spark, alignment.coverage(lit(""), lit(4))) == 0
    at = lambda *a: one(spark, alignment.query_position(*map(lit, a)))
    assert at(1, 1, "ATCG", "ATCG", 3) == 3 and at(1, 1, "A-TCG", "AGTCG", 2) == 3 and at(1, 1, "AT", "AT", 9) == -1 and at(3, 1, "AT", "AT", 2) == 0
    assert one(spark, alignment.shm(lit(None).cast("double"))) == 0 and one(spark, alignment.shm(lit(95.5))) == 4.5


def test_cdr3(spark):
    aa = {"Y": "TAT", "C": "TGT", "A": "GCA", "R": "CGT", "D": "GAT", "W": "TGG", "G": "GGT", "F": "TTT"}
    nt = lambda s: "".join(aa[c] for c in s)
    assert one(spark, cdr3.start_in_v(lit(nt("GGYYCAR")), "IGH")) == 15
    assert one(spark, cdr3.start_in_v(lit(nt("GGGCA")), "TRB")) == 12
    assert one(spark, cdr3.start_in_v(lit(nt("GGYCA")), "TRG")) == 12
    assert one(spark, cdr3.start_in_v(lit(nt("GG")), "IGH")) == 0 and one(spark, cdr3.start_in_v(lit("ACG"), "XYZ")) == 0
    assert one(spark, cdr3.end_in_j(lit("A" + nt("DWGA")), "IGH")) == 4 and one(spark, cdr3.end_in_j(lit(nt("AFGA")), "IGK")) == 3
    found = one(spark, cdr3.find_in_read(lit("A" + nt("GYYCARDDYWGA")), "IGH"))
    assert (found.start, found.end) == (13, 28)
    none = one(spark, cdr3.find_in_read(lit("ACGT"), "TRA"))
    assert (none.start, none.end) == (0, 0)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


DNA = st.text("ACGT", max_size=12)


@given(DNA, DNA, st.integers(0, 14))
@settings(max_examples=200, deadline=None)
def test_capped_edits(a, b, cap):
    assert kernels.edits(a, b, cap) == min(plain_edits(a, b), cap + 1) == kernels.edits(b, a, cap)


def plain_score(a, b):
    low = -(10**6)
    m = {(0, 0, 0): 0}
    get = lambda i, j, k: m.get((i, j, k), low)
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                m[i, j, 0] = max(get(i - 1, j - 1, k) for k in range(3)) + (1 if a[i - 1] == b[j - 1] else -3)
            if i:
                m[i, j, 1] = max(get(i - 1, j, 0) - 6, get(i - 1, j, 2) - 6, get(i - 1, j, 1) - 1)
            if j:
                m[i, j, 2] = max(get(i, j - 1, 0) - 6, get(i, j - 1, 1) - 6, get(i, j - 1, 2) - 1)
    return max(get(len(a), len(b), k) for k in range(3))


@given(DNA, DNA)
@settings(max_examples=200, deadline=None)
def test_affine_alignment_is_optimal_and_whole(a, b):
    x, y, score, wrong = kernels.align(a, b)
    assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
    assert score == plain_score(a, b) and wrong == sum(p != q for p, q in zip(x, y, strict=True))


def test_changes_and_consensus():
    assert kernels.describe_change("AAA", "AGA") == "2A>G"
    assert kernels.describe_change("AAGG", "AATTGG") == "2_3insTT"
    assert kernels.describe_change("AATTGG", "AAGG") == "3_4delTT"
    assert kernels.consensus(["ATCG"] * 3) == "ATCG" and kernels.consensus([]) == ""
    assert kernels.iterative_consensus(["ATCGATCG"] * 300, 0.6) == "ATCGATCG"
    assert {len(r) for r in kernels.star_alignment(["ACGTACGT", "ACGACGT", "ACGTTACGT"])} == {9}
    d = kernels.distances(["AAAA", "AABA", "AAAA"])
    assert d[0, 2] == 0 and d[0, 1] > 0 and (d == d.T).all()
    assert kernels.cut_by_ratio(d, 2) == [0, 0, 0]
    two = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0]])
    assert sorted(kernels.cut_by_ratio(two, 2, strict=False)) == [1, 1, 2, 2]
    assert kernels.upgma(two)[-1][2] == 9
    with pytest.raises(ValueError):
        kernels.aligner("none")


def test_align_many():
    """The rows of the alignment of each pair by itself, in few steps: blocks of any size, equal, empty and odd texts."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    refs = [text(rng.randrange(0, 40)) for _ in range(300)] + ["", "A", "ACGé", "acgt", "AAAA"]
    queries = [text(rng.randrange(0, 40)) if i % 3 else r[: len(r) // 2] + text(rng.randrange(4)) + r[len(r) // 2 + rng.randrange(4) :] for i, r in enumerate(refs[:300])] + ["", "", "ACG", "acgt", "AATAA"]
    want = [kernels.align(a, b) for a, b in zip(refs, queries, strict=True)]
    for most in (1, 20_000, 2_000_000):
        assert kernels.align_many(refs, queries, most=most) == want
    assert kernels.align_many([], []) == []
