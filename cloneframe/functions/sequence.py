"""Nucleotide and protein expressions; each returns a Column that stays inside generated code or array functions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code in TCAG order, and the nucleotide ambiguity codes.
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMBIGUITY = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT = ("ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn")


def amino_acid(codon: str) -> str:
    """Of one codon in ACGT and ambiguity codes; X where it is not resolved."""
    found = {CODE[16 * BASES.index(a) + 4 * BASES.index(b) + BASES.index(c)] for a, b, c in product(*(AMBIGUITY.get(x, "") for x in codon))}
    return found.pop() if len(found) == 1 else "X"


def resolved_codons() -> dict[str, str]:
    """Codons with an ambiguity code that still name one amino acid."""
    return {c: a for c in map("".join, product(AMBIGUITY, repeat=3)) if any(x not in BASES for x in c) and (a := amino_acid(c)) != "X"}


def chars(s: Column) -> Column:
    """Array of a string's characters; empty for the empty string."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row: a lambda's variable, where a name would be inlined at every use."""
    return F.get(F.transform(F.array(value), body), 0)


def _upper(s: Column) -> Column:
    return F.replace(F.upper(s), F.lit("U"), F.lit("T"))


def translate(s: Column) -> Column:
    """Amino acids of the codons from the first base on; the last one or two bases are left out."""
    code = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
    listed = F.lit(" ".join(code))  # a codon of plain bases has its amino acid at its place in the list
    known = F.create_map(*(F.lit(x) for pair in {**code, **resolved_codons()}.items() for x in pair))

    def plain(codon: Column) -> Column:
        return F.substring(F.lit(CODE), ((F.instr(listed, codon) + 3) / 4).cast("int"), F.lit(1))

    def wide(codon: Column) -> Column:
        return F.coalesce(F.try_element_at(known, codon), F.lit("X"))

    def protein(up: Column) -> Column:
        codons = F.transform(F.sequence(F.lit(1), F.length(up) - 2, F.lit(3)), lambda i: F.substring(up, i, F.lit(3)))
        return F.when(F.length(up) < 3, "").otherwise(F.array_join(F.when(up.rlike("[^ACGT]"), F.transform(codons, wide)).otherwise(F.transform(codons, plain)), ""))

    return let(_upper(s), protein)


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, *COMPLEMENT))


def has_stop(s: Column) -> Column:
    """Whether translate(s) has a stop: a codon of stops alone in the first frame."""
    return _upper(s).rlike(r"^(?:[\s\S]{3})*?(?:TA[AGR]|T[GR]A)")


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance; with most, most + 1 for anything above it."""
    if most is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of one length; an error if the lengths differ."""
    n = F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), n).otherwise(F.raise_error(F.lit("hamming: lengths differ")).cast("int"))


def hamming_common(a: Column, b: Column) -> Column:
    """Differing places over the common length."""
    n = F.least(F.length(a), F.length(b))
    return hamming(F.left(a, n), F.left(b, n))


def sequence_hash(s: Column, digits: int = 4) -> Column:
    """S and a number from the last four hex digits of the SHA-256, modulo 10**digits, zero padded."""
    n = F.conv(F.right(F.sha2(s, 256), F.lit(4)), 16, 10).cast("int") % 10**digits
    return F.concat(F.lit("S"), F.lpad(n.cast("string"), digits, "0"))


def unique_name(name: Column, s: Column) -> Column:
    return F.concat(F.substring_index(name, "_S", 1), F.lit("_"), sequence_hash(s))


def sanitize_gapped(s: Column) -> Column:
    """Without dots, upper case."""
    return F.upper(F.replace(s, F.lit("."), F.lit("")))


def sanitize_nucleotides(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^ACGTUN]", "N")


def trim_leading_g(s: Column) -> Column:
    return F.regexp_replace(s, "^[Gg]+", "")


def barcode_of_group(s: Column, n: int) -> tuple[Column, Column]:
    """(barcode, rest) for grouping: n > 0 from the 5' end, n < 0 from the 3' end; a read shorter than the barcode is
    its own barcode and stays whole."""
    return _barcode(s, n, s)


def barcode_of_copy(s: Column, n: int) -> tuple[Column, Column]:
    """(barcode, rest) for dereplication: as for grouping, but nothing is left of a read shorter than the barcode."""
    return _barcode(s, n, F.lit(""))


def _barcode(s: Column, n: int, short: Column) -> tuple[Column, Column]:
    k = abs(n)
    if not k:
        return F.lit(""), s
    size = F.length(s)
    own, rest = (F.left(s, F.lit(k)), F.substring(s, F.lit(k + 1), size)) if n > 0 else (F.right(s, F.lit(k)), F.left(s, size - k))
    return F.when(size < k, s).otherwise(own), F.when(size < k, short).otherwise(rest)


def pseudo_cdr3(s: Column, start: int, end: int) -> Column:
    """The bases from `start` to `end` before the 3' end."""
    first = F.greatest(F.length(s) - start + 1, F.lit(1))
    last = F.length(s) - end
    return F.when(last >= first, F.substring(s, first, last - first + 1)).otherwise("")


def merge_n(a: Column, b: Column) -> Column:
    """One string of two that differ only by N and by length; null where they conflict."""
    size = F.greatest(F.length(a), F.length(b))
    pairs = F.zip_with(chars(a), chars(b), lambda x, y: F.when(x.isNull() | (x == "N"), F.coalesce(y, x)).when(y.isNull() | (y == "N") | (x == y), x))
    return F.when(F.exists(pairs, lambda x: x.isNull()), F.lit(None)).otherwise(F.when(size == 0, "").otherwise(F.array_join(pairs, "")))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals; exact ties go to the even digit, as C's printf has it."""
    scaled = x * float(2 ** (digits + 1))
    tie = (scaled == F.floor(scaled)) & (F.pmod(scaled, F.lit(2.0)) == 1)
    return F.when(tie, F.format_string(f"%.{digits}f", F.bround(x, digits))).otherwise(F.format_string(f"%.{digits}f", x))
