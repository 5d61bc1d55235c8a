"""CDR3 anchors and the CDR3 of whole reads, by locus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloneframe.functions.sequence import let, translate

# Motifs of conserved residues around the CDR3, by locus.
LOCI = ("IGH", "IGK", "IGL", "TRA", "TRB", "TRG", "TRD")
V_START_HEAVY = (r"[FY][FHVWY]C([ADEGIKMNRSTV\*]|$)", r"C(.[RK])")
V_START_END = {"IGK": r"[FSVY][CFHNVY][CDFGLSW]", "IGL": r"[CDY](?![CDY][CFHSY][CFGW])[CFHSY][CFGW]", "TRG": r"[YFH]C", "TRD": r"[YFH]C"}
J_END = {locus: "W[GAV]" if locus == "IGH" else "FG" for locus in LOCI}
READ = {
    "IGH": (r"[FY][FHVWY]C([ADEGIKMNRSTV].{3,31})W[GAV]", r"C(.[RK].{3,30})[WF]G.G"),
    "IGK": (r"[FSVY][CFHNVY][CDFGLSW](.{4,15})[FLV][GRV]",),
    "IGL": (r"[CDY](?![CDY][CFHSY][CFGW])[CFHSY][CFGW](.{4,15})[FS]G",),
}
TAIL, TAIL_SHORT = 15, 8


def _start_of(text: Column, pattern: str, group: int) -> Column:
    """Zero-based place of a group of the first match, or null. The group ends the match or is followed by nothing
    else, so its place follows from the text before it."""
    whole = F.regexp_extract(text, f"({pattern})", 0)
    inner = F.regexp_extract(text, pattern, group)
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, at - 1 + F.length(whole) - F.length(inner))


def start_in_v(s: Column, locus: str) -> Column:
    """Nucleotides before the CDR3 in a V gene; 0 if not found."""
    if locus not in LOCI:
        return F.lit(0)

    def place(tail: Column) -> Column:
        if locus == "IGH":
            return F.coalesce(*(_start_of(tail, p, 1) for p in V_START_HEAVY))
        if locus in V_START_END:
            p = V_START_END[locus]
            i = F.regexp_instr(tail, F.lit(p))
            return F.when(i > 0, i - 1 + F.length(F.regexp_extract(tail, p, 0)))
        i = F.instr(tail, "C")
        return F.when(i > 0, i)

    def start(aa: Column) -> Column:
        tail = F.right(aa, F.lit(TAIL_SHORT if locus in ("TRA", "TRB") else TAIL))
        return 3 * (F.length(aa) - F.length(tail) + let(tail, place))

    return F.coalesce(let(translate(s), start), F.lit(0)).cast("int")


def end_in_j(s: Column, locus: str) -> Column:
    """Nucleotides before the CDR3's end in a J gene, in the first frame that has the motif; 0 if not found."""
    if locus not in J_END:
        return F.lit(0)
    def in_frame(whole: Column, f: int) -> Column:
        at = F.regexp_instr(translate(F.substring(whole, F.lit(f + 1), F.length(whole))), F.lit(J_END[locus]))
        return let(at, lambda i: F.when((F.length(whole) > f) & (i > 0), (i - 1) * 3 + f))

    def end(whole: Column) -> Column:
        return F.coalesce(*(in_frame(whole, f) for f in range(3)))

    return F.coalesce(let(s, end), F.lit(0)).cast("int")


def find_in_read(s: Column, locus: str) -> Column:
    """struct(start, end): zero-based bounds of the CDR3 in the frame where it starts first, each frame having its first
    pattern that matches; (0, 0) if there is none."""
    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    if locus not in READ:
        return none
    return F.coalesce(let(s, lambda whole: F.array_min(F.array(*(_in_frame(whole, locus, f) for f in range(3))))), none)


def _in_frame(s: Column, locus: str, f: int) -> Column:
    def bounds(aa: Column) -> Column:
        found = []
        for pattern in READ[locus]:
            cdr3 = F.regexp_extract(aa, pattern, 1)
            lead = pattern[: pattern.index("(", 1) if not pattern.startswith("[CDY](?!") else pattern.index("(.")]
            at = F.regexp_instr(aa, F.lit(pattern)) - 1
            before = F.length(F.regexp_extract(F.substring(aa, at + 1, F.length(aa)), f"^{lead}", 0))
            start = 3 * (at + before) + f
            found.append(F.when(at >= 0, F.struct(start.cast("int").alias("start"), (start + 3 * F.length(cdr3)).cast("int").alias("end"))))
        return F.coalesce(*found)

    return let(translate(F.substring(s, F.lit(f + 1), F.length(s))), bounds)
