"""Threshold-scaled sketches of documents, in DataFrame functions alone.

A document's shingles are its k-word windows (its whole word sequence, if shorter); each is hashed to 64 bits, and
every hash below a fixed fraction of the range is retained. Which hashes stay depends on the shingle alone, so the
sketch of a union is the union of sketches, and shared retained hashes over those of the smaller one estimate
containment however unequal the documents are; over those of the union, the Jaccard likeness.

The fingerprint text is `<shingles retained>-<hash of the text>:<retained hashes in ascending order, hexadecimal>`:
equal texts have equal fingerprints, and texts too short to retain any hash still differ by the text's own.
Likeness is 1 for equal texts, else shared / union of the retained hashes (0 if none is retained).

Likeness rests on the retained hashes alone. Of n shingles about n / 8 are retained, so its standard deviation is
about sqrt(8 j (1 - j) / n) for a likeness j over n shingles of the union: 0.04 at 1000, 0.14 at 100, and below 40 or so
a text may retain nothing, which reads as 0.

The next document in descending id order comes by range: cuts through the order of (id, first bytes of the text), at most
`most_buckets` - 1, put about `per_bucket` rows or more in a bucket; one shuffle brings each bucket together, and the
first rows of a bucket are also sent to the one before it, where they follow its last one. Buckets past that bound
grow with the table; they are sorted with spilling, and nothing else depends on their size. Rows of one id are ordered
by text, so a hot id spreads over buckets, as null ids do.

Cases: null text counts as empty (no shingle; fingerprint of the empty text); null ids come after all others; ties
and repeated rows each have a next row; a single row is its own next one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneframe.llm.common import Scratch

K = 5
FRACTION = 8  # one hash in so many is retained
NULL_ID = -(1 << 63)
START = 16  # bytes of a text that order rows of one id among the buckets
RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def words(text: Column) -> Column:
    """The words of a text; ASCII white space alone separates."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(text: Column, k: int = K) -> Column:
    w = words(text)

    def of(w: Column) -> Column:
        n = F.size(w)
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n <= k, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " "))))
        )

    return F.element_at(F.transform(F.array(w), of), 1)


def sketch(text: Column, k: int = K, fraction: int = FRACTION) -> Column:
    """Ascending retained hashes."""
    limit = (1 << 63) // fraction
    kept = F.filter(shingle_hashes(text, k), lambda h: (h >= -limit) & (h < limit))
    return F.sort_array(F.array_distinct(kept))


def fingerprint(text: Column, hashes: Column) -> Column:
    return F.concat(F.size(hashes).cast("string"), F.lit("-"), F.lower(F.hex(F.xxhash64(text))), F.lit(":"), F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ","))


def merge(a: Column, b: Column) -> Column:
    """Sketch of the union of the documents of two sketches."""
    return F.sort_array(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate; 0 where nothing is retained."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document that is in the larger."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double")), F.lit(0.0))


def with_next(docs: DataFrame, id_col: str, text_col: str, per_bucket: int = 2000, most_buckets: int = 100_000) -> DataFrame:
    """id_col, and text, sketch, following and following_sketch: of the row, and of the next one in descending id order
    (after the last: the first)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    at = F.struct(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("i"), F.hex(F.substring(F.encode(text, "utf-8"), 1, START)).alias("h"))
    scratch = Scratch(docs.sparkSession)
    places = scratch.put("places", docs.select(at.alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")))
    n = places.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, min(most_buckets, n // per_bucket))
    lows = places.repartitionByRange(buckets, "at").groupBy(F.spark_partition_id().alias("p")).agg(F.min("at").alias("low"))
    cuts = sorted(tuple(r["low"]) for r in lows.collect())[1:]  # a row per bucket
    highs = places.groupBy(_bucket(F.col("at"), cuts).alias("b")).agg(F.max("at").alias("at"))
    highs = sorted((r["b"], r["at"]) for r in highs.collect())  # a row per bucket
    # the highest of a bucket follows the lowest of the next higher bucket; the highest of all follows the lowest
    goes = [(at[0], at[1], highs[(j + 1) % len(highs)][0]) for j, (_, at) in enumerate(highs)]
    goes = docs.sparkSession.createDataFrame(goes, "i long, h string, to int").select(F.struct("i", "h").alias("at"), "to")
    scratch.drop()

    source = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), at.alias("at")).withColumn("b", _bucket(F.col("at"), cuts))
    again = source.join(F.broadcast(goes), "at").select("id", "text", "at", F.col("to").alias("b"), F.lit(1).alias("tail"))
    placed = source.select("id", "text", "at", "b", F.lit(0).alias("tail")).unionByName(again).repartition("b").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("b").orderBy("tail", F.col("at").desc(), F.col("text").desc())
    both = placed.withColumn("f", F.lead(F.struct("text", "sketch")).over(order)).filter("tail = 0")
    return both.select(F.col("id").alias(id_col), "text", "sketch", F.col("f.text").alias("following"), F.col("f.sketch").alias("following_sketch"))


def _bucket(at: Column, cuts: list[tuple[int, str]]) -> Column:
    """How many of the ascending cuts are at most `at`, by halving."""
    if not cuts:
        return F.lit(0)
    i, h = (F.split(F.lit(",".join(str(c[k]) for c in cuts)), ",") for k in (0, 1))  # folded to literals
    i = i.cast("array<bigint>")

    def half(a: Column, _: Column) -> Column:
        m = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.struct(F.get(i, m).alias("i"), F.get(h, m).alias("h")) <= at
        step = F.when(below, F.struct((m + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi")))
        return F.when(a["lo"] < a["hi"], step).otherwise(a)

    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), half)["lo"]


def edited(text: Column, following: Column) -> Column:
    """text with its last half replaced by as many code points of following."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of docs."""
    if clash := {"text", "sketch", "following", "following_sketch", *RESULT} & {id_col}:
        raise ValueError(f"columns {sorted(clash)} are made here; rename yours")
    text, after = F.col("text"), F.col("following")
    made = with_next(docs, id_col, text_col).withColumn("edited", edited(text, after))
    made = made.withColumn("edited_sketch", sketch(F.col("edited")))
    like = lambda other, hashes: F.when(other == text, 1.0).otherwise(likeness(F.col("sketch"), F.col(hashes)))
    return made.select(
        f"`{id_col}`",
        F.length(text).cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(text, F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
        like(F.col("edited"), "edited_sketch").alias("near_edited"),
        like(after, "following_sketch").alias("near_next"),
    )
