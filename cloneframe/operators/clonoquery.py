"""Clonotype similarity join of query rows with reference rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneframe.functions.sequence import hamming
from cloneframe.plans.scratch import Scratch
from cloneframe.sources import tables

CHUNK = 4096  # lines of a class that are one row of the writer
SHARE = 4_000_000  # lines that a task writes, about
REPEATS = 64  # queries of a larger class that one task writes at least
RATES = ("FR1_SHM", "CDR1_SHM", "FR2_SHM", "CDR2_SHM", "FR3_SHM", "V_SHM", "J_SHM", "V_aa_mut", "J_aa_mut")


@dataclass(frozen=True)
class Core:
    """The inner slice of a CDR3, whose outside on one side must be equal: start bases before it, stop bases to its end."""

    start: int
    stop: int


def allowed(n: Column, mismatches: float, core: Core | None = None) -> Column:
    """Most mismatches of a CDR3 of n bases: a number, or below 1 a share of the length."""
    return F.floor((n - (core.start if core else 0)) * mismatches).cast("int") if mismatches < 1 else F.lit(int(mismatches))


def similar(s: Column, t: Column, mismatches: float, core: Core | None = None) -> Column:
    """One length, and few mismatches."""
    n = F.length(s)
    near = (n == F.length(t)) & F.when(n == F.length(t), hamming(s, t) <= allowed(n, mismatches, core)).otherwise(False)
    if core is None:
        return near
    outside = lambda x: (F.left(x, F.lit(core.start)), F.substring(x, F.lit(core.stop + 1), F.length(x)))
    (a, b), (c, d) = outside(s), outside(t)
    return near & ((a == c) | (b == d))


def _sliced(rows: DataFrame, text: str, mismatches: float, core: Core | None) -> DataFrame:
    """Distinct (v_call, j_call, text), once per slice of the text; there is one slice more than mismatches."""
    one = rows.select("v_call", "j_call", F.col("cdr3").alias(text)).distinct()
    n = F.length(text)
    most = F.greatest(allowed(n, mismatches, core), F.lit(-1))
    bound = lambda i: F.floor(n * i / (most + 1)).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda i: F.struct(i.alias("part"), F.substring(F.col(text), bound(i) + 1, bound(i + 1) - bound(i)).alias("slice")))
    return one.filter(most >= 0).select("v_call", "j_call", text, n.alias("_n"), F.explode(made).alias("s")).select("v_call", "j_call", text, "_n", "s.part", "s.slice")


def _sides(query: DataFrame, ref: DataFrame, min_count: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, v_call, j_call, cdr3) of the queries with V, and the reference rows that count."""
    q = query.filter("coalesce(v_call, '') <> ''").select(F.col(key).alias("query_id"), "v_call", "j_call", "cdr3")
    return q, ref.filter(F.col("count") >= min_count) if min_count and "count" in ref.columns else ref


def _near(q: DataFrame, ref: DataFrame, mismatches: float, core: Core | None) -> DataFrame:
    """(v_call, j_call, _q, _r) of the distinct CDR3s that match. Those of one V, J and length with few mismatches agree
    in one of their slices, so they meet by an equi-join on it."""
    pairs = _sliced(q, "_q", mismatches, core).join(_sliced(ref, "_r", mismatches, core), ["v_call", "j_call", "_n", "part", "slice"])
    return pairs.filter(similar(F.col("_q"), F.col("_r"), mismatches, core)).select("v_call", "j_call", "_q", "_r").distinct()


def matches(query: DataFrame, ref: DataFrame, mismatches: float = 1, core: Core | None = None, min_count: int = 0, key: str = "row_id") -> DataFrame:
    """(query_id, and ref's columns) of every match: the rows of the CDR3s that match are joined back."""
    q, ref = _sides(query, ref, min_count, key)
    pairs = _near(q, ref, mismatches, core)
    found = q.withColumnRenamed("cdr3", "_q").join(pairs, ["v_call", "j_call", "_q"]).select("query_id", "v_call", "j_call", F.col("_r").alias("cdr3"))
    return found.join(ref, ["v_call", "j_call", "cdr3"]).select("query_id", *ref.columns)


def write(query: DataFrame, ref: DataFrame, path: str, columns: list[str], mismatches: float = 1, core: Core | None = None, min_count: int = 0, key: str = "row_id", chunk: int = CHUNK, share: int = SHARE, repeats: int = REPEATS) -> None:
    """Text in the folder path: for every query with matches a line that names it, and columns of its matches in the
    order of their first; an empty line between queries.

    Queries of one V, J and CDR3, a class, have the same matches. Their lines are sorted and joined once a class, in rows
    of so many lines (chunk), and repeated for its queries while they are written. A class of more lines than share goes
    to several tasks, with as many queries as repeats or more in each, so the lines that are shuffled are fewer by that
    factor than those that are written. The queries of a class follow each other, so zstd (a window of 2 MB) stores
    once what they repeat."""
    scratch = Scratch(query.sparkSession)
    texts = ["v_call", "j_call", "cdr3"]
    q, ref = _sides(query, ref, min_count, key)
    pairs = _near(q, ref, mismatches, core).withColumnRenamed("_q", "cdr3")
    per = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*texts)).alias("t"))
    alone = per.filter("n = 1").select("query_id", "t.*")
    classes = alone.groupBy(*texts).agg(F.min("query_id").alias("class"))
    # an id of several rows is a class of its own
    shared = per.filter("n > 1").select("query_id")
    members = alone.join(classes, texts).select("class", "query_id").unionByName(shared.select(F.col("query_id").alias("class"), "query_id"))
    sources = classes.select("class", *texts).unionByName(q.join(shared, "query_id").select(F.col("query_id").alias("class"), *texts))

    line = F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns))
    rows = sources.join(pairs, texts).select("class", "v_call", "j_call", F.col("_r").alias("cdr3")).join(ref, texts)
    rows = rows.select("class", F.col(f"`{columns[0]}`").alias("k"), line.alias("line")).orderBy("class", "k", "line")
    rows = rows.withColumn("at", F.expr(f"monotonically_increasing_id() div {chunk}"))
    rows = rows.groupBy("class", "at").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("lines"))
    lists = scratch.put("lists", rows.select("class", "at", F.size("lines").alias("n"), F.array_join("lines.line", "\n").alias("value")))

    sizes = lists.groupBy("class").agg(F.sum("n").alias("n"), F.min("at").alias("head"))
    sizes = sizes.join(members.groupBy("class").agg(F.count(F.lit(1)).alias("m")), "class")
    sizes = scratch.put("sizes", sizes.select("class", "head", (F.col("n") * F.col("m")).alias("all"), F.ceil(F.col("n") * F.col("m") / F.greatest(F.lit(share), F.col("n") * repeats)).alias("parts")))
    members = members.join(sizes.select("class", "parts"), "class").select("class", F.pmod(F.xxhash64("query_id"), "parts").alias("part"), "query_id")
    lists = lists.join(sizes, "class").select("class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "at", (F.col("at") == F.col("head")).alias("head"), "value")
    tasks = max(1, -(-(sizes.agg(F.sum("all")).first()[0] or 0) // share))
    task = F.pmod(F.hash("class", "part"), F.lit(tasks))
    first = members.agg(F.min(F.struct(task, "class", "part", "query_id"))["query_id"]).first()[0]  # the query that the files begin with

    # A merge join keeps the order of both sides; the filter, true for all rows but not deterministic, keeps the optimizer from dropping their sorts.
    put = lambda df, last: df.repartition(tasks, "class", "part").sortWithinPartitions("class", "part", last).filter(F.monotonically_increasing_id() >= 0)
    top = F.concat(F.when(F.col("query_id") == F.lit(first), "").otherwise("\n"), F.lit("# Query: "), F.col("query_id").cast("string"), F.lit("\n"))
    out = put(members, "query_id").join(put(lists, "at").hint("merge"), ["class", "part"])
    tables.write_text(out.select(F.concat(F.when(F.col("head"), top).otherwise(""), "value").alias("value")), path, tables.ZSTD)
    scratch.drop()


def counts(query: DataFrame, found: DataFrame, key: str = "row_id") -> DataFrame:
    """(query_id, size), zeros kept; queries without V are left out."""
    q = query.filter("coalesce(v_call, '') <> ''").select(F.col(key).alias("query_id"))
    n = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    return q.join(n, "query_id", "left").select("query_id", F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def summary(query: DataFrame, found: DataFrame, key: str = "row_id") -> DataFrame:
    """counts, and the mean of each mutation rate over the matches, two digits; 0 without any."""
    rates = [c for c in RATES if c in found.columns]
    mean = found.groupBy("query_id").agg(*(F.bround(F.avg(c), 2).alias(f"avg_{c}") for c in rates))
    return counts(query, found, key).join(mean, "query_id", "left").na.fill(0.0, [f"avg_{c}" for c in rates])
