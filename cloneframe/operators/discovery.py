"""Discovery of V and J alleles from assignments.

Counts, exact matches and group statistics are joins and aggregations over all rows. Only consensus sequences come
from a group function, which gets a bounded sample of each window: the rows with the smallest hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
import pandas as pd

from cloneframe.functions import kernels, sequence
from cloneframe.functions.names import gene_of
from cloneframe.operators.clonotypes import count_by_edits
from cloneframe.operators.elimination import SALTS, fallen
from cloneframe.operators.small import small
from cloneframe.plans.scratch import keep

# Fixed values of the method.
MIN_GROUP, MIN_EXPRESSED, MOST_SAMPLED = 5, 10, 1600
EDITS, D_EVALUE, MAX_N = 6, 1e-4, 0
J_LEAST, J_SUFFIX = 3, 4
WINDOWS = [*((float(s), float(s + 2), f"{s}-{s + 2}") for s in range(0, 20, 2)), (0.0, 100.0, "all")]


def windows(df: DataFrame) -> DataFrame:
    """df's rows once per window of V_SHM that holds them, with its label. A row is in two windows or one."""
    made = F.array(*(F.when((F.col("V_SHM") >= lo) & (F.col("V_SHM") < hi), F.lit(label)) for lo, hi, label in WINDOWS))
    return df.withColumn("window", F.explode(F.array_compact(made)))


def sibling_sizes(df: DataFrame) -> DataFrame:
    """(v_call, window, n) of windows with enough rows."""
    return windows(df).groupBy("v_call", "window").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_GROUP)


def sampled(df: DataFrame, by: list[str], size: int, seed: int = 1, key: str = "row_id") -> DataFrame:
    """The `size` rows of each group with the smallest hashes, in that order as _rank: a fixed sample."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size)


def siblings(df: DataFrame, database: DataFrame, threshold: float = 0.6, seed: int = 1, program: str = "builtin") -> DataFrame:
    """(v_call, label, consensus): of each window with enough rows. A consensus that begins its database sequence, or
    is begun by it, is that sequence."""
    rows = windows(df).join(sibling_sizes(df).select("v_call", "window"), ["v_call", "window"], "left_semi")
    rows = sampled(rows.filter("coalesce(V_nt, '') <> ''"), ["v_call", "window"], MOST_SAMPLED, seed).select("v_call", "window", "V_nt", "_rank")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("_rank")["V_nt"].tolist()
        made = kernels.iterative_consensus(s, threshold, kernels.aligner(program), MOST_SAMPLED)
        return pd.DataFrame({"v_call": [pdf["v_call"].iloc[0]], "label": [pdf["window"].iloc[0]], "consensus": [made]})

    found = rows.groupBy("v_call", "window").applyInPandas(fold, "v_call string, label string, consensus string")
    db = small(database.select(F.col("name").alias("v_call"), F.col("sequence").alias("_db")), "gene database")
    near = F.startswith("_db", "consensus") | F.startswith("consensus", "_db")
    return found.join(db, "v_call", "left").select("v_call", "label", F.when((F.col("consensus") != "") & near, F.col("_db")).otherwise(F.col("consensus")).alias("consensus"))


def cluster_siblings(df: DataFrame, subsample: int = 1000, threshold: float = 0.6, seed: int = 1, program: str = "builtin") -> DataFrame:
    """(v_call, label, consensus, members): of each cluster cl1, cl2 .. of a sample of `subsample` rows of a gene, by the
    V's part before the CDR3 (_cut); members: row_id of the cluster's rows."""
    some = sampled(df.filter("coalesce(V_nt, '') <> ''"), ["v_call"], subsample, seed).select("v_call", "row_id", "V_nt", "_cut", "_rank")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        ids = kernels.cut_by_ratio(kernels.distances(pdf["_cut"].tolist()), MIN_GROUP, strict=False)
        out = []
        for n, c in enumerate(sorted(set(ids) - {0}), 1):
            part = pdf[[i == c for i in ids]]
            out.append((pdf["v_call"].iloc[0], f"cl{n}", kernels.iterative_consensus(part["V_nt"].tolist(), threshold, kernels.aligner(program), MOST_SAMPLED), part["row_id"].tolist()))
        return pd.DataFrame(out, columns=["v_call", "label", "consensus", "members"])

    return keep(some.groupBy("v_call").applyInPandas(fold, "v_call string, label string, consensus string, members array<long>"))


def readded(df: DataFrame, found: DataFrame, database: DataFrame) -> DataFrame:
    """(v_call, label db, consensus) of database sequences with enough error-free rows that no sibling gives."""
    exact = df.groupBy("v_call").agg(F.count_if(F.col("V_errors") == 0).alias("n"), F.count(F.lit(1)).alias("all")).filter((F.col("n") >= MIN_EXPRESSED) & (F.col("all") >= MIN_GROUP))
    db = database.select(F.col("name").alias("v_call"), F.col("sequence").alias("consensus"))
    return exact.join(db, "v_call").join(found, ["v_call", "consensus"], "left_anti").select("v_call", F.lit("db").alias("label"), "consensus")


def group_stats(rows: DataFrame, by: list[str], cdr3s_left: DataFrame, d_coverage: float = 70.0, edits: int = EDITS) -> DataFrame:
    """Per group: rows, unique_J, unique_CDR3, unique_D (trusted ones), unique_barcodes, shared_CDR3_ratio, clonotypes.
    cdr3s_left: (by.., cdr3, left), how often a CDR3 remains in all rows besides the group's sibling."""
    have = set(rows.columns)
    trusted = (F.coalesce("D_errors", F.lit(-1)) == 0 if "D_errors" in have else F.lit(True)) & (F.coalesce("D_covered", F.lit(0.0)) >= d_coverage if "D_covered" in have else F.lit(True))
    if "d_support" in have:
        trusted = trusted & (F.coalesce("d_support", F.lit(float("inf"))) <= D_EVALUE)
    full = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    barcode = F.count_distinct(full("barcode")) if "barcode" in have else F.lit(0).cast("long")
    d = F.count_distinct(F.when(trusted, full("d_call"))) if "d_call" in have else F.lit(0).cast("long")
    base = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(full("j_call")).alias("unique_J"), F.count_distinct(full("cdr3")).alias("unique_CDR3"), d.alias("unique_D"), barcode.alias("unique_barcodes"))
    own = rows.filter("coalesce(cdr3, '') <> ''").select(*by, "cdr3").distinct()
    shared = own.join(cdr3s_left.filter(F.col("left") > 0), [*by, "cdr3"], "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("_s"))
    n = count_by_edits(rows, by, edits)
    out = base.join(shared, by, "left").join(n, by, "left")
    return out.withColumn("shared_CDR3_ratio", sequence.safe_divide(F.coalesce("_s", F.lit(0)), F.col("unique_CDR3"))).withColumn("clonotypes", F.coalesce("clonotypes", F.lit(0).cast("long"))).drop("_s")


def discover_v(df: DataFrame, database: DataFrame, ignore_j: bool = False, d_coverage: float = 70.0, threshold: float = 0.6, seed: int = 1, program: str = "builtin", subsample: int = 1000, strict: bool = True) -> DataFrame:
    """Candidates, one row per sibling, with the statistics that the germline filter reads. df needs row_id.
    strict: no siblings of clusters, as kernels.cut_by_ratio says."""
    if not ignore_j and "J_SHM" in df.columns:
        df = df.filter(F.coalesce("J_SHM", F.lit(0.0)) == 0)
    big = df.groupBy("v_call").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_GROUP)
    df = df.filter("coalesce(v_call, '') <> ''").join(big.select("v_call"), "v_call", "left_semi")
    starts = df.filter("V_CDR3_start > 0").groupBy("v_call").agg(F.mode("V_CDR3_start", True).alias("_start"))
    cut = lambda c: F.when(F.col("_start").between(1, F.length(c)), F.left(c, F.col("_start").cast("int"))).otherwise(F.col(c))
    df = df.join(starts, "v_call", "left").na.fill(0, ["_start"]).withColumn("_cut", cut("V_nt"))
    found = siblings(df, database, threshold, seed, program)
    clusters = None
    if not strict:
        clusters = cluster_siblings(df, subsample, threshold, seed, program)
        same = F.startswith("_db", "consensus") | F.startswith("consensus", "_db")
        db = small(database.select(F.col("name").alias("v_call"), F.col("sequence").alias("_db")), "gene database")
        own = clusters.filter("consensus <> ''").join(db, "v_call", "left")
        found = found.unionByName(own.select("v_call", "label", F.when(same, F.col("_db")).otherwise(F.col("consensus")).alias("consensus")))
    found = found.unionByName(readded(df, found, database)).filter("consensus <> ''")
    found = found.filter(F.length("consensus") - F.length(F.replace("consensus", F.lit("N"), F.lit(""))) <= MAX_N)
    found = keep(found.join(df.select("v_call", "_start").distinct(), "v_call").withColumn("_cut", cut("consensus")))  # read by every join below
    by = ["v_call", "label"]
    in_windows = windows(df).withColumnRenamed("window", "label").join(found.select(*by), by, "left_semi")
    of_db = df.filter("V_errors = 0").withColumn("label", F.lit("db")).join(found.filter("label = 'db'").select(*by), by, "left_semi")
    sibling_rows = in_windows.unionByName(of_db.select(*in_windows.columns))
    if clusters is not None:
        of_cluster = df.join(clusters.select("v_call", "label", F.explode("members").alias("row_id")), ["v_call", "row_id"]).join(found.select(*by), by, "left_semi")
        sibling_rows = sibling_rows.unionByName(of_cluster.select(*in_windows.columns))
    exact_rows = df.join(found.select(*by, "_cut"), ["v_call", "_cut"])
    full_exact = df.join(found.select(*by, F.col("consensus").alias("V_nt")), ["v_call", "V_nt"]).groupBy(*by).agg(F.count(F.lit(1)).alias("full_exact"))
    everywhere = df.filter("coalesce(cdr3, '') <> ''").groupBy("cdr3").agg(F.count(F.lit(1)).alias("_all"))
    own = sibling_rows.filter("coalesce(cdr3, '') <> ''").groupBy(*by, "cdr3").agg(F.count(F.lit(1)).alias("_own"))
    asked = sibling_rows.select(*by, "cdr3").unionByName(exact_rows.select(*by, "cdr3")).distinct()
    left = asked.join(everywhere, "cdr3").join(own, [*by, "cdr3"], "left").select(*by, "cdr3", (F.col("_all") - F.coalesce("_own", F.lit(0))).alias("left"))
    w = group_stats(sibling_rows, by, left, d_coverage).select(*by, F.col("rows").alias("cluster_size"), F.col("unique_J").alias("Js"), F.col("unique_CDR3").alias("CDR3s"))
    e = group_stats(exact_rows, by, left, d_coverage).select(*by, F.col("rows").alias("exact"), F.col("unique_barcodes").alias("barcodes_exact"), F.col("unique_D").alias("Ds_exact"), F.col("unique_J").alias("Js_exact"), F.col("unique_CDR3").alias("CDR3s_exact"), "clonotypes", F.col("shared_CDR3_ratio").alias("CDR3_shared_ratio"))
    chain = sibling_rows.groupBy(*by).agg(F.mode("locus", True).alias("chain")) if "locus" in df.columns else found.select(*by, F.lit("").alias("chain"))
    out = found.join(w, by).join(e, by, "left").join(full_exact, by, "left").join(chain, by, "left")
    out = out.na.fill(0, ["exact", "barcodes_exact", "Ds_exact", "Js_exact", "CDR3s_exact", "clonotypes", "full_exact", "CDR3_shared_ratio"])
    db = small(database.select(F.col("name").alias("v_call"), F.col("sequence").alias("_db")), "gene database")
    change = F.pandas_udf(lambda a, b: pd.Series([kernels.describe_change(x, y) if x and y and x != y else "" for x, y in zip(a, b, strict=True)]), "string")
    out = out.join(db, "v_call", "left").withColumn("database_diff", F.coalesce(F.levenshtein("_db", "consensus"), F.lit(-1)))
    out = out.filter((F.col("database_diff") <= 0) | (F.col("exact") >= 2))
    out = out.withColumn("database_changes", change(F.coalesce("_db", F.lit("")), "consensus")).withColumn("CDR3_exact_ratio", sequence.fixed(sequence.safe_divide(F.col("exact"), F.col("CDR3s_exact")), 2)).withColumn("CDR3_shared_ratio", sequence.fixed(F.col("CDR3_shared_ratio"), 2))
    out = out.withColumn("has_stop", sequence.has_stop(F.col("consensus")).cast("int")).withColumn("N_bases", F.lit(0))
    out = out.withColumn("name", F.when(F.col("database_diff") == 0, F.col("v_call")).otherwise(sequence.unique_name(F.col("v_call"), F.col("consensus"))))
    labels = F.create_map(*(F.lit(v) for i, (_, _, n) in enumerate([*WINDOWS, (0, 0, "db")]) for v in (n, i)))
    out = out.withColumn("idx", F.row_number().over(Window.orderBy("v_call", F.coalesce(labels[F.col("label")], F.regexp_extract("label", "([0-9]+)$", 1).cast("int") + 100))).cast("long"))  # candidates of one locus
    out = unique_names(out)
    return out.select("idx", "name", F.col("v_call").alias("source"), "chain", F.col("label").alias("cluster"), "cluster_size", "Js", "CDR3s", "exact", "full_exact", "barcodes_exact", "Ds_exact", "Js_exact", "CDR3s_exact", "clonotypes", "CDR3_exact_ratio", "CDR3_shared_ratio", "N_bases", "database_diff", "database_changes", "has_stop", F.col("_start").alias("CDR3_start"), "consensus")


def unique_names(df: DataFrame, order: str = "idx") -> DataFrame:
    """The second, third .. row of a name get A, B .. after it; more than 26 are an error."""
    n = F.row_number().over(Window.partitionBy("name").orderBy(order))
    letter = F.when(F.col("_n") > 27, F.raise_error(F.lit("too many candidates of one name"))).when(F.col("_n") > 1, F.char(63 + F.col("_n"))).otherwise("")
    return df.withColumn("_n", n).withColumn("name", F.concat("name", letter)).drop("_n")


def discover_j(df: DataFrame, database: DataFrame, threshold: float = 0.6, allele_ratio: float = 0.2, cross_ratio: float = 0.1, seed: int = 1, program: str = "builtin", most: int = 1000) -> DataFrame:
    """(name, source, exact, CDR3s_exact, consensus) of J alleles, from rows without an error: their J
    sequence is J_nt or, without that column, j_sequence_alignment without gaps. A consensus is of `most` rows at most."""
    if "J_nt" not in df.columns:
        df = df.withColumn("J_nt", F.replace(F.coalesce("j_sequence_alignment", F.lit("")), F.lit("-"), F.lit("")))
    exact = df.filter("coalesce(j_call, '') <> '' and J_errors = 0")
    rows = exact.filter("coalesce(J_nt, '') <> ''")
    stats = exact.groupBy("j_call").agg(F.count(F.lit(1)).alias("exact"), F.count_distinct(F.when(F.col("cdr3") != "", F.col("cdr3"))).alias("CDR3s_exact")).filter(F.col("exact") >= J_LEAST)
    some = sampled(rows.join(stats.select("j_call"), "j_call", "left_semi"), ["j_call"], most, seed)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        made = kernels.iterative_consensus(pdf.sort_values("_rank")["J_nt"].tolist(), threshold, kernels.aligner(program), most)
        return pd.DataFrame({"j_call": [pdf["j_call"].iloc[0]], "consensus": [made]})

    made = some.select("j_call", "J_nt", "_rank").groupBy("j_call").applyInPandas(fold, "j_call string, consensus string")
    found = stats.join(made, "j_call").filter("consensus <> ''")
    db = small(database.select(F.col("name").alias("j_call"), F.col("sequence").alias("_db")), "gene database")
    found = found.join(db, "j_call", "left")
    same = F.startswith("_db", "consensus") | F.startswith("consensus", "_db")
    found = found.withColumn("name", F.when(same, F.col("j_call")).otherwise(sequence.unique_name(F.col("j_call"), F.col("consensus"))))
    found = unique_names(found.select("*", F.struct("j_call").alias("_by")), "_by")
    kept = j_allele_ratio(found.select("name", F.col("j_call").alias("source"), "exact", "CDR3s_exact", "consensus"), allele_ratio)
    return j_cross_mapping(kept, cross_ratio)


def j_allele_ratio(found: DataFrame, least: float = 0.2) -> DataFrame:
    best = F.max("exact").over(Window.partitionBy(gene_of(F.col("source"))))
    return found.withColumn("_b", best).filter((F.col("_b") == 0) | (F.col("exact") / F.col("_b") >= least)).drop("_b")


def _near_ends(rows: DataFrame) -> DataFrame:
    """(_end, _other) of distinct last bases of one length that differ in one place at most: they agree with one place
    left out."""
    ends = rows.select("_end").filter("_end is not null").distinct()
    n = F.length("_end")
    without = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("at"), F.concat(F.left("_end", i - 1), F.lit("."), F.substring(F.col("_end"), i + 1, n)).alias("left")))
    made = ends.select("_end", n.alias("_n"), F.explode(without).alias("w")).select("_end", "_n", "w.at", "w.left")
    return made.join(made.withColumnRenamed("_end", "_other"), ["_n", "at", "left"]).select("_end", "_other").distinct()


def j_cross_pairs(found: DataFrame, ratio: float = 0.1) -> DataFrame:
    """(ref, cand) names of alleles whose last bases differ in one place at most, cand's share being below ratio. They
    meet by equal keys, the refs of one key dealt over SALTS tasks."""
    rows = found.select("name", "exact", F.right("consensus", F.lit(J_SUFFIX)).alias("_end"))
    r = rows.withColumn("_salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")).alias("r")
    x = rows.withColumnRenamed("_end", "_other").join(_near_ends(rows), "_other").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("x")
    first = F.struct(-F.col("r.exact"), F.col("r.name")) < F.struct(-F.col("x.exact"), F.col("x.name"))
    share = F.try_divide(F.col("x.exact").cast("double"), (F.col("r.exact") + F.col("x.exact")).cast("double"))
    same = (F.col("r._end") == F.col("x._end")) & (F.col("r._salt") == F.col("x._salt"))
    return x.join(r, same & first & (share < ratio)).select(F.col("r.name").alias("ref"), F.col("x.name").alias("cand"), F.col("r.exact").alias("ref_exact"))


def j_cross_mapping(found: DataFrame, ratio: float = 0.1) -> DataFrame:
    """found without alleles that a more frequent, standing one explains; pairs are walked from the most frequent on.
    Names are unique."""
    found = keep(found)
    place = found.select("name", F.struct((-F.col("exact")).alias("k"), "name").alias("_p"))
    a, b = (place.select(F.col("name").alias(n), F.col("_p").alias(p)) for n, p in (("ref", "a"), ("cand", "b")))
    links = j_cross_pairs(found, ratio).join(a, "ref").join(b, "cand").select("a", "b")
    return found.join(fallen(links).select(F.col("node.name").alias("name")), "name", "left_anti").select(*found.columns)
