"""Filtering of germline candidates: rules per entry, rules for pairs, and ordered elimination.

Rules are SQL expressions. Pair reasons do not depend on the order, so they are found by joins; the last step, in which
a candidate that has been eliminated eliminates no other, goes in rounds over the links between references.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneframe.functions.names import gene_of
from cloneframe.functions.sequence import fixed
from cloneframe.operators.elimination import SALTS, fallen, tasks
from cloneframe.plans.scratch import keep
from cloneframe.sources.config import GermlineCriteria

FAR = 10_000


def annotate(candidates: DataFrame, c: GermlineCriteria, whitelist: DataFrame | None = None) -> DataFrame:
    """candidates with whitelist_diff (0 or -1), and is_filtered and why_filtered of the rules per entry."""
    if whitelist is None:
        df = candidates.withColumn("whitelist_diff", F.lit(-1))
    else:
        known = whitelist.select(F.col("sequence").alias("consensus")).distinct().withColumn("_w", F.lit(0))
        df = candidates.join(known, "consensus", "left").withColumn("whitelist_diff", F.coalesce("_w", F.lit(-1))).drop("_w")
    strange = F.col("whitelist_diff") != 0
    rules = [("too_low_CDR3s_exact", F.col("CDR3s_exact") < c.unique_cdr3s), ("too_low_Js_exact", F.col("Js_exact") < c.unique_js)]
    if "CDR3_shared_ratio" in candidates.columns:
        rules.append(("too_high_CDR3_shared_ratio", F.col("CDR3_shared_ratio").cast("double") > c.cdr3_shared_ratio))
    if not c.allow_stop:
        rules.append(("has_stop", (F.col("has_stop") != 0) & strange))
    rules.append(("too_low_cluster_size", (F.col("cluster_size") < c.cluster_size) & strange))
    why = F.concat(*(F.when(rule, f"{name};").otherwise("") for name, rule in rules))
    n = sum((F.when(rule, 1).otherwise(0) for _, rule in rules), F.lit(0))
    return df.withColumn("is_filtered", n).withColumn("why_filtered", why)


def pair_rules(c: GermlineCriteria, same: Column) -> list[tuple[Column, str, Column | None, int]]:
    """(condition, label, value, its decimals) of the rules by which r (reference) discards x (candidate), in order;
    same: whether they are of one gene. A rule without a value is that of equal or shortened sequences."""
    r, x = (lambda n: F.col(f"r.{n}")), (lambda n: F.col(f"x.{n}"))
    ratio = lambda col: F.try_divide(x(col).cast("double"), r(col).cast("double"))
    out = [(~x("whitelisted") & (r("cluster_size") >= x("cluster_size")) & F.startswith(r("consensus"), x("consensus")), "identical_to", None, 0)]
    if c.cross_mapping_ratio > 0:
        a, b = r("_cut"), x("_cut")
        n = F.least(F.length(a), F.length(b))
        near = (F.levenshtein(F.left(a, n), F.left(b, n), 1) >= 0) | (F.levenshtein(F.right(a, n), F.right(b, n), 1) >= 0)
        share = F.try_divide(x("cluster_size").cast("double"), (r("cluster_size") + x("cluster_size")).cast("double"))
        out.append((r("is_database") & x("is_database") & x("accurate") & (share < c.cross_mapping_ratio) & near, "xmap_ratio", share, 4))
    for value, column, label, digits in ((c.clonotype_ratio, "clonotypes", "clonotype_ratio", 4), (c.exact_ratio, "exact", "ex_occ_ratio", 1)):
        if value > 0:
            out.append((same & (r(column) > 0) & (ratio(column) < value), label, ratio(column), digits))
    if c.unique_d_ratio > 0:
        enough = (x("cluster_size") <= r("cluster_size")) & (r("Ds_exact") >= c.unique_d_threshold)
        out.append((same & enough & (ratio("Ds_exact") < c.unique_d_ratio), "Ds_exact_ratio", ratio("Ds_exact"), 1))
    return out


def _reasons(pairs: DataFrame, rules: list, order: str) -> DataFrame:
    """(ref, cand, reason) of joined pairs for which one of the rules holds. Text is made in a step of its own, from one
    value: code of all rules' texts would be too long to be compiled."""
    which = F.coalesce(*(F.when(rule[0], i) for i, rule in enumerate(rules)))
    made = pairs.select(F.col(f"r.{order}").alias("ref"), F.col(f"x.{order}").alias("cand"), F.col("r.name").alias("_name"), (F.col("r.consensus") == F.col("x.consensus")).alias("_equal"), which.alias("_which"), *(rule[2].alias(f"_v{i}") for i, rule in enumerate(rules) if rule[2] is not None))
    of = lambda f: F.coalesce(*(F.when(F.col("_which") == i, f(i, rule)) for i, rule in enumerate(rules)))
    made = made.select("ref", "cand", "_name", "_equal", of(lambda i, rule: F.lit(f"{rule[1]}=")).alias("_label"), of(lambda i, rule: F.lit(rule[3])).alias("_digits"), of(lambda i, rule: F.lit(-1.0) if rule[2] is None else F.col(f"_v{i}")).alias("_value"))
    number = F.when(F.col("_digits") == 4, fixed(F.col("_value"), 4)).otherwise(fixed(F.col("_value"), 1))
    text = F.when(F.col("_digits") == 0, F.concat("_label", "_name", F.when(F.col("_equal"), "").otherwise(",truncated"))).otherwise(F.concat("_label", number, F.lit(",other="), "_name"))
    return made.select("ref", "cand", text.alias("reason"))


def snapshot(annotated: DataFrame, order: str) -> DataFrame:
    have = annotated.columns
    known = F.coalesce(F.col("database_diff") == 0, F.lit(False)) if "database_diff" in have else F.lit(False)
    start = F.col("CDR3_start") if "CDR3_start" in have else F.lit(None).cast("int")
    return annotated.select(order, "consensus", "name", "clonotypes", "exact", "Ds_exact", "cluster_size", (F.col("whitelist_diff") == 0).alias("whitelisted"), known.alias("is_database"), (F.contains("cluster", F.lit("all")) | F.contains("cluster", F.lit("db"))).alias("accurate"), start.alias("CDR3_start"))


def _near_kinds(s: DataFrame, c: GermlineCriteria) -> DataFrame:
    """(ra, rb, xa, xb): consensus and cut of references and candidates that the rules for any two genes can hold for.
    A consensus begins another as its prefix of that length. Cuts that differ in one place at most over the common
    length (of one length, one edit is one substitution) agree in one of its halves."""
    kinds = keep(s.filter("consensus is not null").select("consensus", "_cut").distinct())

    def lengths(df: DataFrame, text: str) -> DataFrame:
        return df.agg(F.collect_set(F.length(text)).alias("_ls"))  # one row: lengths that occur

    each = lambda text: F.explode(F.filter("_ls", lambda n: n <= F.length(text))).alias("_n")
    long = kinds.join(F.broadcast(lengths(kinds, "consensus"))).select(F.col("consensus").alias("ra"), F.col("_cut").alias("rb"), each("consensus"))
    short = kinds.select(F.col("consensus").alias("xa"), F.col("_cut").alias("xb"), F.col("consensus").alias("_p"))
    out = long.withColumn("_p", F.left("ra", F.col("_n"))).join(short, "_p").select("ra", "rb", "xa", "xb")
    if c.cross_mapping_ratio > 0:
        cuts = s.filter("is_database and consensus is not null").select(F.col("_cut").alias("t")).distinct()
        half = F.floor(F.col("_n") / 2).cast("int")
        halves = lambda w: F.explode(F.array(F.struct(F.lit(0).alias("h"), F.left(w, half).alias("p")), F.struct(F.lit(1).alias("h"), F.substring(F.col(w), half + 1, F.col("_n")).alias("p")))).alias("_k")
        whole = cuts.select(F.col("t").alias("t1"), F.length("t").alias("_n")).select("t1", "_n", halves("t1")).select("t1", "_n", "_k.*")
        part = cuts.join(F.broadcast(lengths(cuts, "t"))).select("t", each("t")).select("t", "_n", F.explode(F.array_distinct(F.array(F.left("t", F.col("_n")), F.right("t", F.col("_n"))))).alias("w"))
        part = part.select("t", "_n", "w", halves("w")).select(F.col("t").alias("t2"), "_n", "w", "_k.*")
        met = whole.join(part, ["_n", "h", "p"]).filter(F.levenshtein("t1", "w", 1) >= 0).select("t1", "t2").distinct()
        met = met.unionByName(met.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"))).distinct()
        r, x = (kinds.select(F.col("consensus").alias(f"{p}a"), F.col("_cut").alias(f"{p}b"), F.col("_cut").alias(t)) for p, t in (("r", "t1"), ("x", "t2")))
        out = out.unionByName(met.join(r, "t1").join(x, "t2").select("ra", "rb", "xa", "xb"))
    return out.distinct()


def pair_reasons(annotated: DataFrame, c: GermlineCriteria, order: str = "idx", refs: DataFrame | None = None, cands: DataFrame | None = None) -> DataFrame:
    """(ref, cand, reason) of ordered pairs with a reason, by the first rule that gives one; refs and cands: those of
    these ids alone. Pairs meet by their gene, or, of two genes, by what _near_kinds finds; the references of one key
    are dealt over SALTS tasks."""
    s = keep(snapshot(annotated, order).withColumn("_cut", F.left("consensus", F.coalesce("CDR3_start", F.lit(FAR)).cast("int"))))
    r = s.join(annotated.filter("is_filtered = 0").select(order), order, "left_semi")
    r = r if refs is None else r.join(refs, order, "left_semi")
    x = s if cands is None else s.join(cands, order, "left_semi")
    gene = gene_of(F.col("name"))
    r = r.withColumns({"_gene": gene, "_salt": F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int")})
    salted = lambda df: df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    at = lambda a, b: F.col(f"r.{a}") == F.col(f"x.{b}")
    apart = (F.col(f"r.{order}") != F.col(f"x.{order}")) & at("_salt", "_salt")
    n = tasks(s.count())
    rules, far_rules = pair_rules(c, F.lit(True)), pair_rules(c, F.lit(False))[: 2 if c.cross_mapping_ratio > 0 else 1]
    any_of = lambda found: reduce(lambda a, b: a | b, (rule[0] for rule in found))
    x = x.withColumn("_gene", gene)
    one = salted(x).repartition(n, "_gene", "_salt").alias("x").join(r.repartition(n, "_gene", "_salt").alias("r"), apart & at("_gene", "_gene") & any_of(rules))
    near = x.join(_near_kinds(s, c), (F.col("consensus") == F.col("xa")) & (F.col("_cut") == F.col("xb")))
    other = ~F.coalesce(at("_gene", "_gene"), F.lit(False))
    two = salted(near).repartition(n, "ra", "rb", "_salt").alias("x").join(r.repartition(n, "consensus", "_cut", "_salt").alias("r"), apart & at("consensus", "ra") & at("_cut", "rb") & other & any_of(far_rules))
    # a reason is null where the reference has no name
    return _reasons(one, rules, order).unionByName(_reasons(two, far_rules, order)).filter("reason is not null")


def eliminate(annotated: DataFrame, c: GermlineCriteria, order: str = "idx") -> DataFrame:
    """annotated with the pair reasons of references that stand when their turn comes, in the order of `order`."""
    annotated = keep(annotated)
    refs = annotated.filter("is_filtered = 0").select(order)
    # a reference falls by an earlier one alone
    links = pair_reasons(annotated, c, order, cands=refs).filter("ref < cand").select(F.col("ref").alias("a"), F.col("cand").alias("b"))
    standing = refs.join(fallen(links).withColumnRenamed("node", order), order, "left_anti")
    found = pair_reasons(annotated, c, order, refs=standing).groupBy("cand").agg(F.sort_array(F.collect_list(F.struct("ref", "reason"))).alias("l"))
    more = found.select(F.col("cand").alias(order), F.size("l").alias("_n"), F.array_join(F.transform("l", lambda x: F.concat(x["reason"], F.lit(";"))), "").alias("_why"))
    out = annotated.join(more, order, "left")
    return out.withColumn("is_filtered", F.col("is_filtered") + F.coalesce("_n", F.lit(0))).withColumn("why_filtered", F.concat("why_filtered", F.coalesce("_why", F.lit("")))).drop("_n", "_why")


def germline_filter(candidates: DataFrame, c: GermlineCriteria, whitelist: DataFrame | None = None, order: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(kept, annotated)."""
    annotated = eliminate(annotate(candidates, c, whitelist), c, order)
    return annotated.filter("is_filtered = 0").drop("is_filtered", "why_filtered"), annotated


def best_per_consensus(df: DataFrame, order: str = "idx") -> DataFrame:
    """Of rows with one consensus, that with the largest cluster, then the first name."""
    w = Window.partitionBy("consensus").orderBy(F.desc("cluster_size"), "name", order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy(order)
