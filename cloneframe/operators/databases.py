"""Gene databases: renaming, comparison, union, sanitizing. Databases are small tables (name, sequence, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneframe.functions import names, sequence
from cloneframe.operators.components import components
from cloneframe.operators.small import bounded


def sanitize(records: DataFrame) -> DataFrame:
    """Allele names from headers with bars, sequences without dots; empty ones go."""
    return records.withColumns({"name": names.allele_of_header(F.col("name")), "sequence": sequence.sanitize_gapped(F.col("sequence"))}).filter("sequence <> ''")


def rename(found: DataFrame, database: DataFrame) -> DataFrame:
    """found with name: the gene of the nearest database sequence (the first of equals) and a number by distance."""
    genes = database.agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("p"), F.col("name").alias("d"), F.col("sequence").alias("t")))).alias("_g"))  # one row
    bounded(database, "gene database")
    # every found sequence goes through the list of genes in its own row
    dist = F.transform("_g", lambda g: F.struct(F.levenshtein(F.col("sequence"), g["t"]).alias("dist"), g["p"].alias("p"), g["d"].alias("d")))
    near = found.select("ord", "sequence").join(F.broadcast(genes)).select("ord", F.array_min(dist).alias("m")).filter("m is not null")
    near = near.select("ord", names.gene_of(F.col("m.d")).alias("gene"), F.col("m.dist").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("gene").orderBy("distance", "ord"))
    named = found.join(near, "ord").withColumn("_n", rank)
    return named.withColumn("new_name", F.concat("gene", F.lit("*"), F.format_string("%02d", "_n"))).drop("_n")


def pair_identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """(category, a_name, b_name, sequence): identical (one to one; the last of b's equals stands for them), only_a, only_b."""
    newest, first = Window.partitionBy("sequence").orderBy(F.desc("ord")), Window.partitionBy("sequence").orderBy("ord")
    y = b.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select(F.col("sequence").alias("_y"), F.col("name").alias("b_name"), F.col("ord").alias("b_ord"))
    x = a.withColumn("_n", F.row_number().over(first)).select(F.col("sequence").alias("_x"), F.col("name").alias("a_name"), F.col("ord").alias("a_ord"), "_n")
    both = x.join(y, (F.col("_x") == F.col("_y")) & (F.col("_n") == 1), "full_outer")
    kind = F.when(F.col("a_name").isNull(), "only_b").when(F.col("b_name").isNull(), "only_a").otherwise("identical")
    return both.select(kind.alias("category"), "a_name", "b_name", F.coalesce("_x", "_y").alias("sequence"), "a_ord", "b_ord")


def cost(a: Column, b: Column) -> Column:
    """Five times the lesser number of mismatches, aligned at either end, and the difference of lengths."""
    n = F.least(F.length(a), F.length(b))
    ends = F.least(sequence.hamming(F.left(a, n), F.left(b, n)), sequence.hamming(F.right(a, n), F.right(b, n)))
    return 5 * ends + F.greatest(F.length(a), F.length(b)) - n


def similar_costs(rest_a: DataFrame, rest_b: DataFrame, most: int = 20) -> DataFrame:
    """(a_ord, b_ord, a_name, b_name, cost) of pairs up to `most`."""
    x = rest_a.select(F.col("ord").alias("a_ord"), F.col("name").alias("a_name"), F.col("sequence").alias("_a"))
    y = rest_b.select(F.col("ord").alias("b_ord"), F.col("name").alias("b_name"), F.col("sequence").alias("_b"))
    return x.join(y, F.abs(F.length("_a") - F.length("_b")) <= most).withColumn("cost", cost(F.col("_a"), F.col("_b"))).filter(F.col("cost") <= most).drop("_a", "_b")


def compare(a: DataFrame, b: DataFrame, most: int = 20) -> dict[str, list]:
    """identical, renamed, similar, only_a, only_b; names, in file order. Similar ones pair greedily by cost, and also
    have their edits."""
    first = pair_identical(a, b)
    rest_a = first.filter("category = 'only_a'").select(F.col("a_ord").alias("ord"), F.col("a_name").alias("name"), "sequence")
    rest_b = first.filter("category = 'only_b'").select(F.col("b_ord").alias("ord"), F.col("b_name").alias("name"), "sequence")
    bounded(a, "first database")
    bounded(b, "second database")
    used_a, used_b, similar = set(), set(), []
    text = {("a", r.ord): r.sequence for r in rest_a.collect()} | {("b", r.ord): r.sequence for r in rest_b.collect()}
    for r in similar_costs(rest_a, rest_b, most).orderBy("cost", "a_ord", "b_ord").collect():  # two gene databases
        if r.a_ord not in used_a and r.b_ord not in used_b:
            used_a.add(r.a_ord)
            used_b.add(r.b_ord)
            similar.append((r.a_name, r.b_name, show_edits(text["a", r.a_ord], text["b", r.b_ord])))
    same = [(r.a_name, r.b_name) for r in first.filter("category = 'identical'").orderBy("a_ord").collect()]
    return {
        "identical": same,
        "renamed": [p for p in same if p[0] != p[1]],
        "similar": similar,
        "only_a": [r.name for r in rest_a.orderBy("ord").collect() if r.ord not in used_a],
        "only_b": [r.name for r in rest_b.orderBy("ord").collect() if r.ord not in used_b],
    }


def show_edits(a: str, b: str) -> str:
    """The common length of two sequences, aligned at the end with fewer mismatches, mismatches as {a → b}."""
    n = min(len(a), len(b))
    pairs = [list(zip(x, y, strict=True)) for x, y in ((a[:n], b[:n]), (a[len(a) - n :], b[len(b) - n :]))]
    best = min(pairs, key=lambda p: sum(x != y for x, y in p))
    return "".join(x if x == y else f"{{{x} → {y}}}" for x, y in best)


def exit_code(diff: dict[str, list]) -> int:
    return int(any(diff[k] for k in ("similar", "only_a", "only_b")))


# The wording of the report, which other programs read.
def report(diff: dict[str, list]) -> str:
    n = {k: len(v) for k, v in diff.items()}
    a, b = (n["identical"] + n[k] + n["similar"] for k in ("only_a", "only_b"))
    out = [f"{a} vs {b} records. {n['only_a']} lost, {n['only_b']} gained, {n['identical'] - n['renamed']} identical, {n['renamed']} different name, {n['similar']} similar"]
    for title, mark, key in (("Only in A", "-", "only_a"), ("Only in B", "+", "only_b"), ("Different name (sequence identical)", "=", "renamed"), ("Similar", "~", "similar")):
        if diff[key]:
            out += ["", f"## {title}"]
            for x in diff[key]:
                out.append(f"{mark} {x if isinstance(x, str) else ' -- '.join(x[:2])}")
                out += [*x[2:], ""] if key == "similar" else []
    return "\n".join(out) + "\n"


def duplicates(records: DataFrame) -> DataFrame:
    """(kind, name, other): repeated names, and repeated sequences with the first name that has them."""
    again = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    by_name = records.withColumn("_n", again).filter("_n = 2").select(F.lit("name").alias("kind"), "name", F.lit(None).cast("string").alias("other"))
    w = Window.partitionBy("sequence").orderBy("ord")
    by_seq = records.withColumns({"_n": F.row_number().over(w), "other": F.first("name").over(w)}).filter("_n > 1").select(F.lit("sequence").alias("kind"), "name", "other")
    return by_name.unionByName(by_seq)


def prefix_pairs(records: DataFrame) -> DataFrame:
    """(short, long) ord of records of which one's sequence begins the other's; of equal ones, the earlier is short.
    Each record meets the records of every length up to its own by its prefix of that length."""
    lengths = records.agg(F.collect_set(F.length("sequence")).alias("_ls"))  # one row: lengths that occur
    cut = records.join(F.broadcast(lengths)).select("ord", "sequence", F.explode(F.filter("_ls", lambda n: n <= F.length("sequence"))).alias("_n"))
    cut = cut.select(F.col("ord").alias("long"), F.length("sequence").alias("_m"), F.left("sequence", F.col("_n")).alias("_p"))
    short = records.select(F.col("ord").alias("short"), F.col("sequence").alias("_p"))
    pairs = short.join(cut, "_p").filter((F.col("short") != F.col("long")) & ((F.length("_p") < F.col("_m")) | (F.col("short") < F.col("long"))))
    return pairs.select("short", "long")


def merge_prefixes(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Ordered union of (name, sequence): a sequence that begins a kept one, or is begun by it, joins it, and the longer
    stays; with several such, all become one under the last one's name. In the order of names."""
    kept: list[tuple[str, str]] = []
    for name, s in rows:
        hits = [i for i, (_, t) in enumerate(kept) if t.startswith(s) or s.startswith(t)]
        if not hits:
            kept.append((name, s))
            continue
        longest = max([s, *(kept[i][1] for i in hits)], key=len)
        label = kept[hits[-1]][0]
        kept = [k for i, k in enumerate(kept) if i not in hits]
        kept.append((label, longest))
    return sorted(kept)


def union(records: DataFrame) -> DataFrame:
    """Ordered union of many databases' records (name, sequence, ord). Records that no chain of prefixes links are
    independent, so each chain is folded by itself, in order."""
    linked = components(prefix_pairs(records).select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")))
    grouped = records.select("name", "sequence", "ord").join(linked.withColumnRenamed("node", "ord"), "ord", "left").withColumn("block", F.coalesce("component", "ord")).drop("component")

    def fold(pdf):
        pdf = pdf.sort_values("ord")
        return type(pdf)(merge_prefixes(list(zip(pdf["name"], pdf["sequence"], strict=True))), columns=["name", "sequence"])

    return grouped.groupBy("block").applyInPandas(fold, "name string, sequence string").orderBy("name", "sequence")
