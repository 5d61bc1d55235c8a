"""Near-duplicate groups by an LSH forest of MinHash signatures.

A document's set is its distinct k-word shingles (A-Z lower-cased). Equal sets fall into one class first, so a group
of copies, however large, goes on as one row. Each class gets one entry per tree: the tree's first `depth` minima as
bucket, and further minima as tail. All entries are ordered by (bucket, tail, id) with range partitioning, which
splits a hot bucket over tasks, and every entry is a candidate with its predecessors of the bucket in that order,
those with the longest common prefixes: the first `near` + 1 entries of a bucket with all of them, later ones with
the `crowd` nearest. So a bucket of up to near + 1 entries gives all its pairs at the smallest depth, and in a
crowded region the neighbours agree to a greater depth; the trees' tails differ, so each tree gives other neighbours
there. Rows at the borders of partitions meet in a second, small pass.

Depth adapts by region: buckets with more than near + 1 entries whose links, once confirmed, leave them in several
components are undecided. Their members alone go into a further forest, `depth` deeper and with as many trees as keep
the chance of a miss; there only entries of different components are candidates, up to `near` places apart, so the
candidates lie where components meet. That goes on until no bucket is undecided, or for `levels` forests; what is
undecided then is joined exactly, on prefixes of the full sets in order of rising frequency. Entries of
the deeper forests carry CODE bytes of their signature, and pairs that agree in fewer than a pair at the similarity
would, but for 5.1 standard deviations (2e-7), are no candidates.

Candidates are confirmed on full sets. First the FIRST most frequent candidates of each class are, then, of the others,
those whose ends the confirmed links have not joined yet; confirming more could not change a component. With similarity
s, a link is missed in buckets of up to near + 1 entries with probability (1 - s**depth)**trees: 2e-6 at 0.75.

Cases: a text with fewer words than k is one shingle; without words or null, n_shingles is 0, it is linked with
nothing and kept. Rows of one id count as linked. A null id takes part in its class, is never a component's name,
and is kept only where nothing else is in its class. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloneframe.llm.common import Scratch, keep
from cloneframe.llm.words import batches, mix, shingles, stream
from cloneframe.operators.components import components

TAIL = 5
FIRST = 4
HOT = 1000
CODE, DEVIATIONS = 128, 5.1


def distinct_shingles(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row, first)."""
    h, first = shingles(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[first]


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, size: int) -> DataFrame:
    """id, n_shingles, s1 and s2 (128 bits of the set), sig (size minima of 32 bits; null for an empty set)."""
    mult = stream(3, size) | np.uint64(1)
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r, e, words in batches(b.column(1), lower=True):
                h, first = distinct_shingles(words, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                at = first[:-1][full]
                s1, s2 = np.zeros(e - r, np.uint64), np.zeros(e - r, np.uint64)
                mins = np.empty((len(full), size), "<u4")
                if len(full):
                    s1[full], s2[full] = np.add.reduceat(mix(h + np.uint64(11)), at), np.add.reduceat(mix(h ^ np.uint64(0x5555555555555555)), at)
                    for i in range(size):
                        mins[:, i] = np.minimum.reduceat(h * mult[i], at) >> np.uint64(32)
                sig = [None] * (e - r)
                for j, i in enumerate(full.tolist()):
                    sig[i] = mins[j].tobytes()
                yield pa.record_batch([b.column(0).slice(r, e - r), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sig, pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, sig binary")


def _entries(reps: DataFrame, trees: int, depth: int, code: int) -> DataFrame:
    """Row per tree: bucket, tail, id, c (its component so far), code (so many bytes of the signature)."""
    schema = pa.schema([("bucket", pa.int64()), ("tail", pa.binary()), ("id", pa.int64()), ("c", pa.int64()), ("code", pa.binary())])
    size = trees * depth
    salt = stream(5, trees)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, size)
            low = pa.array([x.tobytes() for x in (sig[:, :code] & 255).astype(np.uint8)], pa.binary())
            for t in range(trees):
                key = np.full(len(sig), salt[t], np.uint64)
                for d in range(depth):
                    key = mix(key ^ sig[:, t * depth + d])
                rest = np.ascontiguousarray(sig[:, (t * depth + depth + np.arange(TAIL) * (depth + 1)) % size].astype(">u4"))
                tail = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * TAIL), len(rest), [None, pa.py_buffer(rest)]).cast(pa.binary())
                yield pa.record_batch([pa.array(key.view(np.int64)), tail, b.column(0), b.column(2), low], schema=schema)

    return reps.select("id", "sig", "c").mapInArrow(run, "bucket long, tail binary, id long, c long, code binary")


def _neighbours(ordered: DataFrame, near: int, crowd: int, borders: bool, code: int, agree: int) -> DataFrame:
    """Pairs (a, b) of entries of one bucket, near places apart among its first, crowd among the others, whose codes
    agree in `agree` bytes. Besides, with
    b null: members of buckets with more than near + 1 entries (tail null) and, with borders, the partition's first and
    last entries (with their tail)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("tail", pa.binary()), ("c", pa.int64()), ("code", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kx = np.zeros((0, code), np.uint8)
        kb, kt, ki, kc = np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        told, passed = 0, 0  # passed: entries of the last bucket so far

        def border(bucket, tail, i, c, x):
            return pa.record_batch([pa.array(i), pa.nulls(len(i), pa.int64()), pa.array(bucket), tail, pa.array(c), pa.array([y.tobytes() for y in x], pa.binary())], schema=schema)

        for b in it:
            bucket, ids, comp = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            codes = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(len(ids), code)
            if borders and told < near + 1:
                n = near + 1 - told
                yield border(bucket[:n], b.column(1).slice(0, n), ids[:n], comp[:n], codes[:n])
                told += min(n, len(ids))
            allb, alli, allc = np.concatenate([kb, bucket]), np.concatenate([ki, ids]), np.concatenate([kc, comp])
            allx = np.concatenate([kx, codes])
            old = len(kb)
            head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            place = np.arange(len(bucket)) - np.repeat(head, np.diff(np.append(head, len(bucket))))
            if old and len(bucket) and bucket[0] == kb[-1]:
                place[: head[1] if len(head) > 1 else None] += passed
            if len(place):
                passed = int(place[-1]) + 1
            for w in range(1, near + 1):
                if len(allb) <= w:
                    break
                same = np.flatnonzero(allb[w:] == allb[:-w])
                same = same[same + w >= old]
                if w > crowd:
                    same = same[place[same + w - old] <= near]
                x, y = alli[same], alli[same + w]
                go = allc[same] != allc[same + w]
                if agree:
                    go &= (allx[same] == allx[same + w]).sum(1) >= agree
                if go.any():
                    x, y = x[go], y[go]
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary())], schema=schema)
            late = np.flatnonzero(place > near) + old
            over = np.flatnonzero(place == near + 1) + old
            full = np.concatenate([late, *([over - w for w in range(1, near + 2)] if len(over) else [])])
            if len(full):
                yield border(allb[full], pa.nulls(len(full), pa.binary()), alli[full], allc[full], allx[full, :0])
            kt = pa.concat_arrays([kt, b.column(1)])
            kb, ki, kc = allb[-near - 1 :], alli[-near - 1 :], allc[-near - 1 :]
            kx = allx[-near - 1 :]
            kt = pa.array(kt.slice(max(0, len(kt) - near - 1)).to_pylist(), pa.binary())
        if borders and len(ki):
            yield border(kb, kt, ki, kc, kx)

    return ordered.mapInArrow(run, "a long, b long, bucket long, tail binary, c long, code binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            step = max(1, b.num_rows * (1 << 20) // max(1, b.nbytes))
            for r in range(0, b.num_rows, step):
                part = b.slice(r, step)
                sets = []
                for c in (2, 3):
                    sets.append([s for _, _, w in batches(part.column(c), lower=True) for h, f in [distinct_shingles(w, k)] for s in np.split(h, f[1:-1])])
                for x, y in zip(*sets, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    out.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(out, pa.bool_()))

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _candidates(scratch: Scratch, reps: DataFrame, trees: int, depth: int, near: int, crowd: int, code: int = 0, agree: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b, n trees; members of crowded buckets: bucket, id) of one forest. reps: id, sig, c."""
    order = ("bucket", "tail", "id")
    entries = _entries(reps, trees, depth, code).repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch.put("neighbours", _neighbours(entries, near, crowd, True, code, agree).groupBy("a", "b", "bucket", "tail", "c", "code").agg(F.count(F.lit(1)).alias("n")))
    rest = found.filter("b is null and tail is not null").select("bucket", "tail", F.col("a").alias("id"), "c", "code").repartition(1).sortWithinPartitions(*order)
    rest = scratch.put("borders", _neighbours(rest, near, crowd, False, code, agree).select("a", "b", "bucket"))
    pairs = found.filter("b is not null").select("a", "b", "n").unionByName(rest.filter("b is not null").select("a", "b", F.lit(1).cast("long").alias("n")))
    pairs = scratch.put("pairs", pairs.groupBy("a", "b").agg(F.sum("n").alias("n")))
    full = found.filter("b is null and tail is null").select("bucket", F.col("a").alias("id"))
    full = scratch.put("crowded", full.unionByName(rest.filter("b is null").select("bucket", F.col("a").alias("id"))).distinct())
    scratch.drop("neighbours", "borders")
    return pairs, full


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for c in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _undecided(full: DataFrame, comp: DataFrame) -> DataFrame:
    """Ids in crowded buckets of several components."""
    named = full.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    several = named.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("bucket")
    return full.join(several, "bucket", "left_semi").select("id").distinct()


def _tokens(texts: DataFrame, k: int) -> DataFrame:
    """Row per distinct shingle of each text: id, r (of the set), n (its size), h."""
    schema = pa.schema([("id", pa.int64()), ("r", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column(0).to_numpy()
            for r, e, words in batches(b.column(1), lower=True):
                h, first = distinct_shingles(words, k)
                n = np.diff(first)
                sums = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h + np.uint64(11)), out=sums[1:])
                made = (ids[r:e], (sums[first[1:]] - sums[first[:-1]]).view(np.int64), n)
                yield pa.record_batch([*(pa.array(np.repeat(x, n)) for x in made), pa.array(h.view(np.int64))], schema=schema)

    return texts.select("id", "text").mapInArrow(run, "id long, r long, n long, h long")


def _exact(scratch: Scratch, texts: DataFrame, comp: DataFrame, k: int, percent: int) -> DataFrame:
    """Every pair (a, b) of texts in different components whose sets can reach percent.

    A set's shingles are ordered by how many of the sets have them. Two sets meet at their first common one, where
    what is left of either bounds the intersection, so the last shingles of a set, the frequent ones, are not joined.
    """
    tokens = scratch.put("tokens", _tokens(texts, k).distinct())
    often = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    rank = F.row_number().over(Window.partitionBy("id", "r").orderBy("f", "h"))
    # shingles of one set alone come first; they only move the places of the others
    shared = tokens.join(often, "h").withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("id", "r")) - rank + 1)
    shared = shared.filter(F.col("left") * 100 >= F.col("n") * percent).select("id", "n", "h", "left")
    shared = shared.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "n", "h", "left", F.coalesce("component", "id").alias("c"))
    shared = scratch.put("prefixes", shared)
    scratch.drop("tokens")
    # of two sets the smaller one's intersection is 2 * percent / (100 + percent) of it or more
    small = shared.filter(F.col("left") * (100 + percent) >= F.col("n") * (2 * percent)).select("h", *(F.col(x).alias(f"{x}1") for x in ("id", "n", "left", "c")))
    met = small.join(shared, "h").filter("c1 <> c and (n1 < n or n1 = n and id1 < id)")
    met = met.filter(F.least("left1", "left") * (100 + percent) >= (F.col("n1") + F.col("n")) * percent)
    return met.select(F.least("id1", "id").alias("a"), F.greatest("id1", "id").alias("b")).distinct()


def _with_class(sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n_shingles, node per row of sigs. Classes of more than one row in HOT are HOT at most, so they are broadcast,
    and no task gets the rows of a hot one."""
    rows = sigs.select("id", "n_shingles", "s1", "s2")
    big = classes.filter(F.col("rows") * HOT > F.lit(sigs.count())).select("s1", "s2", F.col("node").alias("hot"))
    marked = rows.join(F.broadcast(big), ["s1", "s2"], "left")
    small = classes.join(F.broadcast(big), ["s1", "s2"], "left_anti").select("s1", "s2", "node")
    rest = marked.filter("hot is null").drop("hot").join(small.hint("merge"), ["s1", "s2"], "left")
    return marked.filter("hot is not null").select("id", "n_shingles", F.col("hot").alias("node")).unionByName(rest.select("id", "n_shingles", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, trees: int = 24, depth: int = 3, near: int = 8, crowd: int = 3, levels: int = 2) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) per row of docs."""
    scratch = Scratch(docs.sparkSession)
    sigs = scratch.put("signatures", signatures(docs, id_col, text_col, k, trees * depth))
    classes = scratch.put("classes", sigs.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("rows")))
    reps = sigs.filter("n_shingles > 0").join(classes.select("s1", "s2", F.col("node").alias("id")), ["s1", "s2", "id"], "left_semi").withColumn("c", F.col("id"))
    pairs, full = _candidates(scratch, reps, trees, depth, near, crowd)

    need = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = scratch.put("texts", texts.join(need.hint("merge"), "id", "left_semi"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), F.xxhash64("a", "b"), "b"))
    best = both.withColumn("_r", rank).filter(F.col("_r") <= FIRST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    best = scratch.put("best", best.distinct())
    comp = scratch.put("groups", components(_confirmed(best, texts, k, percent)))

    pairs = scratch.put("apart", _apart(pairs, comp))  # what the confirmed links have joined needs no look again
    seen = best.unionByName(pairs)
    missed = (1 - (percent / 100) ** depth) ** trees
    share = percent / 100 + (1 - percent / 100) / 256  # of equal bytes at the similarity
    agree = math.floor(CODE * share - DEVIATIONS * math.sqrt(CODE * share * (1 - share)))
    deep, turn = depth, 0
    while True:
        more = scratch.put(f"more{turn}", _confirmed(pairs, texts, k, percent))
        stars = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comp = scratch.put(f"groups{turn}", components(stars.unionByName(more)))
        again = scratch.put(f"undecided{turn}", _undecided(full, comp))
        scratch.drop("pairs", "crowded")
        if again.isEmpty():
            break
        if turn + 1 == levels:
            met = scratch.put("met", _exact(scratch, texts.join(again, "id", "left_semi"), comp, k, percent))
            more = scratch.put("last", _confirmed(met, texts, k, percent))
            stars = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comp = scratch.put("groups_last", components(stars.unionByName(more)))
            break
        deep, turn = deep + depth, turn + 1
        many = math.ceil(math.log(missed) / math.log(1 - (percent / 100) ** deep))
        reps = signatures(texts.join(again, "id", "left_semi"), "id", "text", k, many * deep).select("id", "sig")
        reps = reps.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "sig", F.coalesce("component", "id").alias("c"))
        pairs, full = _candidates(scratch, scratch.put(f"deep{turn}", reps), many, deep, near, near, CODE, agree)
        pairs = pairs.select("a", "b").join(seen, ["a", "b"], "left_anti")  # of different components by themselves

    named = _with_class(sigs, classes)
    named = named.join(comp.select("node", F.col("component").alias("c")), "node", "left")
    group = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.coalesce("c", "node"))
    out = keep(named.select(F.col("id").alias(id_col), "n_shingles", group.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull())))
    scratch.drop()
    return out
