import hashlib
import random
import re

from pyspark.sql import functions as F

from cloneframe.llm.sketch import containment, fingerprints, merge, sketch, with_next

SCHEMA = "doc_id long, text string"


def brute(rows):
    order = sorted(((d if d is not None else -(1 << 63), t or "", d) for d, t in rows), reverse=True)
    out = []
    for i, (_, t, d) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    return sorted(out, key=str)


def test_next_and_edit(spark):
    rng = random.Random(1)
    rows = [(i * 7 - 50, "".join(rng.choice("ab é🙂\n") for _ in range(rng.randint(0, 60)))) for i in range(90)]
    rows += [(None, "null id"), (rows[3][0], "same id"), rows[5], (10_000, None), (10_001, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = fingerprints(docs).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == brute(rows)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    small = with_next(docs, "doc_id", "text", per_bucket=4)
    whole = with_next(docs, "doc_id", "text")
    assert sorted(map(str, small.collect())) == sorted(map(str, whole.collect()))


def test_equal_texts_and_estimates(spark):
    w = [f"w{i}" for i in range(3000)]
    rows = [(4, " ".join(w)), (3, "\n".join(w)), (2, " ".join(w[:1000])), (1, " ".join(w)), (0, "a b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert got[4].fingerprint == got[1].fingerprint != got[3].fingerprint
    assert abs(got[3].near_next - 1 / 3) < 0.1 and abs(got[4].near_next - 1) < 1e-9
    s = {r.doc_id: r.s for r in docs.select("doc_id", sketch(F.col("text")).alias("s")).collect()}
    both = spark.createDataFrame([(s[4], s[2])], "a array<long>, b array<long>")
    assert both.select(containment(F.col("a"), F.col("b"))).first()[0] == 1
    assert both.select(merge(F.col("a"), F.col("b"))).first()[0] == s[4]
    assert 300 < len(s[4]) < 450


def test_single_and_empty(spark):
    one = spark.createDataFrame([(1, "a b c")], SCHEMA)
    assert [r.near_next for r in fingerprints(one).collect()] == [1.0]
    assert fingerprints(one.limit(0)).count() == 0


def plain_hashes(spark, texts):
    """Sorted retained hashes of each text, from a plain list of its shingles."""
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        shingles = sorted({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {" ".join(w)} if w else set())
        rows = spark.createDataFrame([(x,) for x in shingles], "s string").select(F.xxhash64("s")).collect() if shingles else []
        out.append(sorted(r[0] for r in rows if -(2**60) <= r[0] < 2**60))
    return out


def test_sketches_and_likeness_by_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(900)]
    texts = [" ".join(base[: rng.randrange(900)] + [f"x{rng.randrange(50)}" for _ in range(rng.randrange(60))]) for _ in range(12)] + ["", "a", "a b c d e", "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    kept = plain_hashes(spark, texts)
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].fingerprint.split(":")[1] == ",".join(f"{h & (2**64 - 1):x}" for h in kept[i]) and got[i].fingerprint.startswith(f"{len(kept[i])}-")
        j = (i - 1) % len(texts)
        half = len(t) // 2
        e = t[: len(t) - half] + texts[j][:half]
        ke = plain_hashes(spark, [e])[0]
        like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0
        assert abs(got[i].near_next - (1.0 if texts[j] == t else like(kept[i], kept[j]))) < 1e-12
        assert abs(got[i].near_edited - (1.0 if e == t else like(kept[i], ke))) < 1e-12


def test_hot_and_null_ids(spark):
    rng = random.Random(4)
    rows = [(5 if i % 3 else None if i % 2 else i, "".join(rng.choice("ab,é") for _ in range(rng.randint(0, 5)))) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    small = with_next(docs, "doc_id", "text", per_bucket=6, most_buckets=20)
    order = sorted(((-(1 << 63) if d is None else d, t) for d, t in rows), reverse=True)
    want = [(d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)]
    got = [(-(1 << 63) if r.doc_id is None else r.doc_id, r.text, r.following) for r in small.collect()]
    assert sorted(got) == sorted(want)
