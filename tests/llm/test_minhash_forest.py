import random
import re

from cloneframe.llm.minhash_forest import near_duplicates
from cloneframe.operators.components import components

SCHEMA = "doc_id long, text string, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(rows):
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    return out


def brute(rows):
    s = sets(rows)
    comp = {d: d for d in s}
    changed = True
    while changed:
        changed = False
        for a in s:
            for b in s:
                if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return {d: (len(s[d]), comp[d], comp[d] == d) for d in s}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for d in range(0, 150):
        w = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 200]))]
        rows.append((d, " ".join(w)))
        for j in range(rng.choice([0, 0, 1, 3])):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append((1000 + 10 * d + j, rng.choice(["  ", "\n"]).join(x).upper()))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "a b"), (904, "A  b"), (905, "A  b c")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_crowded_region_and_repeated_rows(spark):
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: i % 90], f"x{i}", *base[i % 90 :]])) for i in range(300)]
    rows += rows[:5] + [(None, rows[7][1]), (None, "alone here")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None} == {0}
    assert sorted((r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(False, False), (True, True)]


def test_undecided_regions_go_deeper(spark):
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(70)]
    rows = []
    for d in range(80):  # one crowd of moderate likeness, with pairs of near copies in it
        own = [*shared, *(f"o{d}x{i}" for i in range(30))]
        rows.append((d, " ".join(own)))
        if d % 4 == 0:
            own[rng.randrange(100)] = "changed"
            rows.append((1000 + d, " ".join(own)))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, near=4, crowd=1).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(5, 5), (9, None)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(1000, 1200)}}


def test_buckets_undecided_after_the_last_forest_are_joined_exactly(spark):
    shared = [f"s{i}" for i in range(85)]
    rows = []
    for d in range(150):  # a crowd of likeness 0.69; each text has one link of 0.77
        own = [f"o{d}x{i}" for i in range(18)]
        rows += [(d, " ".join(shared + own)), (1000 + d, " ".join([*shared, *own[:5], *(f"p{d}x{i}" for i in range(13))]))]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, near=1, crowd=1).collect()}
    assert got == {d: d % 1000 for d, _ in rows}
