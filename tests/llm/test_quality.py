import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from cloneframe.llm.quality import measure, ngrams, train
from cloneframe.llm.words import batches, mix

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, note string"


def base(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = [0] * len(w)
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            cover[i : i + 8] = [1] * 8
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(cover), len(w) < 20 or 100 * sum(cover) > 30 * len(w)


def test_counts_and_verdict(spark):
    good, bad = [f"good{i}" for i in range(80)], [f"junk{i}##" for i in range(80)]
    rows, labels = [], []
    for d in range(120):
        source = bad if d % 3 == 0 else good
        rows.append((d, "\n".join(" ".join(source[(d * 7 + i * k) % 80] for k in range(11)) for i in range(1, 6)), "x"))
        if d < 90:
            labels.append((d, int(d % 3 > 0)))
    rows += [(200, None, None), (201, "", "x"), (202, " \n\t", "x"), (203, "é a " * 300, "x"), (204, "one\none\n one\n\n", "x"), (None, rows[1][1], "x"), rows[1], rows[1], (205, "a b c d e f g h " * 2 + " ".join(good), "x")]
    labels += [(1, 0), (2, None), (None, 1), (3, 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = measure(docs, model).collect()
    assert len(got) == len(rows)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=str) == sorted([(d, *base(t)) for d, t, _ in rows], key=str)
    for r in got:
        if r.doc_id is not None and r.doc_id < 120:
            assert r.kept == (r.doc_id % 3 > 0 and not r.base_failed)
        assert not (r.kept and r.base_failed)


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)), "")], SCHEMA)
    assert [r.kept for r in measure(docs, train(docs, none)).collect()] == [True]
    empty = docs.limit(0)
    assert measure(empty, train(empty, none)).count() == 0


def test_verdict_by_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for d in range(160):
        good = d % 2
        share = rng.random() * 0.5 + (0.4 if good else 0.0)
        rows.append((d, " ".join(rng.choice(words[:100] if rng.random() < share else words[100:]) for _ in range(rng.randint(5, 90))), "x"))
        if d < 120:
            labels.append((d, good))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bits = 8
    got = {r.doc_id: r for r in measure(docs, train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), bits=bits)).collect()}

    def cells(text):
        return [c for _, _, w in batches(pa.array([text]), lower=True) for c in ngrams(w, bits)[0].tolist()]

    half = {d: int((mix(np.array([d], np.uint64) + np.uint64(7)) & np.uint64(1))[0]) for d, _ in labels}
    raw, target = collections.Counter(), collections.Counter()
    for d, t, _ in rows:
        raw.update(cells(t))
        if dict(labels).get(d) == 1 and half[d] == 0:
            target.update(cells(t))
    n = 1 << bits
    ratio = [math.log((target[c] + 1) / (target.total() + n)) - math.log((raw[c] + 1) / (raw.total() + n)) for c in range(n)]
    score = {d: sum(ratio[c] for c in cells(t)) / len(cells(t)) for d, t, _ in rows}
    test = sorted((score[d], y) for d, y in labels if half[d] == 1)
    goods = sum(y for _, y in test)
    errors = [4 * sum(y for _, y in test[:i]) / goods + sum(1 - y for _, y in test[i:]) / (len(test) - goods) for i in range(len(test) + 1)]
    cut = min(range(len(errors)), key=lambda i: (round(errors[i], 9), i))
    threshold = -math.inf if cut == 0 else (test[cut - 1][0] + test[min(cut, len(test) - 1)][0]) / 2
    kept = {d: not base(t)[-1] and score[d] >= threshold for d, t, _ in rows}
    assert len(set(kept.values())) == 2
    for d in score:
        assert abs(got[d].llr - score[d]) < 1e-9 and got[d].kept == kept[d], d


def test_every_label_counts(spark, monkeypatch):
    """Labels of 60,000 other ids take no place from those of the documents."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(d, " ".join(f"{'good' if rng.random() < 0.3 + 0.4 * (d % 2) else 'junk'}{rng.randrange(40)}" for _ in range(40)), "x") for d in range(120)], SCHEMA)
    labels = spark.createDataFrame([(d, d % 2) for d in range(120)], "doc_id long, quality int")
    other = spark.range(1_000, 61_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    one, many = train(docs, labels, bits=8), train(docs, labels.unionByName(other), bits=8)
    assert np.isfinite(one.threshold) and one.threshold == many.threshold and (one.ratio == many.ratio).all()
    monkeypatch.setattr("cloneframe.llm.quality.MOST_BROADCAST", 10)
    assert train(docs, labels, bits=8).threshold == one.threshold
