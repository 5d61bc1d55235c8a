import collections
import math
import random
import re
import zlib

import numpy as np

from cloneframe.llm import hmm
from cloneframe.llm.hmm import Hmm, _time_major, expect, forward, score_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(k=3, n=6):
    rng = np.random.default_rng(1)
    make = lambda *s: (x := rng.random(s)) / x.sum(-1, keepdims=True)
    return Hmm(make(k), make(k, k), make(k, n).T.copy())


def plain(m, seq):
    """Likelihood and expected counts by summing over every path."""
    k = m.states
    total, starts, pairs, emits = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for path in np.ndindex(*[k] * len(seq)):
        p = m.start[path[0]]
        for t, x in enumerate(seq):
            p *= m.emit[x, path[t]] * (m.move[path[t - 1], path[t]] if t else 1)
        total += p
        starts[path[0]] += p
        for t, x in enumerate(seq):
            emits[x, path[t]] += p
            if t:
                pairs[path[t - 1], path[t]] += p
    return total, starts / total, pairs / total, emits / total


def test_recursions_equal_the_sum_over_paths():
    m = model()
    seqs = [[0, 3, 5, 1, 2], [1, 1, 4], [2], [5]]
    lengths = np.array([len(s) for s in seqs])
    alive, place = _time_major(lengths)
    cls = np.empty(len(place), np.int64)
    cls[place] = np.concatenate(seqs)
    _, scale = forward(m, alive, m.emit[cls])
    got = np.add.reduceat(np.log(scale)[place], np.cumsum(lengths) - lengths)
    want = [plain(m, s) for s in seqs]
    assert np.allclose(got, [math.log(w[0]) for w in want])
    for i, x in enumerate(expect(m, alive, cls)):
        assert np.allclose(x, sum(w[i + 1] for w in want)), i


def rows_of():
    rng = random.Random(3)
    vocab = {"a": [f"le{i}" for i in range(60)], "b": [f"The{i}" for i in range(60)]}
    rows = [(i, " ".join(rng.choice(vocab["ab"[i % 2]]) for _ in range(rng.randint(150, 400)))) for i in range(120)]
    return [*rows, (500, None), (501, ""), (502, "new words é here"), (None, "le1 le2"), (3, rows[3][1])]


def test_base_and_held_out_score(spark, monkeypatch):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 900)
    got = score_documents(docs, states=2, classes=64).collect()
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))) for d, t in rows]
    out = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    c, ends = collections.Counter(), 0
    for (_, w), h in zip(words, out, strict=True):
        if not h:
            c.update(w)
            ends += 1
    n, v = c.total() + ends, len(c) + 1
    want = []
    for (d, w), h in zip(words, out, strict=True):
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        want.append((d, h, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6)))
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=str) == sorted(want, key=str)
    test = [r for r in got if r.held_out and r.n_tokens > 50]
    assert len(test) > 10 and all(r.score > r.base_score for r in test)
    assert all(r.score < 0 for r in got)


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(11, "only held out")], "doc_id long, text string")
    assert hmm.held_out(11) or not hmm.held_out(11)
    held = next(i for i in range(50) if hmm.held_out(i))
    one = spark.createDataFrame([(held, "only held out")], "doc_id long, text string")
    r = score_documents(one, states=2, classes=8).first()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.held_out) == (0, 0, 4, True)
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert [(x.n_tokens, x.n_known) for x in score_documents(blank, states=2, classes=8).collect()] == [(1, 1), (1, 1)]
    assert score_documents(docs.limit(0), states=2, classes=8).count() == 0


def test_training_and_score_by_brute_force(spark, monkeypatch):
    """Counts summed over blocks and partitions, and scores, equal those of one plain pass over all documents."""
    docs_rows = [(i, " ".join(t.split()[:7]) if t else t) for i, t in rows_of()[:40]]
    docs = spark.createDataFrame(docs_rows, "doc_id long, text string").repartition(3)
    classes, states, prior = 8, 2, 5.0
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 60)
    models = []
    inner = hmm.train
    monkeypatch.setattr(hmm, "train", lambda table, corpus, *a: models.append((inner(table, corpus, states, classes, 0, prior), corpus, inner(table, corpus, *a))) or models[0][2])
    got = {r.doc_id: r for r in score_documents(docs, states=states, classes=classes, passes=2, prior=prior).collect()}
    begin, corpus, end = models[0]

    from cloneframe.llm.words import batches
    import pyarrow as pa

    seqs, hashes, count = {}, {}, collections.Counter()
    for d, t in docs_rows:
        w = next((x for *_, x in batches(pa.array([t or ""]), lower=True)), None)
        hashes[d] = w.hashes if w is not None else np.zeros(0, np.uint64)
        seqs[d] = [*hmm.word_class(hashes[d], classes).tolist(), classes]
        if not hmm.held_out(d):
            count.update(hashes[d].tolist())
    model = Hmm(begin.start, begin.move, begin.emit.astype(float))
    for _ in range(2):
        starts, pairs, emits = np.zeros(states), np.zeros((states, states)), np.zeros((classes + 1, states))
        for d, s in seqs.items():
            if not hmm.held_out(d):
                _, a, b, c = plain(model, s)
                starts, pairs, emits = starts + a, pairs + b, emits + c
        move, start = pairs + 0.1, starts + 0.1
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), (emits + prior * corpus[:, None]) / (emits.sum(0) + prior))
    assert np.allclose(end.emit, model.emit, rtol=1e-3) and np.allclose(end.move, model.move, rtol=1e-3) and np.allclose(end.start, model.start, rtol=1e-3)
    docs_in = sum(not hmm.held_out(d) for d in seqs)
    mass = [0.5 * (1 + sum(hmm.word_class(np.array([w], np.uint64), classes)[0] == c for w in count)) + sum(n for w, n in count.items() if hmm.word_class(np.array([w], np.uint64), classes)[0] == c) for c in range(classes)]
    assert np.allclose(corpus, np.array([*mass, docs_in + 0.5]) / (sum(mass) + docs_in + 0.5))
    for d, s in seqs.items():
        want = math.log10(plain(model, s)[0]) + sum(math.log10((count[w] + 0.5) / mass[c]) for w, c in zip(hashes[d].tolist(), s, strict=False))
        assert abs(got[d].score - want) < 1e-3 * abs(want), d
