import collections
import hashlib
import random
import re

import pytest

from cloneframe.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, size):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    seen = collections.Counter(tuple(w[i : i + size]) for _, w in words for i in range(len(w) - size + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [4, 7, 35])
def test_equals_brute_force(spark, size):
    rng = random.Random(size)
    vocab = [f"w{i}é" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(90)]
    rows = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            a = rng.randint(0, 60)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randint(size - 1, size + 25)]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "a " * 200), (904, "x y " * 100), (905, "   b")]
    rows += [rows[3], rows[3], (906, rows[5][1]), (None, rows[6][1])]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = sorted(map(tuple, remove_repeats(docs, size).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute(rows, size)


def test_empty_table_and_clash(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(empty, 35).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(empty.withColumnRenamed("lang", "n_words"), 35)
