import collections
import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from cloneframe.llm.quality import measure, train
from tests.llm.test_minhash_forest import brute as near_groups
from tests.llm.test_substring_dedup import brute as cut_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    rng = random.Random(9)
    good, bad = [f"good{i}" for i in range(300)], [f"junk{i}##" for i in range(60)]
    passage = " ".join(rng.choice(good) for _ in range(50))
    rows = []
    for d in range(90):
        source = bad if d % 5 == 0 else good
        text = "\n".join(" ".join(rng.choice(source) for _ in range(12)) for _ in range(8))
        if d % 7 == 1:
            text += "\n" + passage
        if d % 11 == 2:
            text += f" mail some.{d}@host.example.com card 4845168114407329"
        rows.append((d, text))
    rows += [(200 + d, rows[d][1]) for d in (1, 2, 6, 7)]
    rows += [(300 + d, rows[d][1].replace("good7 ", "good8 ")) for d in (3, 4, 8)]
    rows += [(400, None), (401, ""), (402, "too short"), rows[9]]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, int(d % 5 > 0)) for d in range(60)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def kept(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_every_stage_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = corpus(spark, folder)
    stage = dict(corpus_pipeline.STAGES)

    one = stage["quality_rules"](spark, docs, folder)
    assert one.columns == docs.columns
    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    verdict = {r.doc_id: r.kept for r in measure(docs, model).collect()}
    assert {d for d, _ in kept(one)} == {d for d, k in verdict.items() if k}
    assert {d for d in range(90) if d % 5} <= {d for d, _ in kept(one)} and not {d for d in range(90) if d % 5 == 0} & {d for d, _ in kept(one)}

    two = stage["near_dedup"](spark, one, folder)
    groups = near_groups(kept(one))
    assert two.columns == docs.columns and [d for d, _ in kept(two)] == sorted(d for d, g in groups.items() if g[2])

    three = stage["substring_dedup"](spark, two, folder)
    want = {d: (n, gone) for d, n, gone, _ in cut_repeats(kept(two), 35)}
    left = {d: len(t.split()) for d, t in kept(three)}
    assert three.columns == docs.columns and left == {d: n - gone for d, (n, gone) in want.items() if n > gone} and any(gone for _, gone in want.values())
    assert all(r.n_chars == len(r.text) for r in three.collect())

    four = stage["private_values"](spark, three, folder)
    before, after = dict(kept(three)), dict(kept(four))
    assert four.columns == docs.columns and before.keys() == after.keys()
    for d, t in after.items():
        assert "4845168114407329" not in t and "some." not in t
        assert (t == before[d]) == ("@host.example.com" not in before[d])

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = collections.defaultdict(bytes)
    for r in sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] += r.ids
    assert ids == {d: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for d, t in after.items()}


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "private_values", "packing"]
    with pytest.raises(KeyError):
        dict(corpus_pipeline.STAGES)["none"]


def test_near_dedup_decides_by_row(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(5)]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3] + " more"), (3, texts[4]), (4, ""), (4, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    want = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (3, texts[4]), (4, ""), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
