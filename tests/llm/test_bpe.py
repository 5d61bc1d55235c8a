import hashlib
import random

from public_tokenizers import path
from tokenizers import Tokenizer

from cloneframe.llm.bpe import Bpe, round_trip

FILE = path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    alphabet = ["a", "The", "don't", "'s", "É", "é", "é", "12", "!!", "\n", " ", " ", "\t", " ", "<|endoftext|>", " ", "日本", "\r\n", "_", "\x1c", "İ", "Σ", "ß", "ing", "tion", "🙂", "<|startoftext|>"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return [*out, "ab" * 3000, "x" * 700, "é" * 300, " ", "."]


def test_equals_the_library():
    coder, library = Bpe(FILE), Tokenizer.from_file(FILE)
    library.no_truncation()
    library.no_padding()
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        got = coder.encode(t)
        assert [int(x) for x in got.split()] == want, repr(t)
        assert coder.decode(got).decode() == library.decode(want, skip_special_tokens=False), repr(t)


def test_short_and_long_agree():
    coder, rng = Bpe(FILE), random.Random(1)
    for _ in range(300):
        ids = [coder.first[rng.choice(b"thinged")] for _ in range(rng.randint(1, 60))]
        assert coder._short(list(ids)) == coder._long(list(ids))


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate([*texts()[:200], None, ""])] + [(None, "a b"), (3, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(FILE)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, round_trip(docs, FILE).collect()), key=str) == sorted(want, key=str)
    assert round_trip(docs.limit(0), FILE).count() == 0
