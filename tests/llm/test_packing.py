import collections
import random
import zlib

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from cloneframe.llm.packing import Encoder, Packer, pack

FILE = path("byte_bpe_50k.json")


def test_encoder_equals_the_library():
    rng = random.Random(5)
    encode, library = Encoder(FILE), Tokenizer.from_file(FILE)
    alphabet = ["a", "The", "don't", "'s", "é", "12", "!!", "\n", " ", " ", " ", "  ", "\t", " ", "<|endoftext|>", " ", "日本", "\r\n", "_", "\x1c", "“", "—", "Ж", "α", "ª", "½", "\u2003", "ꙮ", "🙂", "\xa0", "\x85"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, "x" * 5000, " " * 3_000_000 + "a", "é1" * 300_000]
    for t in texts:
        assert encode(t) == np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_little_padding():
    rng = random.Random(1)
    p = Packer(64)
    for d in range(2000):
        p.add(d, bytes(4 * rng.randint(1, 100)))
        assert p.levels.sum() < 80
    p.finish()
    fill = collections.Counter()
    for *_, ids, _, seq, offset in [(x[0], x[1], x[2], x[3], x[4], x[5]) for x in p.done]:
        assert fill[seq] == offset
        fill[seq] += len(ids) // 4
    assert all(v == 64 or v & (v - 1) == 0 for v in fill.values())


def test_every_id_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["word", "other", "x\ny"]) for _ in range(rng.randint(0, 1500)))) for i in range(60)]
    rows += [(70, None), (71, ""), (None, "null id"), (72, "b " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(FILE)
    by = collections.defaultdict(list)
    for r in pack(docs, FILE).collect():
        by[r.doc_id].append(r)
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        got = sorted(by[d], key=lambda r: r.start)
        assert b"".join(r.ids for r in got) == ids
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids) and r.doc_tokens * 4 == len(ids) for r in got)
    assert pack(docs.limit(0), FILE).count() == 0


def test_placement_by_brute_force():
    """Every choice against the sums of squares of all choices, written out."""
    rng = random.Random(4)
    for c in (8, 13):
        p = Packer(c)
        for d in range(1500):
            size = rng.randint(1, c - 1)
            levels = p.levels.tolist()

            def after(h):
                n = levels.copy()
                if h:
                    n[h] -= 1
                if h + size < c:
                    n[h + size] += 1
                return sum(x * x for x in n[1:c])

            fits = [0, *(h for h in range(1, c - size + 1) if levels[h])]
            want = min(fits, key=lambda h: (after(h), -h))
            assert p._level(size) == want, (levels, size)
            p.add(d, bytes(4 * size))
            now = levels.copy()
            if want:
                now[want] -= 1
            if want + size < c:
                now[want + size] += 1
            assert p.levels.tolist()[:c] == now[:c]
