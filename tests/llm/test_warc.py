import hashlib
import random

import numpy as np
import pytest

from cloneframe.llm import warc

SCHEMA = "page_id long, url string, html string, extra int"


def brute(rows):
    first = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 100 and p is not None:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        refers = first.get(h) if first.get(h) != p else None
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def rows_of(n):
    rng = random.Random(4)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    out = []
    for i in range(n):
        body = "".join(rng.choice(["é", "<p>", "text ", "\r\n\r\n", "WARC/1.1\r\n", fake]) for _ in range(rng.randint(0, 80)))
        out.append((i, f"http://x/{i}", body))
    out += [(1000 + i, "u\r\nContent-Length: 9", out[i % 7][2]) for i in range(60)]
    return [*out, (2000, None, None), (2001, "", ""), out[3], (None, "n", "z" * 200), (2002, "n", "z" * 200)]


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_round_trip_rejects_magic_in_payloads(spark, tmp_path, size):
    rows = rows_of(150)
    pages = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    got = warc.read(spark, path, size).collect()
    assert sorted([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(rows)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest == r.block_digest


@pytest.mark.parametrize("bits", [1, 32, 1 << 16])
def test_full_bitmaps_only_join_more(spark, tmp_path, monkeypatch, bits):
    rows = rows_of(80)
    monkeypatch.setattr(warc, "bits_for", lambda n: bits)
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3), path)
    got = warc.read(spark, path, with_payload=False).collect()
    assert sorted([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(rows)


def test_jump_is_the_walk():
    rng = random.Random(1)
    place = np.array(sorted(rng.sample(range(1000), 200)))
    after = np.array([rng.choice([int(rng.choice(place)), p + 37]) for p in place])
    after = np.maximum(after, place + 1)
    known = set(place.tolist())
    nxt = dict(zip(place.tolist(), after.tolist(), strict=True))
    for p, got in zip(place.tolist(), warc.jump(place, after, 900).tolist(), strict=True):
        at = nxt[p]
        while 0 <= at < 900:
            at = nxt[at] if at in known else -1
        assert at == got


def test_broken_chain_and_empty(spark, tmp_path):
    (tmp_path / "bad.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nrubbish")
    with pytest.raises(ValueError):
        warc.read(spark, f"file://{tmp_path}/bad.warc")
    warc.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_long_urls(spark, tmp_path, size):
    rows = [(i, "data:," + "x" * (1_000_000 if i == 7 else 100_000 if i % 3 == 1 else 9), "<p>" * 50_000 if i == 4 else f"text {i}") for i in range(8)]
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(2), path)
    got = warc.read(spark, path, size).collect()
    assert sorted((r.id, r.url, r.payload.decode()) for r in got) == rows
