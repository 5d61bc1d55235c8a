"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio against trusted text.

Words and pairs of words (A-Z lower-cased) are hashed into `buckets` cells. Two multinomials are counted: the raw
corpus (every document) and the trusted target (documents labelled 1). A document's score is the mean over its n-grams
of log(target share / raw share), so length does not count. One half of the labelled ids, by a hash of the id, trains
the target; the other half, both labels, fits the threshold: the cut with the least weighted error, a lost good
document counting `good_weight` times. Every document is then compared with that one threshold. The counts are
additive, so partitions count apart and the cells, a fixed number, are summed. Labels of any number are joined; the
cuts are judged where the scores lie, in ranges, and one cut of each range goes to the driver.

Cases: null or empty text has no words, so base_failed is true; ties with the threshold are kept; repeated rows get
equal results; labels that are null, unknown or in conflict are ignored (a document labelled both is not trusted);
without labels of both kinds the threshold is -inf; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloneframe.llm.common import keep, map_arrow
from cloneframe.llm.words import SPACE, Prefix, Words, batches, mix
from cloneframe.plans.scratch import release

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MOST_BROADCAST = 1_000_000  # labels; more are joined by a shuffle
MADE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "llr": "double"}


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    threshold: float


def ngrams(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of each word and each pair of neighbouring words of a row."""
    rows = words.rows
    pairs = Prefix(words.hashes).windows(2)
    same = rows[1:] == rows[:-1]
    h = np.concatenate([words.hashes, pairs[same]])
    return (h >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([rows, rows[:-1][same]])


def _score(words: Words, ratio: np.ndarray) -> np.ndarray:
    cell, row = ngrams(words, int(len(ratio)).bit_length() - 1)
    n = len(words.first) - 1
    return np.bincount(row, weights=ratio[cell], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)


def _half(ids: np.ndarray) -> np.ndarray:
    """0 or 1 by a hash of the id."""
    return (mix(ids.view(np.uint64) + np.uint64(7)) & np.uint64(1)).astype(np.int64)


def _labelled(labels: DataFrame) -> DataFrame:
    """(_id, _label) of every id with one known label."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    return one.filter("lo = hi").select("_id", F.col("lo").cast("long").alias("_label"))


def _threshold(scores: DataFrame, good_weight: float) -> float:
    """The cut of the least error of (score, label) rows: the middle between the scores beside it, -inf before the
    first. Of equal errors, the lowest cut."""
    at = scores.groupBy("score").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    at = keep(at.repartitionByRange("score").sortWithinPartitions("score").withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    parts = sorted(at.groupBy("_part").agg(F.sum("good"), F.sum("bad"), F.max("score")).collect())  # a row per partition
    all_good, all_bad = sum(p[1] for p in parts), sum(p[2] for p in parts)
    if not all_good or not all_bad:
        return -np.inf
    rows, good, bad, last = [], 0, 0, None
    for part, g, b, top in parts:
        rows.append((part, good, bad, last))
        good, bad, last = good + g, bad + b, top
    starts = at.sparkSession.createDataFrame(rows, "_part long, _good long, _bad long, _last double")
    # the cut before a score: what lies below it goes
    w = Window.partitionBy("_part").orderBy("score")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    cuts = at.join(F.broadcast(starts), "_part").select("score", F.coalesce(F.lag("score").over(w), "_last").alias("low"), (F.col("_good") + F.coalesce(F.sum("good").over(below), F.lit(0))).alias("lost"), (F.col("_bad") + F.coalesce(F.sum("bad").over(below), F.lit(0))).alias("gone"))
    error = good_weight * (F.col("lost") / all_good) + (1 - F.col("gone") / all_bad)
    best = cuts.select(error.alias("error"), "score", "low").agg(F.min(F.struct("error", "score", "low")).alias("m")).first().m
    if good_weight < best.error:  # all go
        return float(last)
    return -np.inf if best.low is None else (best.low + best.score) / 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 15, smooth: float = 1.0, good_weight: float = 4.0) -> Model:
    """Counts over all docs, target and threshold of all labelled ones."""
    cells = 1 << bits
    known = keep(_labelled(labels))
    if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in it:
            trusted = np.asarray(b.column(2).fill_null(0)) == 1
            trusted &= _half(np.asarray(b.column(0).fill_null(0))) == 0
            for r, _, words in batches(b.column(1), lower=True):
                cell, row = ngrams(words, bits)
                raw += np.bincount(cell, minlength=cells)
                target += np.bincount(cell[trusted[r + row]], minlength=cells)
        full = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(full), pa.array(raw[full]), pa.array(target[full])], names=["cell", "raw", "target"])

    sums = source.join(known, "_id", "left").select("_id", "_text", "_label").mapInArrow(count, "cell long, raw long, target long").groupBy("cell").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(cells), np.zeros(cells)
    for c, x, y in sums.collect():  # at most `cells` rows
        raw[c], target[c] = x, y
    del sums
    release(docs.sparkSession)  # where texts were shuffled to the labels, before they are again
    ratio = np.log((target + smooth) / (target.sum() + smooth * cells)) - np.log((raw + smooth) / (raw.sum() + smooth * cells))
    if not target.sum():
        return Model(np.zeros(cells), -np.inf)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            mine = b.filter(pa.array(_half(np.asarray(b.column(0))) == 1))
            for r, e, words in batches(mine.column(1), lower=True):
                yield pa.record_batch([mine.column(0).slice(r, e - r), mine.column(2).slice(r, e - r), pa.array(_score(words, ratio))], names=["id", "label", "score"])

    got = source.join(known, "_id").select("_id", "_text", "_label").mapInArrow(score, "id long, label long, score double")
    return Model(ratio, _threshold(got.groupBy("id").agg(F.min("score").alias("score"), F.min("label").alias("label")), good_weight))


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip():  # ASCII white space alone, as words have it
            n += line in seen
            seen.add(line)
    return n


def _repeat_words(words: Words) -> np.ndarray:
    """Per row, words inside WINDOW-word windows that occur twice or more in the row."""
    n, rows = len(words.hashes), words.rows
    out = np.zeros(len(words.first) - 1, np.int64)
    if n < WINDOW:
        return out
    h = Prefix(words.hashes).windows(WINDOW)
    valid = rows[WINDOW - 1 :] == rows[: n - WINDOW + 1]
    h = mix(h ^ (rows[: len(h)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    s = np.sort(h[valid])
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        twice = np.unique(twice)
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        start = np.flatnonzero((twice[at] == h) & valid)
        step = np.zeros(n + 1, np.int64)
        step[start] += 1
        step[start + WINDOW] -= 1
        out += np.bincount(rows, weights=np.cumsum(step[:n]) > 0, minlength=len(out)).astype(np.int64)
    return out


def measure(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns named in carry (all of docs, if None) and the columns MADE."""
    carry = docs.columns if carry is None else carry
    if clash := set(MADE) & set(carry):
        raise ValueError(f"columns {sorted(clash)} are made here; rename yours")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    fields = [*((c, kinds[c]) for c in carry), *MADE.items()]
    source = docs.select(*(f"`{c}`" for c in dict.fromkeys([*carry, text_col])))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r, e, exact in batches(b.column(text_col)):
                data, n = exact.buf, np.diff(exact.first)
                part = b.slice(r, e - r)
                size = np.diff(exact.offs)
                row_of = lambda mask: np.add.reduceat(np.append(mask, False), np.minimum(exact.offs[:-1], len(mask)), dtype=np.int64) * (size > 0) if len(mask) else np.zeros(e - r, np.int64)  # noqa: E731, B023
                chars = row_of(~SPACE[data] & (data & 0xC0 != 0x80))
                symbols = row_of(SYMBOL[data])
                raw, offs = data.tobytes(), exact.offs.tolist()
                lines = [_dup_lines(raw[a:z]) for a, z in zip(offs[:-1], offs[1:], strict=True)]
                repeat = _repeat_words(exact)
                llr = _score(exact.lowered(), model.ratio)
                failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
                cols = [n, chars, symbols, lines, repeat, failed, ~failed & (llr >= model.threshold), llr]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *map(pa.array, cols)], names=[*carry, *MADE])

    return map_arrow(source, run, fields)
