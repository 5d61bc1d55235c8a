"""Substring dedup by level-wise doubling.

Windows of `words` words that occur twice or more are found level by level. Level one takes windows of a quarter
of the length, at one anchor per full window: the minimum hash among the quarter windows inside it, which depends
on the window's words alone, so equal full windows choose equal anchors. Anchors that occur once die. The others
are extended to twice the length, to the left and to the right; a full window lives on while each double window
inside it is repeated. Survivors are extended to the whole run of full windows that chose the anchor: a repeated
run is settled at once, and what is left (the ends of passages) is judged window by window, against every other
full window with the same anchor. A level's candidates are the survivors of the one below, so each level moves
less than the last, and no level groups rows: keys are counted with map-side combine and joined back, which
splits hot keys.

Cases: null or empty text has no words (n_words 0, text kept as it is); texts below `words` words are never
changed; a window that repeats inside one document counts as repeated, overlapping or not; equal rows remove each
other's windows; an empty table gives an empty table; further columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneframe.llm.common import Scratch, fresh, keep, map_arrow, repeated, row_key
from cloneframe.llm.words import Prefix, Words, batches

SPAN_BITS = 12  # window spans fit in so many bits; see loc
MAX_WORDS = 1 << SPAN_BITS


def _argmin(g: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of every w values on end, by doubling."""
    at = np.arange(len(g))
    size = 1
    while size * 2 <= w:
        a, b = at[:-size], at[size:]
        at = np.where(g[a] <= g[b], a, b)
        size *= 2
    if size < w:
        a, b = at[: len(at) - (w - size)], at[w - size :]
        at = np.where(g[a] <= g[b], a, b)
    return at


def _runs(words: Words, size: int, quarter: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, row) of the windows that chose each anchor."""
    n = len(words.hashes)
    if n < size:
        return (np.zeros(0, np.int64),) * 4
    rows = words.rows
    valid = rows[size - 1 :] == rows[: n - size + 1]
    at = _argmin(Prefix(words.hashes).windows(quarter), size - quarter + 1)[valid]
    p = np.flatnonzero(valid)
    r = rows[p]
    head = np.ones(len(p), bool)
    head[1:] = (at[1:] != at[:-1]) | (r[1:] != r[:-1])
    h = np.flatnonzero(head)
    last = np.append(h[1:], len(p)) - 1 if len(p) else h
    return at[h], p[h], p[last], r[h]


def _anchor_columns(words: Words, size: int) -> tuple[np.ndarray, ...]:
    quarter, half = -(-size // 4), -(-size // 2)
    a, p0, p1, row = _runs(words, size, quarter)
    pre = Prefix(words.hashes)
    begin, end = words.first[row], words.first[row + 1]
    left = np.maximum(a + quarter - half, begin)
    key = pre.of(a, a + quarter)
    hl = pre.of(left, a + quarter)
    hr = pre.of(a, np.minimum(a + half, end))
    hc = pre.of(p0, p1 + size) + (a - p0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    loc = ((a - begin) << (2 * SPAN_BITS)) | ((a - p0) << SPAN_BITS) | (p1 - p0)
    return row, key, hl, hr, hc, loc


def anchors(docs: DataFrame, size: int, text_col: str, row_col: str) -> DataFrame:
    """Row per anchor: rk, key (level one), hl and hr (level two), hc (the run), loc (anchor, reach back, run length)."""
    schema = pa.schema([(c, pa.int64()) for c in ("rk", "key", "hl", "hr", "hc", "loc")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rk = b.column(0).to_numpy()
            for r, _, words in batches(b.column(1)):
                row, *cols = _anchor_columns(words, size)
                if len(row):
                    yield pa.record_batch([pa.array(rk[r + row]), *(pa.array(c.view(np.int64)) for c in cols)], schema=schema)

    return docs.select(f"`{row_col}`", f"`{text_col}`").mapInArrow(run, "rk long, key long, hl long, hr long, hc long, loc long")


def _windows(joined: DataFrame, size: int) -> DataFrame:
    """Row per full window of the given anchors (rk, text, list): key, h, rk, p, judge (false: there to be met only)."""
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("rk", pa.int64()), ("p", pa.int64()), ("judge", pa.bool_())])
    quarter, half = -(-size // 4), -(-size // 2)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rk, lists = b.column(0).to_numpy(), b.column(2)
            for r, e, words in batches(b.column(1)):
                part = lists.slice(r, e - r)
                row = np.repeat(np.arange(e - r), np.diff(part.offsets.to_numpy()))
                flat = part.flatten()
                loc, ok = flat.field("loc").to_numpy(), flat.field("ok").to_numpy()
                begin = words.first[row]
                a = (loc >> (2 * SPAN_BITS)) + begin
                p0 = a - ((loc >> SPAN_BITS) & (MAX_WORDS - 1))
                n = (loc & (MAX_WORDS - 1)) + 1
                at = np.repeat(np.arange(len(loc)), n)
                p = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + p0[at]
                live = ((p < a[at] + half - size) | (ok[at] & 2 > 0)) & ((p > a[at] + quarter - half) | (ok[at] & 1 > 0))
                at, p = at[live], p[live]
                pre = Prefix(words.hashes)
                cols = [pre.of(a[at], a[at] + quarter).view(np.int64), pre.of(p, p + size).view(np.int64), rk[r + row[at]], p - begin[at]]
                yield pa.record_batch([*map(pa.array, cols), pa.array(ok[at] & 4 == 0)], schema=schema)

    return joined.select("rk", "text", "list").mapInArrow(run, "key long, h long, rk long, p long, judge boolean")


def repeated_spans(docs: DataFrame, size: int = 35, text_col: str = "text", row_col: str = "rk") -> DataFrame:
    """Word spans covered by repeated windows: rk, spans (start, length; they may overlap). docs' row_col is of common.row_key."""
    if not 4 <= size < MAX_WORDS:
        raise ValueError(f"size must be from 4 to {MAX_WORDS - 1}")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    back = F.expr(f"shiftright(loc, {SPAN_BITS}) & {MAX_WORDS - 1}")
    begin = F.expr(f"shiftright(loc, {2 * SPAN_BITS})") - back
    run = F.expr(f"loc & {MAX_WORDS - 1}")

    level = anchors(docs, size, text_col, row_col)
    # keys are written before the joins: a join whose sides are plain exchanges can split a hot key's rows
    level = scratch.put("quarter", level.join(scratch.put("keys", repeated(level, "key")), "key", "left_semi"))
    two = level
    for c, ok in (("hl", "okl"), ("hr", "okr")):
        two = two.join(scratch.put(c, repeated(level, c)).withColumn(ok, F.lit(True)), c, "left")
    quarter, half = -(-size // 4), -(-size // 2)
    # a window starts `back` to 0.. before its anchor; with neither double window repeated inside reach, none lives
    reach_left, reach_right = back >= half - quarter, (back - run) <= size - half
    two = two.filter((F.col("okl") & reach_left) | (F.col("okr") & reach_right))
    two = scratch.put("half", two.select("rk", "key", "hc", "loc", (F.when(F.col("okl"), 1).otherwise(0) + F.when(F.col("okr"), 2).otherwise(0)).cast("long").alias("ok")))
    scratch.drop("quarter", "keys", "hl", "hr")
    three = scratch.put("full", two.join(scratch.put("runs", repeated(two, "hc")).withColumn("settled", F.lit(True)), "hc", "left").select("rk", "key", "hc", "loc", "ok", F.coalesce("settled", F.lit(False)).alias("settled")))
    scratch.drop("half", "runs")

    open_ = three.filter("not settled").select("rk", "key", "loc", "ok")
    met = three.filter("settled").groupBy("hc").agg(F.min(F.struct("rk", "loc", "ok", "key")).alias("m")).select("m.*")
    met = met.join(open_.select("key").distinct(), "key", "left_semi").select("rk", "loc", F.expr("ok + 4").cast("long").alias("ok"))
    asked = open_.select("rk", "loc", "ok").unionByName(met).distinct()
    asked = asked.groupBy("rk").agg(F.collect_list(F.struct("loc", "ok")).alias("list"))
    one = docs.select(F.col(f"`{row_col}`").alias("rk"), F.col(f"`{text_col}`").alias("text")).join(asked, "rk")
    win = scratch.put("windows", _windows(one, size))
    hits = win.filter("judge").join(scratch.put("twice", repeated(win, "key", "h")), ["key", "h"], "left_semi").select("rk", F.col("p").alias("start"), F.lit(size).cast("long").alias("length"))
    runs = three.filter("settled").select("rk", begin.alias("start"), (run + size).alias("length"))
    spans = hits.unionByName(runs).groupBy("rk").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    out = keep(spans)
    scratch.drop()
    return out


def _cover(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:n]) > 0


def remove_repeats(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut to the words outside repeated windows (joined by one space where anything goes; else as
    it was), and n_words, n_removed (long), kept_sha256 (of the kept words joined by one space)."""
    made = ["n_words", "n_removed", "kept_sha256"]
    if clash := set(made) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are made here; rename yours")
    names = [c for c in docs.columns if c != text_col]
    rk, spans_col = fresh(docs, "rk"), fresh(docs, "spans")
    keyed = docs.withColumn(rk, row_key(id_col, text_col))
    joined = keyed.join(repeated_spans(keyed, size, text_col, rk).withColumnsRenamed({"rk": rk, "spans": spans_col}), rk, "left")
    kinds = {f.name: f for f in docs.schema}
    fields = [*((c, kinds[c].dataType.simpleString()) for c in names), (text_col, "string"), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r, e, words in batches(b.column(text_col)):
                part, spans = b.slice(r, e - r), b.column(spans_col).slice(r, e - r)
                source = part.column(text_col)
                n = np.diff(words.first)
                text, gone, sha = [], [], []
                data = words.buf.tobytes()
                for i in range(e - r):
                    w0, w1 = int(words.first[i]), int(words.first[i + 1])
                    lo, hi = (int(words.starts[w0]), int(words.ends[w1 - 1])) if w1 > w0 else (0, 0)
                    tokens = data[lo:hi].split()
                    found = spans[i].values if spans[i].is_valid else None
                    out = np.zeros(0, bool) if found is None else _cover(w1 - w0, found.field("start").to_numpy(), found.field("length").to_numpy())
                    if out.any():
                        tokens = [t for t, o in zip(tokens, out.tolist(), strict=True) if not o]
                    kept = b" ".join(tokens)
                    gone.append(int(out.sum()))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    text.append(kept.decode() if gone[-1] else source[i].as_py())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=[*names, text_col, *made])

    return map_arrow(joined.select(*(f"`{c}`" for c in [*names, text_col, spans_col])), run, fields)
