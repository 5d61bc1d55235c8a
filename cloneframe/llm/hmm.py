"""Hidden Markov language model over words, trained by Baum-Welch over all training documents.

Tokens are a text's words (A-Z lower-cased) and one end. A state emits one of `classes` word classes (a word's hash;
the end has its own), and a class emits its words in proportion to their smoothed corpus counts. So the latent part
has a fixed size, K states and K x classes shares, while word counts are exact and cover the whole vocabulary.

1. Each task turns what it reads into blocks of some million tokens: the block's distinct words once, most
   frequent first, and its documents as places in that list (small numbers mostly, so they compress to a fifth of
   the text). Blocks are written to the shared folder; all later steps read them, one block at a time.
2. Word counts: every block sends a row per distinct word with its training count. Counts are summed by word, and each
   block gets its words' sums back by a join. A block names a word once, so a frequent word costs a row a block; no
   step holds more than the words of one block.
3. Baum-Welch: each pass runs the scaled forward and backward recursions over every training document, many documents
   side by side, and sums expected starts, transitions and emissions; tasks send their sums, which add up to at most
   (classes + K + 2) rows. States start from the class shares of K training documents with the smallest hashes,
   mixed with the corpus's.
4. Scores: the forward recursion's scale factors give the exact likelihood of each sequence, times the words' shares
   in their classes.

Held out are documents whose crc32 of the id as text is 1 modulo 5. base_score is the smoothed unigram's.

Cases: null or empty text is the end alone; unseen words count as one further word of their class; a null id hashes
as empty text; repeated rows are documents of their own; without any training document N and V are 0, all words are
unseen and the states stay as they began; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneframe.llm.common import Scratch, keep
from cloneframe.llm.words import batches, mix, stream

BLOCK_TOKENS = 1_000_000
PART_TOKENS = 400_000
DELTA = 0.5  # added to each count
STICK = 0.98  # first chance to stay in a state


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # classes + 1 (the end) x K

    @property
    def states(self) -> int:
        return len(self.start)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def squeeze(places: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


BLOCK_SCHEMA = "block long, ids binary, held binary, lengths binary, vocab binary, tokens binary, n_train long, train_docs long"


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row per block. ids: int64 (0 where null) then a null flag each; tokens: places in vocab, without the ends."""

    def pack(block: int, parts: list[tuple]) -> pa.RecordBatch:
        ids = [i for p in parts for i in p[0]]
        held = np.array([held_out(i) for i in ids], np.uint8)
        lengths = np.concatenate([p[1] for p in parts]).astype("<i8")
        vocab, tokens, often = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        place = np.empty(len(vocab), np.uint32)
        place[order] = np.arange(len(vocab))
        vocab, tokens = vocab[order], place[tokens]
        known = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
        train = int((lengths[held == 0] + 1).sum())
        cols = [block, known, held.tobytes(), lengths.tobytes(), vocab.astype("<u8").tobytes(), squeeze(tokens), train, int((held == 0).sum())]
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in cols], names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for b in it:
            ids = b.column(0).to_pylist()
            for r, e, words in batches(b.column(1), lower=True):
                parts.append((ids[r:e], np.diff(words.first), words.hashes))
                size += len(words.hashes) + e - r
                if size >= BLOCK_TOKENS:
                    yield pack(block, parts)
                    block, parts, size = block + 1, [], 0
        if parts:
            yield pack(block, parts)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, BLOCK_SCHEMA)


@dataclass
class Block:
    """One row of blocks, read."""

    ids: list
    held: np.ndarray
    lengths: np.ndarray
    vocab: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        held = np.frombuffer(row["held"], np.uint8)
        n = len(held)
        raw = np.frombuffer(row["ids"][: 8 * n], "<i8").tolist()
        null = np.frombuffer(row["ids"][8 * n :], np.uint8)
        return cls([None if z else i for i, z in zip(raw, null, strict=True)], held, np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row.get("vocab", b""), "<u8"), unsqueeze(row["tokens"]))

    def train_counts(self) -> np.ndarray:
        use = np.repeat(self.held == 0, self.lengths)
        return np.bincount(self.tokens[use], minlength=len(self.vocab))


def word_class(vocab: np.ndarray, classes: int) -> np.ndarray:
    return (mix(vocab ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(40)).astype(np.int64) % classes


def _blocks_of(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for b in it:
        for i in range(b.num_rows):
            row = {k: v[0] for k, v in b.slice(i, 1).to_pydict().items()}
            yield row, Block.of(row)


def words_of(table: DataFrame) -> DataFrame:
    """word, block, n: row per distinct word of a block and its training count there."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks_of(it):
            yield pa.RecordBatch.from_arrays([pa.array(block.vocab.view(np.int64)), pa.array(np.full(len(block.vocab), row["block"], np.int64)), pa.array(block.train_counts())], names=["word", "block", "n"])

    return table.select("block", "held", "ids", "lengths", "vocab", "tokens").mapInArrow(send, "word long, block long, n long")


def _class_sums(totals: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Per class, training tokens and distinct training words. totals: word, total."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for b in it:
            cls, total = word_class(b.column(0).to_numpy().view(np.uint64), classes), b.column(1).to_numpy()
            n += np.bincount(cls, weights=total, minlength=classes).astype(np.int64)
            d += np.bincount(cls[total > 0], minlength=classes)
        full = np.flatnonzero(d)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(d[full])], names=["class", "n", "d"])

    rows = totals.select("word", "total").mapInArrow(run, "class long, n long, d long").groupBy("class").agg(F.sum("n"), F.sum("d")).collect()  # a row per class
    n, d = np.zeros(classes), np.zeros(classes)
    for r in rows:
        n[r[0]], d[r[0]] = r[1], r[2]
    return n, d


def _time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents in descending length: (documents that have a token at each time, place of each document token)."""
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(int(lengths[0])), "right")
    begin = np.cumsum(alive) - alive
    t = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return alive, begin[t] + np.repeat(np.arange(len(lengths)), lengths)


def _parts(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Documents in descending length, in runs of about PART_TOKENS tokens."""
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order])
    a = 0
    while a < len(order):
        e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART_TOKENS, "right")))
        yield order[a:e]
        a = e


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def forward(model: Hmm, alive: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables and their scale factors, of time-major emission shares b (tokens x K)."""
    alpha, scale = np.empty_like(b), np.empty(len(b), b.dtype)
    move = model.move.astype(b.dtype)
    before, at = None, 0
    for n in alive.tolist():
        a = (before[:n] @ move if before is not None else model.start.astype(b.dtype)) * b[at : at + n]
        s = a.sum(1)
        a /= s[:, None]
        alpha[at : at + n], scale[at : at + n] = a, s
        before, at = a, at + n
    return alpha, scale


def expect(model: Hmm, alive: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected (starts K, transitions K x K, emissions classes x K) of time-major documents."""
    b = model.emit[cls]
    alpha, scale = forward(model, alive, b)
    k = model.states
    move = model.move.astype(b.dtype)
    gamma = alpha  # times the backward variables, in place
    pairs = np.zeros((k, k))
    begin = np.cumsum(alive) - alive
    beta = np.ones((0, k), b.dtype)
    for t in range(len(alive) - 1, -1, -1):
        n, at = int(alive[t]), int(begin[t])
        if len(beta):
            m = len(beta)
            nxt = b[at + n : at + n + m] * beta / scale[at + n : at + n + m, None]
            pairs += alpha[at : at + m].T @ nxt
            back = nxt @ move.T
            if m < n:
                back = np.concatenate([back, np.ones((n - m, k), b.dtype)])
        else:
            back = np.ones((n, k), b.dtype)
        beta = back
        gamma[at : at + n] *= beta
    emissions = np.stack([np.bincount(cls, weights=gamma[:, i], minlength=len(model.emit)) for i in range(k)], 1)
    return gamma[: alive[0]].sum(0).astype(float), pairs * model.move, emissions


def _stats(table: DataFrame, model: Hmm, classes: int) -> np.ndarray:
    """Expected counts over all training documents: rows of classes + 1 emissions, K transitions, 1 starts; K columns."""
    k = model.states
    names = [f"c{i}" for i in range(k)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes + 1 + k + 1, k))
        for _, block in _blocks_of(it):
            of_word = word_class(block.vocab, classes)
            first = np.cumsum(block.lengths) - block.lengths
            docs = np.flatnonzero(block.held == 0)
            for part in _parts(block.lengths[docs] + 1):
                d = docs[part]
                alive, place = _time_major(block.lengths[d] + 1)
                cls = np.empty(len(place), np.int64)
                cls[place] = _with_end(of_word[block.tokens[_gather(first[d], block.lengths[d])]], block.lengths[d], classes)
                starts, pairs, emissions = expect(model, alive, cls)
                total[: classes + 1] += emissions
                total[classes + 1 : -1] += pairs
                total[-1] += starts
        full = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(total[full, i]) for i in range(k))], names=["row", *names])

    sums = table.select("block", "held", "ids", "lengths", "vocab", "tokens").mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in names)).groupBy("row").agg(*(F.sum(c) for c in names))
    out = np.zeros((classes + 1 + k + 1, k))
    for r in sums.collect():  # at most classes + K + 2 rows
        out[r[0]] = r[1:]
    return out


def _with_end(cls: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Each document's classes, followed by the end's."""
    return np.insert(cls, np.cumsum(lengths), end)


def _shares(counts_: np.ndarray, corpus: np.ndarray, prior: float) -> np.ndarray:
    """Emission shares (classes x K) of expected counts, smoothed with the corpus's shares."""
    return ((counts_ + prior * corpus[:, None]) / (counts_.sum(0) + prior)).astype(np.float32)


def _begin(table: DataFrame, corpus: np.ndarray, states: int, classes: int, least: int = 200) -> Hmm:
    """States from the classes of the training documents with the smallest id hashes, of `least` tokens or more."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for _, block in _blocks_of(it):
            of_word = word_class(block.vocab, classes)
            first = np.cumsum(block.lengths) - block.lengths
            fit = np.flatnonzero((block.held == 0) & (block.lengths >= least))
            h = mix(np.array([0 if block.ids[i] is None else block.ids[i] for i in fit], np.int64).view(np.uint64) + np.uint64(99))
            for j in np.argsort(h, kind="stable")[:states].tolist():
                d = fit[j]
                seen = np.bincount(of_word[block.tokens[first[d] : first[d] + block.lengths[d]]], minlength=classes + 1)
                best.append((int(h[j] >> np.uint64(1)), squeeze(seen)))
            best = sorted(best)[:states]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.binary())], names=["h", "seen"])

    seeds = table.select("block", "held", "ids", "lengths", "vocab", "tokens").mapInArrow(run, "h long, seen binary")
    scratch = Scratch(table.sparkSession)
    seeds = scratch.put("seeds", seeds)
    first = [r[0] for r in seeds.select("h").orderBy("h").limit(states).collect()]
    seeds = seeds.filter(F.col("h") <= max(first, default=-1)).orderBy("h").collect()[:states]  # `states` rows, but for equal hashes
    scratch.drop()
    emit = np.tile(corpus[:, None], (1, states)).astype(float)
    noise = 1 + 0.2 * (stream(8, emit.size).reshape(emit.shape).astype(float) / 2.0**64 - 0.5)
    emit *= noise
    for i, row in enumerate(seeds):
        seen = unsqueeze(row[1]).astype(float)
        emit[:, i] = 0.5 * emit[:, i] + 0.5 * seen / seen.sum()
    emit /= emit.sum(0)
    move = np.full((states, states), (1 - STICK) / max(1, states - 1))
    np.fill_diagonal(move, STICK if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emit.astype(np.float32))


def train(table: DataFrame, corpus: np.ndarray, states: int, classes: int, passes: int, prior: float) -> Hmm:
    """Baum-Welch; corpus: smoothed class shares, the end's last."""
    model = _begin(table, corpus, states, classes)
    for _ in range(passes):
        s = _stats(table, model, classes)
        if not s[-1].sum():
            break
        move = s[classes + 1 : -1] + 0.1
        start = s[-1] + 0.1
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), _shares(s[: classes + 1], corpus, prior))
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 8, classes: int = 1 << 15, passes: int = 3, prior: float = 2000.0, tasks: int = 20_000) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) per row of docs. Blocks are scored one after
    another in at most `tasks` tasks."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    table = scratch.put("blocks", blocks(docs, id_col, text_col))
    many, n_train, train_docs = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("train_docs"), F.lit(0))).first()
    sent = scratch.put("words", words_of(table))
    totals = scratch.put("totals", sent.groupBy("word").agg(F.sum("n").alias("total")))
    in_class, distinct = _class_sums(totals, classes)
    v = float(distinct.sum()) + (train_docs > 0)
    mass = np.append(in_class + DELTA * (distinct + 1), train_docs + DELTA)  # of a class; the last is the end's
    model = train(table, mass / mass.sum(), states, classes, passes, prior)

    base_end = np.log10((train_docs + DELTA) / (n_train + DELTA * (v + 1)))
    end_known = int(train_docs > 0)
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    slim = ["block", "held", "ids", "lengths", "tokens", "place"]

    def slimmed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word's place in ascending order instead of the word itself."""
        for row, block in _blocks_of(it):
            place = np.empty(len(block.vocab), np.uint32)
            place[np.argsort(block.vocab)] = np.arange(len(block.vocab))
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in [*(row[k] for k in slim[:5]), squeeze(place)]], names=slim)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = {k: v[0] for k, v in left.to_pydict().items()}
        block = Block.of(row)
        word, total = (right.column(c).to_numpy() for c in ("word", "total"))
        order = np.argsort(word.view(np.uint64))[unsqueeze(row["place"])]
        of_word, c = word_class(word.view(np.uint64)[order], classes), total[order]
        word_base = np.log10((c + DELTA) / (n_train + DELTA * (v + 1)))
        word_share = np.log10((c + DELTA) / mass[of_word])
        n = len(block.lengths)
        doc = np.repeat(np.arange(n), block.lengths)
        known = np.bincount(doc, weights=c[block.tokens] > 0, minlength=n).astype(np.int64) + end_known
        base = np.bincount(doc, weights=word_base[block.tokens], minlength=n) + base_end
        score = np.bincount(doc, weights=word_share[block.tokens], minlength=n).astype(float)
        first = np.cumsum(block.lengths) - block.lengths
        for d in _parts(block.lengths + 1):
            alive, place = _time_major(block.lengths[d] + 1)
            cls = np.empty(len(place), np.int64)
            cls[place] = _with_end(of_word[block.tokens[_gather(first[d], block.lengths[d])]], block.lengths[d], classes)
            _, scale = forward(model, alive, model.emit[cls])
            logs = np.log10(scale.astype(float))[place]
            score[d] += np.add.reduceat(logs, np.cumsum(block.lengths[d] + 1) - (block.lengths[d] + 1))
        cols = [pa.array(block.ids, pa.int64()), pa.array(block.held == 1), pa.array(block.lengths + 1), pa.array(known), pa.array(np.full(n, n_train)), pa.array(base), pa.array(score)]
        return pa.table(cols, names=names)

    whole = table.select("block", "held", "ids", "lengths", "vocab", "tokens").mapInArrow(slimmed, "block long, held binary, ids binary, lengths binary, tokens binary, place binary")
    met = scratch.put("met", sent.select("word", "block").join(totals, "word").select("block", "word", "total"))
    scratch.drop("words", "totals")
    tasks = max(1, min(many, tasks))
    meet = whole.repartition(tasks, "block").groupBy("block").cogroup(met.repartition(tasks, "block").groupBy("block"))
    out = meet.applyInArrow(run, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = keep(out)
    scratch.drop()
    return out
