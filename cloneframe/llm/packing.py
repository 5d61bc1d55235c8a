"""Sum-of-squares online packing of tokenised documents into sequences.

A document's tokens (its ids and one closing id) fill whole sequences first; the rest, shorter than a sequence, is
placed at once by the sum-of-squares rule. N[h] counts the sequences filled up to level h; among a new sequence and
the levels that still take the piece, the one wins after which the sum of N[h]**2 over partly filled levels is least,
the fullest of equal ones. That keeps few sequences open at any level, so a task holds the level array and the open
sequences alone, whatever the number of documents. When a task's documents end, what is still open is joined and cut
into full sequences, and the last remainder into lengths that are powers of two, which need no padding.

Tasks pack what they read, without a shuffle; sequence_id holds the task's number above 2**33.

Cases: null or empty text is one piece of the closing id alone; ties and repeated rows are pieces of their own; any
text length is cut as above; an empty table gives an empty table; further columns are not carried.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cloneframe.llm.bpe import byte_characters

ID_BYTES = 4
TASK_BITS = 33

# Fixed value: the byte-level pre-tokenizer's split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts, equal to the tokenizers library's for a byte-level BPE file. The file's vocabulary also serves as
    ranks for the tiktoken library, which is faster; it gets texts of characters whose classes are the same in every
    version of Unicode. Texts with others, or that may hold a special token go to tokenizers."""

    other = re.compile(r"[^\x00-\u024f\u0391-\u03c9\u0410-\u044f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3]").search

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = [t[:2] for t in special]
        self.fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bool:
        if any(t in text for t in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not self.other(text)
        return True

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.plain(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # its pattern's stack does not hold a run of millions of blanks
                pass
        return self.whole(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """add() places a document; rows of closed sequences gather in done: (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int = 0):
        self.capacity = capacity
        self.next = first_sequence
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(capacity + 1)]
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids, total, self.next, offset))
            offset += len(ids) // ID_BYTES
        self.next += 1

    def _level(self, size: int) -> int:
        """The level to fill up; 0 for a new sequence."""
        c, n = self.capacity, self.levels
        after = n[size + 1 : c + 1].copy()  # of levels 1.. c - size; the full level counts nothing
        after[-1:] = 0
        now = n[1 : c - size + 1]
        change = np.where(now > 0, 2 * (after - now) + 2, np.iinfo(np.int64).max)
        if len(change) and now[-1] > 0:
            change[-1] = 1 - 2 * now[-1]
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
        return best + 1 if best >= 0 and change[best] <= 2 * n[size] + 1 else 0

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // ID_BYTES
        c = self.capacity
        start = 0
        while total - start >= c:
            self._close([(doc, start, ids[start * ID_BYTES : (start + c) * ID_BYTES], total)])
            start += c
        if start == total:
            return
        size = total - start
        piece = (doc, start, ids[start * ID_BYTES :], total)
        at = self._level(size)
        if at:
            pieces = self.open[at].pop()
            self.levels[at] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if at + size == c:
            self._close(pieces)
        else:
            self.open[at + size].append(pieces)
            self.levels[at + size] += 1

    def finish(self) -> None:
        """Close what is open: joined, cut into full sequences, the remainder into powers of two."""
        rest = [p for level in reversed(self.open) for pieces in level for p in pieces]
        self.open, self.levels[:] = [[] for _ in self.open], 0
        left = sum(len(p[2]) // ID_BYTES for p in rest)
        now: list[tuple] = []
        room = 0
        for doc, start, ids, total in rest:
            while ids:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= room
                take = min(room, len(ids) // ID_BYTES)
                now.append((doc, start, ids[: take * ID_BYTES], total))
                ids, start, room = ids[take * ID_BYTES :], start + take, room - take
                if not room:
                    self._close(now)
                    now = []


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, closing_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (long), and ids (binary,
    little-endian 32-bit), if with_ids. tokenizer: path of a tokenizers JSON file on every executor."""
    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == id_col)
    closing = np.array([closing_id], "<u4").tobytes()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(capacity, TaskContext.get().partitionId() << TASK_BITS)
        id_type = None

        def out() -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*packer.done, strict=True)
            packer.done = []
            cols = [pa.array(doc, id_type), pa.array(start), pa.array([len(x) // ID_BYTES for x in ids]), pa.array(list(map(zlib.crc32, ids))), pa.array(total), pa.array(seq), pa.array(offset)]
            return pa.RecordBatch.from_arrays([*cols, *[pa.array(ids, pa.binary())] * with_ids], names=names)

        for b in it:
            id_type = b.column(0).type
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                packer.add(doc.as_py(), encode(text.as_py()) + closing)
                if len(packer.done) >= 4096:
                    yield out()
        packer.finish()
        if packer.done:
            yield out()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
