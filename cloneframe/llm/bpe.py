"""BPE encoding and decoding with a contiguous rank array.

Of a tokenizers JSON file of word-end BPE: NFC, white space to blanks, lower case, a split pattern, bytes shown as
characters, merges by rank. A short word holds its parts' ids and, beside them, the rank of each pair of neighbours;
the least rank is looked up by a scan, its boundary is deleted, and the ranks at its sides are read anew. Long words
use the same rule with a heap, so their time stays near linear. The first ranks of a word come from a table of byte
pairs, and pieces of ASCII letters, with or without a mark behind them, need neither pattern nor normal form. Texts are split at ASCII white space, which ends
every word, and a bounded two-generation cache remembers the ids of the pieces: frequent ones move on, rare ones
go. Decoding joins the ids' tokens by one blank, as the library does for a file without a decoder.

Cases: null or empty text has no tokens (n_tokens 0, hashes of the empty string); special tokens of the file found in
a text are their own ids; repeated rows get equal results; an empty table gives an empty table; other columns are
carried where asked for.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re as plain
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SHORT = 128
NEVER = 1 << 60
GENERATION = 250_000
#: Parts of a split pattern by which a run of letters is one word, and a run of marks is one.
LETTERS, MARKS = r"|[\p{L}]+|", r"|[^\s\p{L}\p{N}]+"
LETTER = plain.compile(r"[A-Za-z]*.?").fullmatch
MARK = b".,;:!?"


def byte_characters() -> list[str]:
    """The character that shows each byte: itself where printable Latin-1, else the next free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Bpe:
    """Encoder and decoder of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.shown = {str(i).encode(): t.encode() for i, t in self.tokens.items()}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.made.append(vocab[a + b])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        chars = byte_characters()
        self.first = [vocab.get(c) for c in chars]
        self.last = [vocab.get(c + self.end) for c in chars]
        self.cut = plain.compile("(" + "|".join(map(plain.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.whole = None not in self.first and None not in self.last
        # ranks of two neighbouring bytes, inside a word and at its end
        self.inner, self.outer = ([[self.rank.get(a << 32 | b, NEVER) for b in after] for a in self.first] for after in (self.first, self.last)) if self.whole else ([], [])
        # letters are one word, and marks another, where the pattern says so and no special token is of letters
        self.letters = self.whole and LETTERS in pattern and pattern.endswith(MARKS) and not any(map(LETTER, self.special))
        self.number = {i: b"%d" % i for i in self.tokens}
        self.word_ids: dict[str, list[int]] = {}
        self.pieces = _Pieces(self.piece)

    def _of_bytes(self, data: bytes) -> list[int]:
        if not self.whole:
            ids = [x for x in [*(self.first[b] for b in data[:-1]), self.last[data[-1]]] if x is not None]
            return self._short(ids) if len(ids) <= SHORT else self._long(ids)
        first, inner = self.first, self.inner
        ids = [first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if len(ids) > SHORT:
            return self._long(ids)
        ranks = [inner[a][b] for a, b in zip(data, data[1:])]  # noqa: B905
        if ranks:
            ranks[-1] = self.outer[data[-2]][data[-1]]
        return self._short(ids, ranks)

    def _short(self, ids: list[int], ranks: list[int] | None = None) -> list[int]:
        rank, made = self.rank, self.made
        if ranks is None:
            ranks = [rank.get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [made[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] << 32 | ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 32 | ids[i], NEVER)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank.get(ids[x] << 32 | ids[y], NEVER)) != NEVER:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        """Ids of one word of the split pattern."""
        found = self.word_ids.get(word)
        if found is None:
            data = word.encode()
            found = self._of_bytes(data)
            if len(data) <= SHORT:
                if len(self.word_ids) >= GENERATION:
                    self.word_ids.clear()
                self.word_ids[word] = found
        return found

    def ids(self, text: str) -> list[int]:
        """Ids of any text."""
        out: list[int] = []
        for part in self.cut(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = part.lower() if part.isascii() else "".join([c.lower() for c in part])
                for w in self.words(part):
                    out += self.word(w)
        return out

    def piece(self, piece: bytes) -> bytes:
        if self.letters:
            if piece.isalpha():
                return b" ".join([self.number[i] for i in self._of_bytes(piece.lower())])
            if piece[:-1].isalpha() and piece[-1] in MARK:
                return self.pieces[piece[:-1]] + b" " + self.pieces[piece[-1:]]
        return b" ".join([self.number[i] for i in self.ids(piece.decode())])

    def encode(self, text: str | None) -> bytes:
        """Decimal ids joined by one blank."""
        return b" ".join(filter(None, map(self.pieces.__getitem__, (text or "").encode().split())))

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.shown.__getitem__, ids.split()))


class _Pieces(dict):
    def __init__(self, encode):
        self.make, self.old = encode, {}

    def __missing__(self, piece: bytes) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= SHORT:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


_FILES: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """One per Python process."""
    if path not in _FILES:
        _FILES[path] = Bpe(path)
    return _FILES[path]


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_values: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256; with_values also ids (array of int) and decoded. tokenizer: path
    of the file on every executor."""
    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == id_col)
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_values]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_values

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer)
        for b in it:
            n, shown, back, ids, decoded = [], [], [], [], []
            for text in b.column(1):
                e = coder.encode(text.as_py())
                d = coder.decode(e)
                n.append(e.count(b" ") + 1 if e else 0)
                shown.append(hashlib.sha256(e).hexdigest())
                back.append(hashlib.sha256(d).hexdigest())
                if with_values:
                    ids.append([int(x) for x in e.split()])
                    decoded.append(d.decode())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_values else [])], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
