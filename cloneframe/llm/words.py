"""Words of UTF-8 texts as arrays: byte ranges and 64-bit hashes, without a Python object per word.

A word is a maximal run outside \\x20 and \\x09-\\x0D. Hashes are polynomials over a fixed random byte table
modulo 2**64, finished by an invertible mixer; windows of words are hashed the same way over word hashes.
Texts pass through in pieces of about PIECE bytes, so temporary arrays stay small however large a batch is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTES = stream(1, 256)
BASES = {"byte": 0x9E3779B97F4A7C13, "word": 0xD1342543DE82EF93}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        out = []
        for b in (BASES[kind], pow(BASES[kind], -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _POWERS[kind] = (out[0], out[1])
    return _POWERS[kind]


@dataclass
class Words:
    """buf, offs: the rows' bytes; starts, ends: byte ranges; hashes: of each word; first: index of the first word of
    each row, and the end."""

    buf: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def lowered(self) -> Words:
        """The same words with A-Z lower-cased."""
        return replace(self, hashes=_hashes(LOWER[self.buf], self.starts, self.ends))


def texts(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "").cast(pa.large_string())
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about PIECE bytes, one row at least."""
    r, n = 0, len(offs) - 1
    while r < n:
        e = max(r + 1, int(np.searchsorted(offs, offs[r] + PIECE, "right")) - 1)
        yield r, min(e, n)
        r = min(e, n)


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    hashes = np.empty(len(starts), U64)
    w = 0
    while w < len(starts):  # long rows go in pieces cut between words
        e = max(w + 1, int(np.searchsorted(ends, starts[w] + PIECE, "right")))
        lo, hi = int(starts[w]), int(ends[e - 1])
        up, down = powers("byte", hi - lo)
        s = np.zeros(hi - lo + 1, U64)
        np.cumsum(BYTES[buf[lo:hi]] * up[: hi - lo], out=s[1:])
        a, b = starts[w:e] - lo, ends[w:e] - lo
        hashes[w:e] = mix((s[b] - s[a]) * down[a] + (b - a).astype(U64))
        w = e
    return hashes


def split(buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> Words:
    """The words of rows buf[offs[i]:offs[i+1]]."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(buf, offs, z, z, np.zeros(0, U64), np.zeros(len(offs), np.int64))
    if lower:
        buf = LOWER[buf]
    solid = ~SPACE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1] | cut[1:-1]
    tail[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return Words(buf, offs, starts, ends, _hashes(buf, starts, ends), np.searchsorted(starts, offs))


def batches(array: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for pieces of a string array; words' rows count from the first row."""
    buf, offs = texts(array)
    for r, e in pieces(offs):
        yield r, e, split(buf[offs[r] : offs[e]], offs[r : e + 1] - offs[r], lower)


class Prefix:
    """Hashes of any run of words in constant time."""

    def __init__(self, hashes: np.ndarray, kind: str = "word"):
        self.up, self.down = powers(kind, len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, U64)
        np.cumsum(hashes * self.up[: len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def windows(self, k: int) -> np.ndarray:
        """Of every k words on end; those across rows are for the caller to leave out."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + U64(k))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of each row's k-word windows; a row with fewer words, but one at least, has its whole sequence."""
    n = np.diff(words.first)
    p = Prefix(words.hashes)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], count)
    return p.of(start, np.minimum(start + k, np.repeat(words.first[1:], count))), first
