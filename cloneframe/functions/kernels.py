"""Sequence kernels for small groups, in NumPy and plain Python; called from Arrow-backed group functions."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable, Sequence

import numpy as np

# Scores of the affine alignment, and the order and thresholds of the column consensus.
MATCH, MISMATCH, OPEN, EXTEND = 1, -3, -6, -1
ORDER, RAGGED, ACTIVE = "-ACGTN", 10, 0.05
FIRST_SAMPLE, LAST_SAMPLE = 200, 1600


def align(ref: str, query: str, mismatch: int = MISMATCH) -> tuple[str, str, int, int]:
    """(ref row, query row, score, errors) of the global alignment with affine gaps; the first gap base costs OPEN."""
    n, m = len(ref), len(query)
    low = -(10**9)
    a, b = np.frombuffer(ref.encode(), np.uint8), np.frombuffer(query.encode(), np.uint8)
    if n == m and (wrong := int((a != b).sum())) * (MATCH - mismatch) < MATCH - 2 * OPEN:
        # with gaps, one at least in either row, a pair is lost; so few mismatches cost less
        return ref, query, n * MATCH + wrong * (mismatch - MATCH), wrong
    best = np.full((3, n + 1, m + 1), low, np.int64)  # 0: pair, 1: gap in query, 2: gap in ref
    best[0, 0, 0] = 0
    steps_n, steps_m = np.arange(1, n + 1), np.arange(1, m + 1)
    best[1, 1:, 0] = OPEN + (steps_n - 1) * EXTEND
    best[2, 0, 1:] = OPEN + (steps_m - 1) * EXTEND
    for i in range(1, n + 1):
        pair = np.where(b == a[i - 1], MATCH, mismatch)
        best[0, i, 1:] = best[:, i - 1, :-1].max(0) + pair
        best[1, i, 1:] = np.maximum(best[[0, 2], i - 1, 1:].max(0) + OPEN, best[1, i - 1, 1:] + EXTEND)
        # a gap in ref opens at an earlier place of this row: a running maximum after taking out the extension
        opening = best[:2, i, :-1].max(0) + OPEN - EXTEND * np.arange(m)
        best[2, i, 1:] = np.maximum.accumulate(opening) + EXTEND * np.arange(m)
    i, j, k = n, m, int(best[:, n, m].argmax())
    score = int(best[k, n, m])
    left, right = [], []
    while i or j:
        now = best[k, i, j]
        if k == 0:
            i, j = i - 1, j - 1
            left.append(ref[i])
            right.append(query[j])
            want = now - (MATCH if ref[i] == query[j] else mismatch)
            k = next(x for x in range(3) if best[x, i, j] == want)
        elif k == 1:
            i -= 1
            left.append(ref[i])
            right.append("-")
            k = 1 if best[1, i, j] + EXTEND == now and i > 0 else next((x for x in (0, 2) if best[x, i, j] + OPEN == now), 0)
        else:
            j -= 1
            left.append("-")
            right.append(query[j])
            k = 2 if best[2, i, j] + EXTEND == now and j > 0 else next((x for x in (0, 1) if best[x, i, j] + OPEN == now), 0)
    x, y = "".join(reversed(left)), "".join(reversed(right))
    return x, y, score, sum(p != q for p, q in zip(x, y, strict=True))


def align_many(refs: Sequence[str], queries: Sequence[str], mismatch: int = MISMATCH, most: int = 2_000_000) -> list[tuple[str, str, int, int]]:
    """align of each pair, many at a time: tables of pairs of like lengths are filled and walked back together, as many
    as have `most` cells. A cell depends on those above and to its left, so what pads a shorter pair is never read."""
    out: list = [None] * len(refs)
    rest = []
    for i, (a, b) in enumerate(zip(refs, queries, strict=True)):
        if len(a) == len(b) and a.isascii() and b.isascii():
            x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
            if (wrong := int((x != y).sum())) * (MATCH - mismatch) < MATCH - 2 * OPEN:
                out[i] = (a, b, len(a) * MATCH + wrong * (mismatch - MATCH), wrong)
                continue
        if a.isascii() and b.isascii() and a and b:
            rest.append(i)
        else:
            out[i] = align(a, b, mismatch)
    rest.sort(key=lambda i: (len(refs[i]), len(queries[i])))
    while rest:
        cells = lambda i: 3 * (len(refs[i]) + 1) * (max(len(queries[i]), len(queries[rest[0]])) + 1)
        n = next((k for k in range(1, len(rest)) if (k + 1) * cells(rest[k]) > most), len(rest))
        part, rest = rest[:n], rest[n:]
        for i, made in zip(part, _align_block([refs[i] for i in part], [queries[i] for i in part], mismatch), strict=True):
            out[i] = made
    return out


def _grid(texts: Sequence[str], fill: bytes) -> np.ndarray:
    wide = max(map(len, texts))
    return np.frombuffer(b"".join(t.encode().ljust(wide, fill) for t in texts), np.uint8).reshape(len(texts), wide)


def _align_block(refs: Sequence[str], queries: Sequence[str], mismatch: int) -> list[tuple[str, str, int, int]]:
    """align, step by step, of all pairs at once."""
    size, a, b = len(refs), _grid(refs, b"\0"), _grid(queries, b"\1")
    n, m = a.shape[1], b.shape[1]
    best = np.full((n + 1, 3, size, m + 1), -(10**8), np.int32)
    best[0, 0, :, 0] = 0
    best[1:, 1, :, 0] = (OPEN + np.arange(n) * EXTEND)[:, None]
    best[0, 2, :, 1:] = OPEN + np.arange(m) * EXTEND
    slope = (EXTEND * np.arange(m)).astype(np.int32)
    for i in range(1, n + 1):
        up, now = best[i - 1], best[i]
        now[0, :, 1:] = np.maximum(np.maximum(up[0, :, :-1], up[1, :, :-1]), up[2, :, :-1]) + np.where(b == a[:, i - 1 : i], np.int32(MATCH), np.int32(mismatch))
        now[1, :, 1:] = np.maximum(np.maximum(up[0, :, 1:], up[2, :, 1:]) + OPEN, up[1, :, 1:] + EXTEND)
        opening = np.maximum(now[0, :, :-1], now[1, :, :-1]) + (OPEN - EXTEND * np.arange(m)).astype(np.int32)
        now[2, :, 1:] = np.maximum.accumulate(opening, axis=1) + slope
    at, i, j = np.arange(size), np.array(list(map(len, refs))), np.array(list(map(len, queries)))
    k = best[i, :, at, j].argmax(1)
    score = best[i, k, at, j]
    steps = n + m
    left, right = np.zeros((size, steps), np.uint8), np.zeros((size, steps), np.uint8)
    place = np.full(size, steps)
    while len(live := np.flatnonzero((i > 0) | (j > 0))):
        u, v, w = i[live], j[live], k[live]
        now = best[u, w, live, v]
        place[live] -= 1
        x, y = np.where(w == 2, 45, a[live, u - 1]), np.where(w == 1, 45, b[live, v - 1])
        left[live, place[live]], right[live, place[live]] = x, y
        u, v = u - (w != 2), v - (w != 1)
        i[live], j[live] = u, v
        back = best[u, :, live, v]
        # the state before: of a pair the first with the score; of a gap the gap itself, else the first that opens it
        same = back == np.where(w == 0, now - np.where(x == y, MATCH, mismatch), now - OPEN)[:, None]
        gap = (w > 0) & (back[np.arange(len(live)), w] + EXTEND == now) & np.where(w == 1, u > 0, v > 0)
        same[np.arange(len(live)), w] &= w == 0
        k[live] = np.where(gap, w, same.argmax(1))
    out = []
    wrong = (left != right).sum(1)
    for s in range(size):
        p = int(place[s])
        out.append((left[s, p:].tobytes().decode(), right[s, p:].tobytes().decode(), int(score[s]), int(wrong[s])))
    return out


def describe_change(ref: str, query: str) -> str:
    """Substitutions, insertions and deletions of query against ref, by one-based places of ref."""
    return describe_rows(*align(ref, query)[:2])


def describe_rows(x: str, y: str) -> str:
    """The same of the two rows of an alignment."""
    if x == y:
        return ""
    out, at, i = [], 0, 0
    while i < len(x):
        kind = "ins" if x[i] == "-" else "del" if y[i] == "-" else "sub" if x[i] != y[i] else ""
        if kind in ("", "sub"):
            at += 1
            if kind:
                out.append(f"{at}{x[i]}>{y[i]}")
            i += 1
            continue
        j = i
        while j < len(x) and (x[j] == "-" if kind == "ins" else y[j] == "-"):
            j += 1
        if kind == "ins":
            out.append(f"{at}_{at + 1}ins{y[i:j]}")
        else:
            span = f"{at + 1}" if j - i == 1 else f"{at + 1}_{at + j - i}"
            out.append(f"{span}del{x[i:j]}")
            at += j - i
        i = j
    return "; ".join(out)


def gap_widths(ref_row: str, size: int) -> np.ndarray:
    """Bases inserted before each place of an ungapped reference of so many bases, and after it."""
    wide = np.zeros(size + 1, np.int64)
    at = 0
    for c in ref_row:
        if c == "-":
            wide[at] += 1
        else:
            at += 1
    return wide


def spread(ref_row: str, row: str, wide: Sequence[int]) -> str:
    """row with gaps for wide[i] inserted bases before place i of the reference."""
    parts, at, held = [], 0, []
    for c, q in zip(ref_row + "$", row + "$", strict=True):
        if c == "-":
            held.append(q)
            continue
        parts.append("".join(held).ljust(int(wide[at]), "-"))
        parts.append(q if c != "$" else "")
        at, held = at + 1, []
    return "".join(parts)


def star_alignment(sequences: Sequence[str]) -> list[str]:
    """Rows of one length: each sequence aligned to the most frequent length's first, gaps merged. No external program."""
    if len({len(s) for s in sequences}) <= 1:
        return list(sequences)
    lengths: dict[int, int] = {}
    for s in sequences:
        lengths[len(s)] = lengths.get(len(s), 0) + 1
    top = max(lengths, key=lambda n: (lengths[n], n))
    center = next(s for s in sequences if len(s) == top)
    rows = {s: align(center, s)[:2] for s in set(sequences)}
    wide = np.max([gap_widths(ref, len(center)) for ref, _ in rows.values()], axis=0)
    return [spread(*rows[s], wide) for s in sequences]


Aligner = Callable[[Sequence[str]], list[str]]


def _external(command: list[str]) -> Aligner:
    def run(sequences: Sequence[str]) -> list[str]:
        if len(sequences) < 2:
            return list(sequences)
        with tempfile.NamedTemporaryFile("w", suffix=".fasta") as f:
            f.write("".join(f">{i}\n{s}\n" for i, s in enumerate(sequences)))
            f.flush()
            text = subprocess.run([c.format(path=f.name) for c in command], capture_output=True, text=True, check=True).stdout
        found = {}
        for record in text.split(">")[1:]:
            head, *body = record.split("\n")
            found[int(head.split()[0])] = "".join(body).upper()
        return [found[i] for i in range(len(sequences))]

    return run


#: By name; external programs serve where they are installed, more can be added.
ALIGNERS: dict[str, Aligner] = {
    "builtin": star_alignment,
    "muscle": _external(["muscle", "-align", "{path}", "-output", "/dev/stdout"]),
    "mafft": _external(["mafft", "--quiet", "{path}"]),
    "clustalo": _external(["clustalo", "-i", "{path}"]),
}


def aligner(name: str) -> Aligner:
    if name not in ALIGNERS:
        raise ValueError(f"no aligner {name!r}; known: {', '.join(sorted(ALIGNERS))}")
    if name != "builtin" and not shutil.which(name):
        raise FileNotFoundError(f"aligner {name} is not installed")
    return ALIGNERS[name]


def consensus(rows: Sequence[str], threshold: float = 0.7, ambiguous: str = "N") -> str:
    """Column consensus of aligned rows; the same rule as operators.consensus."""
    if not rows:
        return ""
    n, cols = len(rows), max(map(len, rows))
    grid = np.array([list(r.ljust(cols, "-")) for r in rows]) if cols else np.zeros((n, 0), "U1")
    counts = np.stack([(grid == b).sum(0) for b in ORDER])
    counts[5] = n - counts[:5].sum(0)
    active = max(1, round(ACTIVE * n))
    out = []
    for r in range(cols):
        c = counts[:, cols - 1 - r].copy()
        if r <= RAGGED:
            active = max(active, n - int(c[0]))
        now = active if r <= RAGGED else n
        c[0] = max(0, c[0] - (n - now))
        best = int(c.argmax())
        share = c[best] / (now if r < RAGGED else n)
        out.append(("" if ORDER[best] == "-" else ORDER[best]) if share >= threshold else ambiguous)
    return "".join(reversed(out))


def iterative_consensus(sequences: Sequence[str], threshold: float = 0.7, align_rows: Aligner = star_alignment, most: int = LAST_SAMPLE) -> str:
    """Consensus of a growing sample (sequences come in sampling order) until it is free of N; N at the ends goes."""
    size, made = FIRST_SAMPLE, ""
    while True:
        made = consensus(align_rows(sequences[:size]), threshold).strip("N")
        if "N" not in made or size >= min(most, len(sequences)):
            return made
        size *= 2


def distances(sequences: Sequence[str], band: float = 0.2) -> np.ndarray:
    """Edit distances, cut off at one more than the largest `band` share of a length."""
    cap = max((round(band * len(s)) for s in sequences), default=0)
    unique = sorted(set(sequences))
    d = np.zeros((len(unique), len(unique)), np.int64)
    for i, a in enumerate(unique):
        for j in range(i):
            d[i, j] = d[j, i] = edits(a, unique[j], cap)
    at = [unique.index(s) for s in sequences]
    return d[np.ix_(at, at)]


def edits(a: str, b: str, cap: int) -> int:
    """Levenshtein distance, at most cap + 1."""
    if abs(len(a) - len(b)) > cap:
        return cap + 1
    y = np.frombuffer(b.encode(), np.uint8)
    row, steps = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, c in enumerate(a.encode(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > cap:
            return cap + 1
    return min(int(row[-1]), cap + 1)


def upgma(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Average-linkage merges (cluster, cluster, height, size); merge i makes cluster n + i."""
    n = len(d)
    size = dict.fromkeys(range(n), 1)
    table = np.full((2 * n - 1, 2 * n - 1), np.inf) if n else np.zeros((0, 0))
    table[:n, :n] = d
    np.fill_diagonal(table, np.inf)
    out, alive = [], list(range(n))
    for step in range(n - 1):
        sub = table[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        a, b = sorted((alive[i], alive[j]))
        h, new = float(table[a, b]), n + step
        rest = [x for x in alive if x not in (a, b)]
        for x in rest:
            table[new, x] = table[x, new] = (size[a] * table[a, x] + size[b] * table[b, x]) / (size[a] + size[b])
        size[new] = size[a] + size[b]
        alive = [*rest, new]
        out.append((a, b, h, size[new]))
    return out


def cut_by_ratio(d: np.ndarray, least: int, ratio: float = 0.8, strict: bool = True) -> list[int]:
    """Cluster of each row: 0, or 1, 2 .. for parts of `least` rows or more under merges much lower than those above.
    strict: no cut, as the published rule compares heights the other way round and never fires."""
    n = len(d)
    out = [0] * n
    if strict or n < 2:
        return out
    merges = upgma(d)
    inside, above = {i: [i] for i in range(n)}, {}
    for i, (a, b, h, _) in enumerate(merges):
        inside[n + i] = inside[a] + inside[b]
        above[a] = above[b] = h
    number = 0
    for i in range(len(merges) - 2, -1, -1):  # all but the last merge, which has none above it
        rows = inside[n + i]
        if above[n + i] and merges[i][2] / above[n + i] < ratio and len(rows) >= least and not any(out[r] for r in rows):
            number += 1
            for r in rows:
                out[r] = number
    return out
