"""Dynamic-programming kernels on numpy arrays, vectorised over the copies they work on.

Bases are codes 0..3, 4 is N and 5 lies outside the record. A kernel sees one batch of one task; none keeps state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUTSIDE = 5
_CODES = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODES[_b] = _CODES[_b + 32] = _i
_LETTERS = np.frombuffer(b"ACGTNN", np.uint8)


def encode(seq: str) -> np.ndarray:
    return _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def decode(codes: np.ndarray) -> str:
    return _LETTERS[codes].tobytes().decode()


def complement(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 4, 3 - codes, codes).astype(np.uint8)


@dataclass(frozen=True)
class Scores:
    """Costs of the multi-copy extension."""

    match: int = 1
    mismatch: int = -1
    gap: int = -5
    cap: int = -20
    band: int = 5
    slope: int = 3
    quiet: int = 100
    longest: int = 10_000
    support: float = 0.15


def windows(codes: np.ndarray, first: np.ndarray, step: np.ndarray, width: int) -> np.ndarray:
    """[n, width] bases read from ``first[n]`` in direction ``step[n]`` (complemented going down); OUTSIDE past an end."""
    at = first[:, None] + step[:, None] * np.arange(width)
    inside = (at >= 0) & (at < len(codes))
    got = np.where(inside, codes[np.clip(at, 0, max(len(codes) - 1, 0))] if len(codes) else OUTSIDE, OUTSIDE).astype(np.uint8)
    down = step < 0
    got[down] = complement(got[down])
    return got


_BASES = np.arange(4, dtype=np.uint8)[:, None, None]
_NEVER = np.iinfo(np.int64).min // 2


def _columns(prev: np.ndarray, window: np.ndarray, s: Scores) -> np.ndarray:
    """[4, n, 2M+1] band cells after one more consensus base, for each base. prev, window: [n, 2M+1].

    A cell comes from its own offset, from the next one by a gap, or from any lower one by a gap a step; over such a
    jump a match counts if one of the bases passed is equal. As ``match`` is not below ``mismatch``, the best jump is a
    running maximum: over all lower offsets with a mismatch, up to the last equal base with a match.
    """
    steps = np.arange(prev.shape[1]) * s.gap
    equal = window == _BASES
    cell = prev + np.where(equal, s.match, s.mismatch)
    np.maximum(cell[..., :-1], prev[:, 1:] + s.gap, out=cell[..., :-1])
    reach = np.maximum.accumulate(prev - steps, axis=1)
    matched = np.maximum.accumulate(np.where(equal, reach, _NEVER), axis=2)
    matched = np.where(equal[..., 1:], reach[:, :-1], matched[..., :-1]) + s.match
    jump = np.maximum(matched, reach[:, :-1] + s.mismatch) + steps[1:]
    np.maximum(cell[..., 1:], jump, out=cell[..., 1:])
    cell[:, window == OUTSIDE] = 0
    return cell


def extend(read, n: int, start: np.ndarray, best: np.ndarray, total: float, s: Scores) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Grow a consensus away from a seed shared by ``n`` copies.

    ``read(column)`` gives the copies' [n, 2M+1] bases around that column. Each column takes the base to which the
    copies together contribute most (a copy never less than its best so far plus the exit penalty), the lowest of
    equals. The end moves whenever the total has gained ``slope`` per column since the last move and enough copies
    still follow; growth stops after a quiet stretch. Returns the codes up to the end, the band and best scores
    there, and the total.
    """
    prev, best = start.astype(np.int64), best.astype(np.int64)
    grown: list[int] = []
    keep, kept_band, kept_best = 0, np.maximum(prev.max(1), best + s.cap), best.copy()
    floor = max(2, int(s.support * n))
    last = 0
    for column in range(s.longest):
        window = read(column)
        options = _columns(prev, window, s)
        gains = np.maximum(np.maximum(best + s.cap, 0), options.max(2))
        totals = gains.sum(1).tolist()
        a = int(np.argmax(totals)) if max(totals) > 0 else last
        last = a
        active = int((gains[a] > best + s.cap).sum())
        prev = options[a]
        best = np.maximum(best, prev.max(1))
        grown.append(a)
        if totals[a] >= total + (len(grown) - keep) * s.slope and totals[a] > total and active >= floor:
            total, keep, kept_band, kept_best = totals[a], len(grown), prev.max(1), best.copy()
        if len(grown) - keep >= max(s.quiet, len(grown) // 10):
            break
    return np.array(grown[:keep], np.uint8), kept_band, kept_best, total


def extend_flank(read, n: int, longest: int, s: Scores) -> tuple[np.ndarray, bool]:
    """Grow a consensus past an end that ``n`` copies reach; the codes, and whether ``longest`` alone ended the growth.

    Each column takes the base to which the copies together contribute most. Growth stops where fewer than 2 copies
    follow (3 beyond 1,000 columns, 5 beyond 5,000), where fewer than half of them support the column, or after a quiet
    stretch, and is cut back to the column of the best total.
    """
    offsets = np.arange(-s.band, s.band + 1)
    prev = np.tile(np.abs(offsets) * s.gap, (n, 1)).astype(np.int64)
    best = np.zeros(n, np.int64)
    grown: list[int] = []
    total = keep = 0
    for column in range(longest):
        window = read(column)
        floor = np.maximum(0, best + s.cap)
        options = _columns(prev, window, s)
        tops = np.maximum(floor, options.max(2))
        a = int(np.argmax(tops.sum(1)))
        prev, top = options[a], tops[a]
        grown.append(a)
        active = int((top > 0).sum())
        if active < 2 + (column > 1000) + 2 * (column > 5000):
            return np.array(grown[:keep], np.uint8), False
        best = np.maximum(best, top)
        support = prev.max(1) >= np.maximum(0, best + s.cap) + s.match
        if 2 * int(support.sum()) < n:
            return np.array(grown[:keep], np.uint8), False
        if int(top.sum()) > total:
            total, keep = int(top.sum()), column + 1
        if column + 1 - keep >= max(s.quiet, keep // 10):
            return np.array(grown[:keep], np.uint8), False
    return np.array(grown[:keep], np.uint8), True


def extend_seed(codes: np.ndarray, pos: np.ndarray, strand: np.ndarray, l: int, s: Scores) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Left and right consensus codes around a seed of length ``l`` at ``pos`` on ``strand`` of one chunk's codes."""
    n, m = len(pos), s.band
    offsets = np.arange(-m, m + 1)
    base = l * s.match + np.abs(offsets) * s.gap
    step = np.where(strand > 0, 1, -1)
    after = np.where(strand > 0, pos + l, pos - 1)
    before = np.where(strand > 0, pos - 1, pos + l)

    def reader(first: np.ndarray, direction: np.ndarray):
        block, held = 512, {}

        def read(column: int) -> np.ndarray:
            k = column // block
            if k not in held:
                held.clear()
                held[k] = windows(codes, first + direction * (k * block - m), direction, block + 2 * m + 1)
            at = column - k * block
            return held[k][:, at : at + 2 * m + 1]

        return read

    start = np.tile(base, (n, 1))
    total = float(n * l * s.match)
    right, band, best, total = extend(reader(after, step), n, start, np.full(n, l * s.match), total, s)
    start = np.maximum(best + s.cap, band)[:, None] + np.abs(offsets) * s.gap
    left_raw, _, _, _ = extend(reader(before, -step), n, start, best, total, s)
    # going left along a copy reads the other strand's letters
    return complement(left_raw)[::-1], right


def pairwise(cons: np.ndarray, cons_at: np.ndarray, genome: np.ndarray, band: int = 12, match: int = 1, mismatch: int = -1, gap: int = -5, drop: int = 20, quiet: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Best prefix of each consensus against its genome window: (columns, score).

    ``cons`` [n, width] are the letters to place in order, ``genome`` [n, width + 2 band] the genome letters, the
    diagonal at ``band``; ``cons_at`` [n] is the number of letters that exist. Cells fall no lower than the best minus
    ``drop``; an N on either side is worth that floor; a row stops after ``quiet`` columns without a new best.
    """
    n, width = cons.shape
    prev = np.full((n, 2 * band + 1), -drop, np.int64)
    prev[:, band] = 0
    best, columns = np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for j in range(width):
        alive &= (j < cons_at) & (j - columns < quiet)
        if not alive.any():
            break
        g = genome[:, j : j + 2 * band + 1]
        c = cons[:, j][:, None]
        known = (g < 4) & (c < 4)
        cell = prev + np.where(g == c, match, mismatch)
        cell[:, :-1] = np.maximum(cell[:, :-1], prev[:, 1:] + gap)
        cell[:, 1:] = np.maximum(cell[:, 1:], prev[:, :-1] + gap)
        cell = np.where(known, np.maximum(cell, (best - drop)[:, None]), (best - drop)[:, None])
        prev = np.where(alive[:, None], cell, prev)
        top = prev.max(1)
        better = alive & (top > best)
        best[better], columns[better] = top[better], j + 1
    return columns, best


def semiglobal(query: np.ndarray, target: np.ndarray, match: int = 2, mismatch: int = -3, gap: int = -2, most_cells: int = 10_000_000, least: int = 80) -> tuple[float, float] | None:
    """(identity, coverage) of the query placed anywhere in the target, or None beyond the cell limit or below
    ``least`` aligned bases. Identity counts gaps; coverage is the aligned share of the query."""
    q, t = len(query), len(target)
    if q == 0 or t == 0 or (q + 1) * (t + 1) > most_cells:
        return None
    h = np.zeros((q + 1, t + 1), np.int32)
    j = np.arange(t + 1, dtype=np.int64) * gap
    for i in range(1, q + 1):
        row = np.empty(t + 1, np.int64)
        row[0] = i * gap
        same = (target == query[i - 1]) & (query[i - 1] < 4)
        row[1:] = np.maximum(h[i - 1, :-1] + np.where(same, match, mismatch), h[i - 1, 1:] + gap)
        h[i] = np.maximum.accumulate(row - j) + j  # a run of target gaps is a running maximum
    i, k = q, int(np.argmax(h[q]))
    m = mm = gaps = 0
    while i > 0 and k > 0:
        same = query[i - 1] == target[k - 1] and query[i - 1] < 4
        if h[i, k] == h[i - 1, k - 1] + (match if same else mismatch):
            m, mm, i, k = m + same, mm + (not same), i - 1, k - 1
        elif h[i, k] == h[i - 1, k] + gap:
            gaps, i = gaps + 1, i - 1
        else:
            gaps, k = gaps + 1, k - 1
    gaps += i
    if m + mm < least:
        return None
    return m / (m + mm + gaps), (m + mm) / q
