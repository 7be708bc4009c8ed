"""Selection and pruning as plain folds in order, to compare with."""

from __future__ import annotations

import math

from strandlake.functions import mdl


def universal_bits(n: int) -> float:
    total, x = mdl.UNIVERSAL, math.log2(n)
    while x > 0:
        total, x = total + x, math.log2(x)
    return total


def instance_bits(length: int, edits: int) -> float:
    m = max(0, min(edits, length))
    place = math.log2(math.comb(length, m))
    return universal_bits(length) + universal_bits(m + 1) + m * mdl.BITS_PER_SUBSTITUTION + place


def select(scores, instances):
    """scores: {family: (score, model cost, consensus length, n)}; instances: {family: [(record, start, end, divergence)]}
    -> {family: (state, exclusive bases, instances used, total bases)} of families with a score and two instances."""
    claimed, out = set(), {}
    for f in sorted((f for f, s in scores.items() if s[0] > 0 and s[3] >= 2), key=lambda f: (-round(scores[f][0], 6), f)):
        saved, bases, used, total = 0.0, 0, 0, 0
        for rec, start, end, div in instances[f]:
            cells = {(rec, x) for x in range(max(0, start), end)}
            free = len(cells - claimed)
            total += len(cells)
            if free:
                saved += 2 * free - instance_bits(free, int(div * free + 0.5))
                bases, used = bases + free, used + 1
        _, cost, length, n = scores[f]
        state = "exclusive" if saved - cost > 0 else "standalone" if length >= 50 and n >= 3 else "rejected"
        if state != "rejected":
            claimed |= {(rec, x) for rec, start, end, _ in instances[f] for x in range(max(0, start), end)}
        out[f] = state, bases, used, total
    return out


def prune(scores, instances):
    """scores: {family: score} of accepted ones -> those that go."""
    left = dict(instances)
    gone = set()
    for f in sorted(scores, key=lambda f: (round(scores[f], 6), f)):
        others = {(rec, x) for g in left if g != f and g in scores for rec, start, end, *_ in left[g] for x in range(start, end)}
        if not any(len({(rec, x) for x in range(start, end)} - others) >= (end - start) // 4 for rec, start, end, *_ in instances[f]):
            gone.add(f)
            del left[f]
    return gone
