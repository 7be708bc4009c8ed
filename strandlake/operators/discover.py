"""Discovery of repeat families: frequent seeds, extension over all their copies, masking, per chunk of the genome."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.seq import canonical
from strandlake.operators import kernels as K
from strandlake.operators.kmers import kmer_rows
from strandlake.plans.config import DiscoverParams

FAMILY = "chunk long, local_id int, consensus string, estimated_copies int, instances array<struct<seq_index: long, start: long, end: long, num_edits: int, divergence: double, strand: int>>"


class ChunkIndex:
    """L-mers of one chunk: packed canonical codes, strands and positions of the usable ones, sorted by code."""

    def __init__(self, codes: np.ndarray, l: int, p: DiscoverParams):  # noqa: E741
        self.codes, self.l = codes, l
        n = len(codes) - l + 1
        if n <= 0:
            self.code = self.pos = self.rev = np.empty(0, np.int64)
            self.starts = self.ends = np.empty(0, np.int64)
            self.keys = np.empty(0, np.int64)
            return
        fwd, rc, bad = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(l):
            c = codes[i : i + n]
            bad |= c > 3
            c = np.minimum(c, 3)
            fwd *= 4
            fwd += c
            rc += (3 - c).astype(np.int64) << (2 * i)
        rev = fwd > rc
        canon = np.minimum(fwd, rc, out=fwd)
        del rc
        pos = np.flatnonzero(~bad)
        pos = pos[self._informative(canon[pos], p)]
        order = np.lexsort((pos, rev[pos], canon[pos]))
        pos = pos[order]
        code, rev = canon[pos], rev[pos]
        # an occurrence too close to the previous one of its strand is not available (on the reverse strand: the next)
        same = np.zeros(len(pos), bool)
        same[1:] = (code[1:] == code[:-1]) & (rev[1:] == rev[:-1]) & (pos[1:] - pos[:-1] < p.tandem)
        drop = np.where(rev, np.append(same[1:], False), same)
        self.code, self.pos, self.rev = code[~drop], pos[~drop], rev[~drop]
        self.keys, self.starts = np.unique(self.code, return_index=True)
        self.ends = np.append(self.starts[1:], len(self.code))

    def _informative(self, canon: np.ndarray, p: DiscoverParams) -> np.ndarray:
        """Whether each l-mer has enough entropy and no period."""
        u, back = np.unique(canon, return_inverse=True)
        digits = (u[:, None] >> (2 * np.arange(self.l))) & 3
        share = np.stack([(digits == b).sum(1) for b in range(4)], 1) / self.l
        entropy = np.where(share > 0, share * np.log(np.maximum(share, 1e-12)), 0).sum(1)
        ok = entropy <= p.max_entropy
        for shift in range(1, self.l // 2 + 1):
            if self.l - shift >= 4:
                ok &= (digits[:, shift:] == digits[:, :-shift]).sum(1) * 100 < (self.l - shift) * 85
        return ok[back]

    def slot(self, key: int) -> slice:
        i = np.searchsorted(self.keys, key)
        return slice(self.starts[i], self.ends[i]) if i < len(self.keys) and self.keys[i] == key else slice(0, 0)


def pack(lmer: str) -> int:
    """The number of an l-mer or of its reverse complement, whichever is less."""
    codes = K.encode(lmer).astype(int)
    numbers = []
    for c in (codes, (3 - codes)[::-1]):
        n = 0
        for x in c.tolist():
            n = n * 4 + x
        numbers.append(n)
    return min(numbers)


def discover_chunk(records: list[tuple[int, int, str]], p: DiscoverParams, seeds: Iterable[str] | None = None) -> list[dict]:
    """Families of one chunk; ``records`` are (seq_index, offset in the record, sequence). With ``seeds`` only these are.

    Repeats: take the most frequent l-mer that is left (ties by its code), extend over its occurrences, keep the family
    if the consensus is long enough, mask what its l-mers reach, until no l-mer occurs ``min_threshold`` times.
    """
    spacer = np.full(p.scores.longest if len(records) > 1 else 0, K.OUTSIDE, np.uint8)
    spacer = spacer[: 2 * p.scores.band + 64] if len(spacer) else spacer
    parts, owner, at = [], [], 0
    for rec, offset, seq in records:
        parts += [K.encode(seq), spacer]
        owner.append((at, at + len(seq), rec, offset))
        at += len(seq) + len(spacer)
    codes = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    bases = sum(e - s for s, e, _, _ in owner)
    if bases < 8:
        return []
    l = p.l or min(31, max(8, math.ceil(1 + math.log(bases, 4))))  # noqa: E741
    index = ChunkIndex(codes, l, p)
    masked = np.zeros(len(codes) + 1, bool)
    allowed = None if seeds is None else {pack(x) for x in seeds if len(x) == l}
    heap = [
        (-int(e - s), int(k)) for k, s, e in zip(index.keys, index.starts, index.ends, strict=True)
        if e - s >= p.min_threshold and (allowed is None or int(k) in allowed)
    ]
    heapq.heapify(heap)
    out: list[dict] = []
    while heap and len(out) < p.max_families:
        freq, key = heapq.heappop(heap)
        own = index.slot(key)
        free = ~masked[index.pos[own]]
        n = int(free.sum())
        if n < p.min_threshold:
            continue
        if n != -freq:
            heapq.heappush(heap, (-n, key))
            continue
        pos, rev = index.pos[own][free][-p.max_occurrences :], index.rev[own][free][-p.max_occurrences :]
        strand = np.where(rev, -1, 1)
        left, right = K.extend_seed(codes, pos, strand, l, p.scores)
        seed = np.array([(key >> (2 * (l - 1 - i))) & 3 for i in range(l)], np.uint8)
        consensus = np.concatenate([left, seed, right]).astype(np.uint8)
        if len(consensus) >= p.good_length:
            found = _instances(codes, owner, pos, strand, consensus, len(left), l)
            out.append({"consensus": K.decode(consensus), "estimated_copies": n, "instances": found})
        _mask(index, masked, consensus, p.scores)
        masked[pos] = True
    return out


def _instances(codes: np.ndarray, owner: list, pos: np.ndarray, strand: np.ndarray, cons: np.ndarray, left: int, l: int) -> list[dict]:  # noqa: E741
    """Seed occurrences projected to the consensus' extent, clipped to their records, with ungapped edits."""
    starts = np.array([o[0] for o in owner])
    out = []
    for x, s in zip(pos.tolist(), strand.tolist(), strict=True):
        a, b, rec, offset = owner[int(np.searchsorted(starts, x, side="right")) - 1]
        lo = x - left if s > 0 else x - (len(cons) - left - l)
        lo_c, hi_c = max(lo, a), min(lo + len(cons), b)
        if hi_c <= lo_c or hi_c - lo_c > 100_000:
            continue
        model = cons if s > 0 else K.complement(cons)[::-1]
        edits = int((codes[lo_c:hi_c] != model[lo_c - lo : hi_c - lo]).sum())
        out.append(
            {"seq_index": rec, "start": lo_c - a + offset, "end": hi_c - a + offset, "num_edits": edits, "divergence": edits / (hi_c - lo_c), "strand": s}
        )
    return out


def _mask(index: ChunkIndex, masked: np.ndarray, cons: np.ndarray, s: K.Scores) -> None:
    """Mask where the consensus' l-mers occur, as far as a banded comparison with the consensus carries."""
    l = index.l  # noqa: E741
    hits: list[tuple[int, int, int]] = []
    n = len(cons) - l + 1
    if n <= 0:
        return
    fwd, rc = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(l):
        c = cons[i : i + n].astype(np.int64)
        fwd = fwd * 4 + c
        rc += (3 - c) << (2 * i)
    for i, (f, r) in enumerate(zip(fwd.tolist(), rc.tolist(), strict=True)):
        own = index.slot(min(f, r))
        for x, back in zip(index.pos[own].tolist(), index.rev[own].tolist(), strict=True):
            hits.append((x, i, 1 if back == (f > r) else -1))
    while True:
        hits = [h for h in hits if not masked[h[0]]]
        if not hits:
            return
        hits.sort()
        chosen, last = [], {}
        for x, i, strand in hits:  # one hit per place and diagonal in a round
            key = (strand, (x - strand * i) // (4 * s.band))
            if key not in last or x - last[key] > len(cons):
                chosen.append((x, i, strand))
                last[key] = x
        x, i, strand = (np.array(v) for v in zip(*chosen[:4096], strict=True))
        ends = []
        for side in (1, -1):
            width = int((n - 1 - i).max() if side > 0 else i.max()) or 1
            first = np.where(strand > 0, x + l if side > 0 else x - 1, x - 1 if side > 0 else x + l)
            direction = strand * side
            genome = K.windows(index.codes, first - direction * s.band, direction, width + 2 * s.band)
            if side > 0:
                length, order = len(cons) - l - i, i[:, None] + l + np.arange(width)
            else:
                length, order = i, i[:, None] - 1 - np.arange(width)
            model = cons[np.clip(order, 0, len(cons) - 1)]
            if side < 0:
                model = K.complement(model)
            columns, _ = K.pairwise(model, length, genome, band=s.band, match=s.match, mismatch=s.mismatch, gap=s.gap, drop=-s.cap, quiet=s.quiet)
            ends.append(columns)
        right, left = ends
        lo = np.where(strand > 0, x - left, x - right) - l + 1
        hi = np.where(strand > 0, x + l + right, x + l + left)
        for a, b, at in zip(lo.tolist(), hi.tolist(), x.tolist(), strict=True):
            masked[max(0, a) : b] = True
            masked[at] = True


def discover_families(tiles: DataFrame, p: DiscoverParams, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(families, instances) of (chunk, seq_index, start, seq): each chunk is one task, as masking in a chunk is
    sequential; chunks bound a task's memory and are the unit of scale-out. Ids are dense per chunk and unique over all.

    ``seeds`` (lmer), if given, are the only l-mers that may be seeds (``p.l`` must say their length). However many there
    are, a chunk's task gets those that occur in the chunk: its l-mers are joined to the table, on either strand."""

    def run(pdf: pd.DataFrame, allowed: Iterable[str] | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq_index", "start"])
        chunk = int(pdf["chunk"].iloc[0]) if len(pdf) else 0
        found = discover_chunk(list(zip(pdf.seq_index, pdf.start, pdf.seq, strict=True)), p, allowed)
        columns = {
            "chunk": pd.Series([chunk] * len(found), dtype="int64"),
            "local_id": pd.Series(range(len(found)), dtype="int32"),
            "consensus": pd.Series([f["consensus"] for f in found], dtype=object),
            "estimated_copies": pd.Series([f["estimated_copies"] for f in found], dtype="int32"),
            "instances": pd.Series([f["instances"] for f in found], dtype=object),
        }
        return pd.DataFrame(columns)

    if seeds is None:
        found = tiles.groupBy("chunk").applyInPandas(lambda t: run(t), FAMILY)
    else:
        known = seeds.where(F.length("lmer") == p.l).select(canonical("lmer").alias("kmer")).distinct()
        present = kmer_rows(tiles.select(F.col("chunk").alias("seq_index"), "seq"), p.l).select(F.col("seq_index").alias("chunk"), "kmer").distinct()
        own = present.join(known, "kmer", "left_semi")
        found = tiles.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInPandas(lambda t, k: run(t, k["kmer"]), FAMILY)
    ident = (F.col("chunk") * 1_000_000 + F.col("local_id")).cast("long").alias("family_id")
    kept = found.select(ident, "consensus", F.length("consensus").alias("consensus_length"), "estimated_copies", F.lit(0).alias("discovery_flags"), "instances")
    return kept.drop("instances"), kept.select("family_id", F.inline("instances"))
