"""Recruitment of instances by alignment, consensus rebuilding, extension, and the loop over both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators import kernels as K
from strandlake.operators import recruit
from strandlake.operators.intervals import overlap_join
from strandlake.operators.kmers import kmer_rows
from strandlake.plans.config import RefineParams
from strandlake.storage import cut

TILE = 50_000
STAGES = (500, 3_000, 10_000)  # how far a family of up to 3, up to 9, and more copies may grow at an end in a round
_ALIGNED = "family_id long, seq_index long, strand int, start long, end long, cons_start int, cons_end int, num_edits int, divergence double, score int, bases string, anchor long"


def tiles(seqs: DataFrame, halo: int = 25_000) -> DataFrame:
    """(seq_index, tile, tile_start, record_length, seq) pieces of TILE bases with ``halo`` more, so a window of up to
    ``halo`` bases lies within the piece that its start falls in."""
    rows = seqs.select("seq_index", F.length("seq").alias("record_length"), "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / TILE).cast("int"))).alias("tile"))
    return rows.where("record_length > 0").select(
        "seq_index", F.col("tile").cast("long").alias("tile"), (F.col("tile") * TILE).cast("long").alias("tile_start"), "record_length",
        F.substring("seq", F.col("tile") * TILE + 1, F.lit(TILE + halo)).alias("seq"),
    )


class Pieces:
    """The stored tiles of a genome, cut anew with a longer halo when longer windows are wanted, so that no window ever
    comes back short."""

    def __init__(self, seqs: DataFrame, halo: int = 25_000):
        self.seqs, self.halo, self.stored = seqs, 0, None
        self.least = halo

    def reaching(self, window: int) -> DataFrame:
        if self.stored is None or window > self.halo:
            self.halo = max(self.least, 2 * window if self.stored is not None else window)
            self.stored = cut(tiles(self.seqs, self.halo), "tiles")
        return self.stored


def cut_windows(rows: DataFrame, pieces: DataFrame, lo, hi) -> DataFrame:
    """``rows`` with ``window``, the bases of [lo, hi) clipped to the record, and where it starts (``window_start``)."""
    at = rows.withColumn("_lo", F.greatest(F.lit(0), lo).cast("long")).withColumn("_hi", hi.cast("long")).withColumn("tile", F.floor(F.col("_lo") / TILE))
    joined = at.join(pieces, ["seq_index", "tile"])
    n = F.greatest(F.lit(0), F.least("_hi", "record_length") - F.col("_lo")).cast("int")
    return joined.withColumn("window", F.substring("seq", (F.col("_lo") - F.col("tile_start") + 1).cast("int"), n)).withColumn("window_start", F.col("_lo")).drop(
        "seq", "tile", "tile_start", "_lo", "_hi"
    )


def collect_instances(families: DataFrame, index: DataFrame, pieces: Pieces, k: int, p: RefineParams) -> DataFrame:
    """Instances of every family: seed hits, clusters, banded alignment from each cluster's anchor, filters, greedy
    removal of overlaps in anchor order."""
    hits = recruit.seed_hits(recruit.consensus_kmers(families, k), index, p.max_seed_hits)
    anchors = recruit.cluster_hits(hits, families)
    pad = p.band + 8
    f = families.select("family_id", "consensus", "consensus_length")
    rows = anchors.join(f, "family_id")
    forward = F.col("strand") > 0
    first = F.when(forward, F.col("anchor_pos") - F.col("anchor_cons")).otherwise(F.col("anchor_pos") + k + F.col("anchor_cons") - F.col("consensus_length"))
    rows = rows.withColumn("first", first)
    longest = families.agg(F.max("consensus_length")).first()[0] or 0
    cuts = cut_windows(rows, pieces.reaching(longest + 2 * pad), F.col("first") - pad, F.col("first") + F.col("consensus_length") + pad)
    own = cuts.select("family_id", "seq_index", "strand", "first", "anchor_cons", "anchor_pos", "consensus", "window", "window_start")
    aligned = own.mapInPandas(_aligner(p, pad, k), _ALIGNED)
    order = W.partitionBy("family_id").orderBy("anchor", "seq_index", "strand")
    numbered = aligned.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= p.max_instances)

    def separate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        s, e = pdf.start.to_numpy(), pdf.end.to_numpy()
        keep: list[int] = []
        for i in range(len(pdf)):
            ks, ke = s[keep], e[keep]
            shared = np.minimum(ke, e[i]) - np.maximum(ks, s[i])
            if not (shared > np.minimum(ke - ks, e[i] - s[i]) // 2).any():
                keep.append(i)
        return pdf.iloc[keep]

    kept = numbered.groupBy("family_id", "seq_index").applyInPandas(separate, numbered.schema)
    return kept.withColumn("instance_idx", F.row_number().over(W.partitionBy("family_id").orderBy("_r")).cast("long")).withColumn(
        "aligned_length", (F.col("end") - F.col("start")).cast("int")
    ).drop("_r", "anchor")


def _aligner(p: RefineParams, pad: int, k: int):
    def one_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at in range(0, len(pdf), 256):
            out += align_block(pdf.iloc[at : at + 256], p, pad, k)
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ALIGNED.split(", ")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield one_batch(pdf)

    return run


def align_block(pdf: pd.DataFrame, p: RefineParams, pad: int, k: int) -> list[tuple]:
    """Alignments of anchors whose windows are given; rejected ones are left out."""
    n, band = len(pdf), p.band
    cons = [K.encode(c) for c in pdf.consensus]
    genome, shift = [], []
    for w, first, begin, strand, c in zip(pdf.window, pdf["first"], pdf.window_start, pdf.strand, cons, strict=True):
        full = np.full(len(c) + 2 * pad, K.OUTSIDE, np.uint8)
        lead = int(begin - (first - pad))
        g = K.encode(w)
        full[lead : lead + len(g)] = g[: max(0, len(full) - lead)]
        genome.append(full if strand > 0 else K.complement(full)[::-1])
        shift.append(pad)
    anchor = pdf.anchor_cons.to_numpy()
    sides = []
    for side in (1, -1):
        length = np.array([len(c) - a if side > 0 else a for c, a in zip(cons, anchor, strict=True)])
        width = int(length.max(initial=1)) or 1
        m = np.full((n, width), 4, np.uint8)
        g = np.full((n, width + 2 * band), K.OUTSIDE, np.uint8)
        for i in range(n):
            a, c, full = int(anchor[i]), cons[i], genome[i]
            if side > 0:
                m[i, : len(c) - a] = c[a:]
                part = full[pad + a - band : pad + a + width + band]
            else:
                m[i, :a] = c[:a][::-1]
                low = pad + a - 1 - (width - 1) - band
                part = full[max(0, low) : pad + a + band][::-1]
            g[i, : len(part)] = part[: width + 2 * band]
        sides.append(K.pairwise(m, length, g, band=band, gap=p.gap))
    (right, up), (left, down) = sides
    rows = []
    for i in range(n):
        a, b = int(anchor[i] - left[i]), int(anchor[i] + right[i])
        score = int(up[i] + down[i])
        if b - a < 10 or score <= 0:
            continue
        model, copy = cons[i][a:b], genome[i][pad + a : pad + b]
        if (copy == K.OUTSIDE).any():
            continue
        edits = int((model != copy).sum())
        if edits / (b - a) > p.max_divergence or b - a < max(k + 10, 30):
            continue
        row = pdf.iloc[i]
        first, size = int(row["first"]), len(cons[i])
        start, end = (first + a, first + b) if row.strand > 0 else (first + size - b, first + size - a)
        rows.append((int(row.family_id), int(row.seq_index), int(row.strand), start, end, a, b, edits, edits / (b - a), score, K.decode(copy), int(row.anchor_pos)))
    return rows


def rebuild_consensus(families: DataFrame, instances: DataFrame) -> DataFrame:
    """(family_id, consensus, consensus_length): each position's best supported base; the old base where nothing votes."""
    votes = instances.select(
        "family_id", F.posexplode(F.split("bases", "")).alias("_o", "base"), "cons_start", F.col("score").cast("double").alias("weight")
    ).select("family_id", (F.col("cons_start") + F.col("_o")).alias("p"), "base", "weight")
    old = families.select("family_id", F.posexplode(F.split("consensus", "")).alias("p", "base"), F.lit(0.25).alias("weight"))
    made = recruit.majority_consensus(votes.unionByName(old).where("base <> ''"), ["family_id"])
    return made.withColumn("consensus_length", F.length("consensus"))


def _grow(longest: int, s: K.Scores):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, full, n = np.empty(0, np.uint8), False, len(pdf)
        if n >= 2:
            width = longest + 4 * s.band + 32
            block = np.full((n, width), K.OUTSIDE, np.uint8)
            for j, (flank, lead) in enumerate(zip(pdf.flank, pdf.lead, strict=True)):
                letters = K.encode(flank)
                skip = lead - s.band  # bases before the band's first offset
                part = letters[max(0, skip) :]
                at = max(0, -skip)
                block[j, at : at + len(part)] = part[: width - at]
            codes, full = K.extend_flank(lambda c: block[:, c : c + 2 * s.band + 1], n, longest, s)
        return pd.DataFrame({"family_id": [int(pdf.family_id.iloc[0])], "side": [pdf.side.iloc[0]], "grown": [K.decode(codes)], "full": [full]})

    return grow


def extend_ends(families: DataFrame, instances: DataFrame, pieces: Pieces, scores: K.Scores = K.Scores(), stages: tuple[int, ...] = STAGES, close: int = 15) -> DataFrame:
    """Families grown at both ends by the multi-copy extension over instances that end within ``close`` bases of it.

    How far depends on the number of copies (``stages``: up to 3, up to 9, more). Flanks are read in these stages, so
    long ones are read only for the ends that the shorter ones did not see stop.
    """
    f = families.select("family_id", "consensus", "consensus_length")
    copies = instances.groupBy("family_id").agg(F.count(F.lit(1)).alias("_copies"))
    i = instances.join(f.select("family_id", "consensus_length"), "family_id").join(copies, "family_id")
    forward = F.col("strand") > 0
    right_end = F.when(forward, F.col("end")).otherwise(F.col("start"))
    left_end = F.when(forward, F.col("start")).otherwise(F.col("end"))
    sides = []
    for side, near, edge, up in (
        ("R", F.col("consensus_length") - F.col("cons_end") <= close, right_end, forward), ("L", F.col("cons_start") <= close, left_end, ~forward)
    ):
        part = i.where(near).select("family_id", "seq_index", "_copies", F.lit(side).alias("side"), edge.alias("edge"), up.alias("up"))
        sides.append(part)
    open_ = cut(sides[0].unionAll(sides[1]), "ends")
    stage = F.when(F.col("_copies") <= 3, 0).when(F.col("_copies") <= 9, 1).otherwise(2)
    ended = []
    for number, longest in enumerate(stages):
        pad = 2 * scores.band
        lo = F.when(F.col("up"), F.col("edge") - pad).otherwise(F.col("edge") - longest - pad)
        cuts = cut_windows(open_, pieces.reaching(longest + 2 * pad), lo, F.when(F.col("up"), F.col("edge") + longest + pad).otherwise(F.col("edge") + pad))
        flank = F.when(F.col("up"), F.col("window")).otherwise(S.reverse_complement("window"))
        lead = F.when(F.col("up"), F.col("edge") - F.col("window_start")).otherwise(F.col("window_start") + F.length("window") - F.col("edge"))
        rows = cuts.select("family_id", "side", flank.alias("flank"), lead.cast("int").alias("lead")).where(F.length("flank") > 0)
        grown = rows.groupBy("family_id", "side").applyInPandas(_grow(longest, scores), "family_id long, side string, grown string, full boolean")
        grown = cut(grown, "grown")
        if number == len(stages) - 1:
            ended.append(grown)
            break
        onward = open_.where(stage > number).join(grown.where("full").select("family_id", "side"), ["family_id", "side"], "left_semi")
        onward = cut(onward, "ends")
        ended.append(grown.join(onward.select("family_id", "side").distinct(), ["family_id", "side"], "left_anti"))
        if onward.isEmpty():
            break
        open_ = onward
    grown = ended[0]
    for x in ended[1:]:
        grown = grown.unionByName(x)
    wide = grown.groupBy("family_id").agg(F.max(F.when(F.col("side") == "R", F.col("grown"))).alias("r"), F.max(F.when(F.col("side") == "L", F.col("grown"))).alias("l"))
    longer = F.concat(F.coalesce(S.reverse_complement("l"), F.lit("")), "consensus", F.coalesce("r", F.lit("")))
    joined = f.join(wide, "family_id", "left").select("family_id", longer.alias("consensus"))
    return joined.withColumn("consensus_length", F.length("consensus"))


def refine_families(families: DataFrame, index: DataFrame, pieces: Pieces, k: int, p: RefineParams) -> tuple[DataFrame, DataFrame]:
    """(families, instances) after rounds of recruit, extend and rebuild; a family leaves the loop when its consensus
    changes by less than 1% + 1 or fewer than two instances are left."""
    active = cut(families.select("family_id", "consensus", "consensus_length"), "refine")
    done_f, done_i = [], []
    for _ in range(p.rounds):
        inst = cut(collect_instances(active, index, pieces, k, p), "refine-inst")
        n = inst.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))
        live = active.join(n.where("n >= 2").select("family_id"), "family_id", "left_semi")
        rebuilt = rebuild_consensus(live, inst.join(live.select("family_id"), "family_id", "left_semi"))
        changed = rebuilt.alias("a").join(live.alias("b"), "family_id").select(
            "family_id", F.col("a.consensus").alias("consensus"), F.col("a.consensus_length").alias("consensus_length"),
            F.levenshtein(F.col("a.consensus"), F.col("b.consensus"), 1000).alias("d"),
        )
        grown = extend_ends(changed.select("family_id", "consensus", "consensus_length"), inst, pieces, K.Scores(gap=p.gap, band=p.band)).withColumnRenamed("consensus", "c2").withColumnRenamed("consensus_length", "l2")
        nxt = cut(changed.join(grown, "family_id"), "refine-next")
        limit = F.floor(F.col("consensus_length") * 0.01) + 1
        stable = (F.col("d") >= 0) & (F.col("d") + F.col("l2") - F.col("consensus_length") <= limit)
        rest = nxt.where(~stable)
        done = active.join(rest.select("family_id"), "family_id", "left_anti")
        final = done.alias("o").join(nxt.alias("x"), "family_id", "left").select(
            "family_id", F.coalesce("x.consensus", "o.consensus").alias("consensus")
        ).withColumn("consensus_length", F.length("consensus"))
        done_f.append(cut(final, "refine-done"))
        done_i.append(inst.join(done.select("family_id"), "family_id", "left_semi"))
        active = cut(rest.select("family_id", F.col("c2").alias("consensus"), F.col("l2").alias("consensus_length")), "refine")
        if active.limit(1).count() == 0:
            break
    else:
        done_f.append(active)
        done_i.append(collect_instances(active, index, pieces, k, p))
    fam, ins = done_f[0], done_i[0]
    for x, y in zip(done_f[1:], done_i[1:], strict=True):
        fam, ins = fam.unionByName(x), ins.unionByName(y)
    return cut(fam, "refined"), cut(ins, "refined-inst")


def recruit_short(families: DataFrame, instances: DataFrame, seqs: DataFrame, pieces: Pieces, k: int, p: RefineParams, word: int = 7, below: int = 500) -> DataFrame:
    """``instances`` with more copies of families of ``k`` to ``below`` - 1 bases: seeds of ``word`` bases, at least 70 %
    identity over 60 % of the consensus, and none that overlaps a known copy of its family. The index of so short words
    covers the whole genome, so this is for those who ask for it."""
    few = families.where((F.col("consensus_length") >= k) & (F.col("consensus_length") < below))
    if few.isEmpty():
        return instances
    found = collect_instances(few, cut(kmer_rows(seqs, word), "short-words"), pieces, word, p)
    size = few.select("family_id", "consensus_length")
    good = found.join(size, "family_id").where("divergence <= 0.30 and cons_end - cons_start >= 0.60 * consensus_length").drop("consensus_length")
    new = good.withColumn("_n", F.monotonically_increasing_id())
    new = cut(new, "short-found")
    met = overlap_join(new.select("family_id", "_n", "seq_index", "start", "end"), instances.select("family_id", "seq_index", "start", "end"), ["seq_index", "family_id"], below)
    fresh = new.join(met.select(F.col("a__n").alias("_n")).distinct(), "_n", "left_anti").drop("_n")
    last = instances.groupBy("family_id").agg(F.max("instance_idx").alias("_last"))
    numbered = fresh.join(last, "family_id", "left").withColumn("instance_idx", F.col("instance_idx") + F.coalesce("_last", F.lit(0))).drop("_last")
    return cut(instances.unionByName(numbered.select(instances.columns)), "short-inst")
