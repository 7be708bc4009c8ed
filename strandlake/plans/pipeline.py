"""The whole analysis: discover, merge, split, assemble, select, prune, coalesce."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import assemble, kernels, kmers, merge, refine, scale, select, split
from strandlake.operators.discover import discover_families
from strandlake.operators.graph import connected_components
from strandlake.operators.rescue import statistics as rescue_statistics
from strandlake.plans.config import Params
from strandlake.plans.rescue import recall_rescue
from strandlake.sources.audit import rescue_audit
from strandlake.storage import cut

#: Called after each stage with its number, name, families and instances.
Trace = Callable[[int, str, DataFrame, DataFrame], None]


@dataclass
class Library:
    """Families with their states, their instances (as reported: coalesced), the one-row summary, the audits, how
    many families hold as many instances as are recruited at most, and the one-row statistics of the rescue."""

    families: DataFrame
    selected: DataFrame
    instances: DataFrame
    summary: DataFrame
    split_audit: DataFrame
    rescue_audit: DataFrame | None = None
    capped: int = 0
    rescue_statistics: DataFrame | None = None


def chunked(seqs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(chunk, seq_index, start, seq): long records cut, pieces dealt in record order to chunks of about ``chunk`` bases.

    A piece belongs to the chunk in which it starts on the line of all pieces; where that is comes from running sums
    within stretches of 4,096 records and the stretches' totals, so lengths never meet on the driver or in one task.
    """
    lengths = seqs.select("seq_index", F.length("seq").cast("long").alias("length")).where("length > 0")
    parts = scale.split_records(lengths, chunk, overlap).withColumn("_n", F.col("end") - F.col("start"))
    parts = parts.withColumn("_r", F.floor(F.col("seq_index") / 4096))
    totals = parts.groupBy("_r").agg(F.sum("_n").alias("_sum"))
    offsets = totals.select("_r", F.coalesce(F.sum("_sum").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    within = F.sum("_n").over(W.partitionBy("_r").orderBy("seq_index", "part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    placed = parts.withColumn("_at", within).join(offsets, "_r").withColumn("chunk", F.floor((F.col("_at") + F.col("_offset")) / chunk))
    joined = placed.select("chunk", "seq_index", "start", "end").join(seqs.select("seq_index", "seq"), "seq_index")
    return joined.select(
        "chunk", F.col("seq_index").cast("long").alias("seq_index"), "start", F.substring("seq", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("seq")
    )


def align_pairs(pairs: DataFrame, most_cells: int, least: int = 80) -> DataFrame:
    """(a, b, identity, coverage) of pairs (a, b, ca, cb): the shorter consensus placed in the longer one, on the
    strand of better identity. Pairs with too little aligned are left out, and so are those beyond the cell limit, for
    which the caller has another rule."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for x, y, cx, cy in zip(pdf.a, pdf.b, pdf.ca, pdf.cb, strict=True):
                q, t = sorted((kernels.encode(cx), kernels.encode(cy)), key=len)
                strands = (q, kernels.complement(q)[::-1])
                got = [r for s in strands if (r := kernels.semiglobal(s, t, most_cells=most_cells, least=least))]
                if got:
                    out.append((x, y, *max(got)))
            yield pd.DataFrame(out, columns=["a", "b", "identity", "coverage"]).astype({"a": "int64", "b": "int64", "identity": "float64", "coverage": "float64"})

    return pairs.select("a", "b", "ca", "cb").mapInPandas(run, "a long, b long, identity double, coverage double")


def merge_families(families: DataFrame, instances: DataFrame, index: DataFrame, pieces: refine.Pieces, k: int, p: Params) -> tuple[DataFrame, DataFrame]:
    """Similar families united (Jaccard screen, length guard, semi-global identity and coverage on both strands),
    represented by the one with most instances, which is refined again. Pairs too long to align are united by a Jaccard
    similarity of 0.80 where their instances overlap."""
    sized = families.select(F.col("family_id").alias("id"), F.col("consensus_length").alias("length"))
    ids = families.select(F.col("family_id").alias("id"), F.col("consensus").alias("seq"))
    screened = cut(merge.length_guard(merge.jaccard_pairs(ids, ratio=0.7), sized), "merge-screened")
    a = families.select(F.col("family_id").alias("a"), F.col("consensus").alias("ca"))
    b = families.select(F.col("family_id").alias("b"), F.col("consensus").alias("cb"))
    oversize = (F.col("la") + 1).cast("long") * (F.col("lb") + 1) > p.refine.max_dp_cells
    pairs = screened.where(~oversize).select("a", "b").join(a, "a").join(b, "b")

    overlapping = cut(merge.instance_overlap(instances, 500).where("overlaps").select("a", "b"), "merge-overlaps")
    scored = align_pairs(pairs, p.refine.max_dp_cells).withColumn("large", F.lit(False))
    # pairs too long to align: similar profiles and shared places decide, the profiles' similarity stands for the identity
    large = screened.where(oversize & (F.col("jaccard") >= 0.80)).join(overlapping, ["a", "b"], "left_semi")
    scored = scored.unionByName(large.select("a", "b", F.col("jaccard").alias("identity"), F.lit(1.0).alias("coverage"), F.lit(True).alias("large")))
    scored = cut(scored, "merge-pairs")
    strict = scored.where("large or identity >= 0.80 and coverage >= 0.80").select("a", "b")
    relaxed = scored.where("not large and (identity < 0.80 or coverage < 0.80) and identity >= 0.70 and coverage >= 0.70").join(overlapping, ["a", "b"], "left_semi")
    lengths = families.select(F.col("family_id").alias("id"), F.col("consensus_length").alias("length"))
    gated = merge.merge_gate(strict.unionByName(relaxed.select("a", "b")).join(scored.select("a", "b", "identity"), ["a", "b"]), instances, lengths, p.library.mode)
    parts = connected_components(gated.select("a", "b"))
    n = instances.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))
    reps = merge.representatives(parts, n)
    absorbed = parts.join(reps, "component").where("node <> representative").select(F.col("node").alias("family_id"))
    kept = families.join(absorbed, "family_id", "left_anti")
    return refine.refine_families(kept, index, pieces, k, p.refine)


def split_families(families: DataFrame, instances: DataFrame, index: DataFrame, pieces: refine.Pieces, k: int, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Families with two divergence modes become two, where the halves together encode no worse; returns the audit too."""
    cuts = split.otsu(instances)
    audit = split.split_decisions(instances, cuts)
    candidates = audit.where("decision = 'candidate'").select("family_id")
    rows = instances.join(cuts.select("family_id", "threshold"), "family_id").join(candidates, "family_id", "left_semi")
    half = rows.withColumn("half", (F.col("divergence") > F.col("threshold")).cast("int")).withColumn("_own", F.col("family_id"))
    top = (families.agg(F.max("family_id")).first()[0] or 0) + 1
    keyed = half.withColumn("family_id", F.col("family_id") + F.col("half") * top)
    bases = families.join(candidates, "family_id", "left_semi")
    doubled = bases.unionByName(bases.withColumn("family_id", F.col("family_id") + top))
    halves = refine.rebuild_consensus(doubled, keyed)
    mode = p.library.mode
    new = select.family_scores(keyed, halves, mode).withColumn("own", F.col("family_id") % top).groupBy("own").agg(
        F.sum(F.when(F.col("family_id") < top, F.col("score"))).alias("lo"), F.sum(F.when(F.col("family_id") >= top, F.col("score"))).alias("hi")
    )
    old = select.family_scores(rows, bases, mode).select(F.col("family_id").alias("own"), F.col("score").alias("orig"))
    judged = new.join(old, "own").withColumn("ok", split.gate_passes("orig", "lo", "hi"))
    sizes = halves.groupBy((F.col("family_id") % top).alias("own")).agg(
        F.max(F.when(F.col("family_id") < top, F.col("consensus_length"))).alias("lo_len"), F.max(F.when(F.col("family_id") >= top, F.col("consensus_length"))).alias("hi_len")
    )
    judged = cut(judged.join(sizes, "own"), "split-judged")
    accepted = cut(judged.where("ok").select("own"), "split")
    full = split_table(families, audit, cuts, judged)
    if accepted.limit(1).count() == 0:
        return families, instances, full
    parents = accepted.select(F.col("own").alias("family_id"))
    fresh = halves.withColumn("own", F.col("family_id") % top).join(accepted, "own", "left_semi").drop("own")
    refined, recruited = refine.refine_families(fresh, index, pieces, k, p.refine)
    f = families.join(parents, "family_id", "left_anti").select("family_id", "consensus", "consensus_length").unionByName(refined)
    i = instances.join(parents, "family_id", "left_anti").unionByName(recruited)
    return cut(f, "split-f"), cut(i, "split-i"), full


def split_table(families: DataFrame, audit: DataFrame, cuts: DataFrame, judged: DataFrame) -> DataFrame:
    """The split audit: one row per family looked at, with the cut, both sides, and for candidates the cost gate."""
    gate = judged.select(F.col("own").alias("family_id"), "ok", "orig", "lo", "hi", "lo_len", "hi_len")
    rows = audit.join(cuts.select("family_id", "n", "threshold", "bimodality", "valley_pass"), "family_id").join(gate, "family_id", "left")
    rows = rows.join(families.select("family_id", "consensus_length"), "family_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    least = F.when(F.col("orig") > 0, F.lit(0.0)).otherwise(F.col("orig") - 2 * F.abs(F.col("orig")))
    return rows.select(
        "family_id", "consensus_length", F.col("n").alias("num_instances"),
        F.when(F.col("ok"), "accept").when(~F.col("ok"), "reject_mdl_gate").otherwise(F.col("decision")).alias("decision"),
        "threshold", "bimodality", "valley_pass", "n_lo", "n_hi", zero("mean_lo").alias("mean_lo"), zero("mean_hi").alias("mean_hi"),
        F.when((F.col("n_lo") > 0) & (F.col("n_hi") > 0), F.col("mean_hi") - F.col("mean_lo")).otherwise(F.lit(0.0)).alias("div_gap"),
        zero("orig").alias("orig_score"), (zero("lo") + zero("hi")).alias("split_score"), F.coalesce(least, F.lit(0.0)).alias("min_acceptable"),
        zero("lo").alias("lo_score"), zero("hi").alias("hi_score"),
        F.coalesce("lo_len", F.lit(0)).alias("lo_len"), F.coalesce("hi_len", F.lit(0)).alias("hi_len"),
    )


def assemble_fragments(families: DataFrame, instances: DataFrame, index: DataFrame, pieces: refine.Pieces, k: int, p: Params) -> tuple[DataFrame, DataFrame]:
    """Fragments at a steady distance become one family if the joined one encodes better than both and diverges by
    0.35 at most. Pairs are tried in rounds, the strongest first and each family in one pair a round; a joined family
    goes on with its other pairs, so chains of up to ten fragments grow. A family that was absorbed takes its pairs along."""
    distance = assemble.reach(families).first()[0] or 500
    own = assemble.thinned(instances)
    n = own.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))
    work = assemble.comparisons(own, distance).agg(F.sum("comparisons")).first()[0] or 0
    if work > p.library.most_neighbours:
        warnings.warn(f"{work} neighbouring instances: fragments are not assembled", stacklevel=2)
        return families, instances
    pairs = cut(assemble.joinable(assemble.cooccurrences(own, distance), families, n).select("a", "b", "total"), "assemble-pairs")
    members = cut(families.select("family_id", F.lit(1).alias("members")), "assemble-members")
    for _ in range(9):
        ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("family_id")).distinct(), "assemble-ends")
        thin = assemble.thinned(instances.join(ends, "family_id", "left_semi"))
        steps = cut(assemble.steps(thin, distance).join(pairs.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b", "gap", "sign").agg(F.count(F.lit(1)).alias("times")), "assemble-steps")
        steady = assemble.steadiness(steps, distance).where("steady").select("a", "b", "median_gap")
        votes = steps.groupBy("a", "b").agg(F.sum(F.col("sign") * F.col("times")).alias("votes"))
        ma = members.select(F.col("family_id").alias("a"), F.col("members").alias("_ma"))
        mb = members.select(F.col("family_id").alias("b"), F.col("members").alias("_mb"))
        picked = pairs.join(ma, "a").join(mb, "b").where("_ma + _mb <= 10").drop("_ma", "_mb").join(steady, ["a", "b"]).join(votes, ["a", "b"])
        picked = cut(picked, "assemble")
        if picked.isEmpty():
            break
        tried, ok, made, recruited = _join_pairs(picked, families, instances, index, pieces, k, p)
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"), "assemble-pairs")
        if ok.isEmpty():
            if tried.count() == picked.count():
                break
            continue
        gone = ok.select("family_id").unionAll(ok.select(F.col("b").alias("family_id")))
        f = families.join(gone, "family_id", "left_anti").select("family_id", "consensus", "consensus_length").unionByName(
            made.join(ok, "family_id", "left_semi").select("family_id", "consensus", "consensus_length")
        )
        i = instances.join(gone, "family_id", "left_anti").unionByName(recruited.join(ok, "family_id", "left_semi"))
        absorbed = ok.join(members.select(F.col("family_id").alias("b"), F.col("members").alias("_more")), "b").select("family_id", "b", "_more")
        members = members.join(absorbed.select(F.col("b").alias("family_id")), "family_id", "left_anti").join(absorbed.drop("b"), "family_id", "left")
        members = cut(members.select("family_id", (F.col("members") + F.coalesce("_more", F.lit(0))).alias("members")), "assemble-members")
        families, instances = cut(f, "joined-f"), cut(i, "joined-i")
    return families, instances


def _join_pairs(
    picked: DataFrame, families: DataFrame, instances: DataFrame, index: DataFrame, pieces: refine.Pieces, k: int, p: Params
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round: (pairs tried, pairs accepted as (family_id, b), joined families, their instances). A joined family has
    the lesser id of the pair."""
    parts = connected_components(picked.select("a", "b")).withColumnRenamed("node", "a")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        keep = []
        for i, (a, b) in enumerate(zip((g := pdf.sort_values(["total", "a", "b"], ascending=[False, True, True])).a, g.b, strict=True)):
            if a not in used and b not in used:
                used.update((a, b))
                keep.append(i)
        return g.iloc[keep][["a", "b", "median_gap", "votes"]]

    matched = cut(picked.join(parts, "a").groupBy("component").applyInPandas(greedy, "a long, b long, median_gap long, votes long"), "assemble-matched")
    fa = families.select(F.col("family_id").alias("a"), F.col("consensus").alias("ca"))
    fb = families.select(F.col("family_id").alias("b"), F.col("consensus").alias("cb"))
    both = matched.join(fa, "a").join(fb, "b").withColumn("first", F.when(F.col("votes") >= 0, F.col("ca")).otherwise(F.col("cb"))).withColumn(
        "second", F.when(F.col("votes") >= 0, F.col("cb")).otherwise(F.col("ca"))
    )
    made = both.select(F.col("a").alias("family_id"), "b", assemble.joined_consensus("first", "second", "median_gap").alias("consensus"))
    made = cut(made.withColumn("consensus_length", F.length("consensus")), "assembled")
    recruited = cut(refine.collect_instances(made, index, pieces, k, p.refine), "assembled-inst")
    after = select.family_scores(recruited, made, p.library.mode).select("family_id", F.col("score").alias("joined"), "mean_divergence")
    before = select.family_scores(instances, families, p.library.mode).select("family_id", "score")
    judged = made.select("family_id", "b").join(after, "family_id").join(before.withColumnRenamed("score", "sa"), "family_id").join(
        before.select(F.col("family_id").alias("b"), F.col("score").alias("sb")), "b"
    )
    ok = cut(judged.where("joined > greatest(sa, 0) + greatest(sb, 0) and joined > 0 and mean_divergence <= 0.35").select("family_id", "b"), "assembled-ok")
    return matched.select("a", "b"), ok, made, recruited


def build_library(seqs: DataFrame, params: Params | None = None, trace: Trace | None = None, seeds: DataFrame | None = None) -> Library:
    """The library of (seq_index, seq). Every stage's result is written to the shared folder before the next; ``trace``
    gets eight of them, of the last three the accepted families only. Of the first discovery only ``seeds`` (lmer), if
    given, are seeds."""
    p = params or Params()
    said = trace or (lambda number, name, families, instances: None)
    seqs = cut(seqs.select(F.col("seq_index").cast("long").alias("seq_index"), "seq"), "genome")
    searched = seqs
    total = seqs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    if p.sample is not None and total > p.sample.size:
        lengths = seqs.select("seq_index", F.length("seq").cast("long").alias("length"))
        tiles = scale.sample_tiles(lengths, p.sample.window, p.sample.size // p.sample.window, p.sample.seed)
        searched = cut(scale.sampled_sequences(seqs, tiles), "sample")
    pieces = refine.Pieces(seqs)
    found, raw = discover_families(chunked(searched, p.library.chunk, p.library.overlap), p.discover, seeds)
    families, raw = cut(found, "found"), cut(raw, "found-inst")
    if p.sample is not None and total > p.sample.size:
        raw = scale.from_samples(raw, tiles)
    audit_rows = rescued = None
    if p.rescue is not None:
        bases = searched.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
        l = p.discover.l or min(31, max(8, math.ceil(1 + math.log(max(bases, 1), 4))))  # noqa: E741
        known = raw.withColumn("instance_idx", F.monotonically_increasing_id())
        r = p.rescue
        families, raw, verdicts, segments = recall_rescue(seqs, families, cut(known, "known"), l, p.discover, r.l_delta, r.max_families, r.least_gap, r.flank, r.full, p.library.chunk)
        audit_rows, rescued = rescue_audit(segments, verdicts), rescue_statistics(verdicts)
    said(1, "discover", families, raw)
    k = min(31, max(8, math.ceil(1 + math.log(max(total, 1), 4))))
    rows = cut(kmers.kmer_rows(seqs, k), "kmers")
    index = cut(kmers.positions(rows, kmers.frequent(kmers.count_kmers(seqs, k))).drop("rank"), "index")
    n = raw.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))
    kept = cut(select.compact(families, n, k, p.discover.good_length).select("family_id", "new_id", "consensus", "consensus_length"), "compact")
    if trace is not None:
        numbers = kept.select("family_id", "new_id")
        said(2, "compact", kept.drop("family_id").withColumnRenamed("new_id", "family_id"), raw.join(numbers, "family_id").drop("family_id").withColumnRenamed("new_id", "family_id"))
    kept = kept.select(F.col("new_id").alias("family_id"), "consensus", "consensus_length")
    families, instances = refine.refine_families(kept, index, pieces, k, p.refine)
    families, instances = merge_families(families, instances, index, pieces, k, p)
    said(3, "merge", families, instances)
    families, instances, audit = split_families(families, instances, index, pieces, k, p)
    said(4, "split", families, instances)
    families, instances = assemble_fragments(families, instances, index, pieces, k, p)
    said(5, "assemble", families, instances)
    if p.refine.recruit_short:
        instances = refine.recruit_short(families, instances, seqs, pieces, k, p.refine)
    ok = "state in ('exclusive', 'standalone')"
    selected = cut(select.select_library(instances, families, p.library.mode), "selected")
    said(6, "mdl_select", selected.where(ok).join(families.select("family_id", "consensus"), "family_id"), instances.join(selected.where(ok), "family_id", "left_semi"))
    selected = cut(select.prune_redundant(selected, instances), "pruned")
    said(7, "prune", selected.where(ok).join(families.select("family_id", "consensus"), "family_id"), instances.join(selected.where(ok), "family_id", "left_semi"))
    summary = select.library_summary(selected, instances, max(total, 1))
    reported = instances
    if p.library.coalesce_factor > 0:
        merged = select.coalesce_tandem(instances, families, p.library.coalesce_factor)
        reported = merged.withColumn("divergence", F.least(F.lit(1.0), F.col("num_edits") / (F.col("end") - F.col("start"))))
    reported = cut(reported, "reported")
    said(8, "coalesce", selected.where(ok).join(families.select("family_id", "consensus"), "family_id"), reported.join(selected.where(ok), "family_id", "left_semi"))
    means = reported.groupBy("family_id").agg(F.avg("divergence").alias("_d"))
    selected = select.drop_chimeras(selected.join(means, "family_id", "left").withColumn("mean_divergence", F.coalesce("_d", "mean_divergence")).drop("_d"))
    capped = reported.groupBy("family_id").count().where(F.col("count") >= p.refine.max_instances).count()
    if capped:
        warnings.warn(f"{capped} families at the instance cap of {p.refine.max_instances}: their copies and scores are truncated", stacklevel=2)
    return Library(families, selected, reported, summary, audit, audit_rows, capped, rescued)
