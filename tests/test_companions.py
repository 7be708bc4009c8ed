"""Merge gate, boundary growth, rescue, audits and the command line."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from genomes import mutate, planted, random_seq

from strandlake import cli
from strandlake.operators import assemble, boundary, kmers, merge, rescue
from strandlake.operators.refine import Pieces
from strandlake.plans.config import DiscoverParams, Params
from strandlake.plans.rescue import recall_rescue
from strandlake.sources import audit


def test_merge_gate(spark):
    inst = spark.createDataFrame(
        [(f, i, 0, 1000 * i, 1000 * i + 200, 200, e, e / 200) for f, e in ((0, 4), (1, 6), (2, 90)) for i in range(3)],
        "family_id long, instance_idx long, seq_index long, start long, end long, aligned_length int, num_edits int, divergence double",
    )
    lengths = spark.createDataFrame([(0, 200), (1, 200), (2, 200)], "id long, length int")
    pairs = spark.createDataFrame([(0, 1, 0.95), (1, 2, 0.5)], "a long, b long, identity double")
    got = {(r.a, r.b): r.net for r in merge.merge_gate(pairs, inst, lengths).collect()}
    assert (0, 1) in got and got[0, 1] > 0
    nested = {(r.inner, r.outer): r.fraction for r in merge.nested_fraction(inst, 200).collect()}
    assert nested[0, 1] == nested[1, 0] == 1.0


def test_boundary_growth(spark):
    rng = random.Random(2)
    unit = random_seq(rng, 260)
    genome, rows = "", []
    for i in range(6):
        genome += random_seq(rng, 300)
        start = len(genome) + 30
        genome += unit
        rows.append((0, i, 0, start, start + 200, 0, 200, 1))
    genome += random_seq(rng, 300)
    fams = spark.createDataFrame([(0, unit[30:230], 200)], "family_id long, consensus string, consensus_length int")
    inst = spark.createDataFrame(rows, "family_id long, instance_idx long, seq_index long, start long, end long, cons_start int, cons_end int, strand int")
    pieces = Pieces(spark.createDataFrame([(0, genome)], "seq_index long, seq string"))
    flanks = boundary.end_flanks(fams, inst, pieces)
    got = boundary.extend_boundaries(fams, flanks).first()
    assert unit in got.consensus and 30 <= got.ext5 <= 45 and 30 <= got.ext3 <= 45
    few = boundary.extend_boundaries(fams, boundary.end_flanks(fams, inst.where("instance_idx < 2"), pieces)).first()
    assert (few.ext5, few.ext3, few.consensus) == (0, 0, unit[30:230])


def test_rescue_finds_what_is_uncovered(spark):
    genome, truth, units = planted(21, 20_000, [(6, 200, 0.0), (5, 150, 0.0)])
    seqs = spark.createDataFrame([(0, genome)], "seq_index long, seq string")
    known = [t for t in truth if t[2] == 0]
    fams = spark.createDataFrame([(0, units[0], 200)], "family_id long, consensus string, consensus_length int")
    inst = spark.createDataFrame([(0, i, 0, s, e, 0, 0.0, 1) for i, (s, e, _) in enumerate(known)], "family_id long, instance_idx long, seq_index long, start long, end long, num_edits int, divergence double, strand int")
    merged, moved, verdicts, segments = recall_rescue(seqs, fams, inst, 12, DiscoverParams(), flank=20)
    rows = merged.collect()
    assert any(r.discovery_flags == 256 for r in rows) and sorted(r.family_id for r in rows) == list(range(len(rows)))
    assert {r.family_id for r in moved.select("family_id").distinct().collect()} == {r.family_id for r in rows}
    log = audit.rescue_audit(segments, verdicts)
    assert len(log.columns) == 15 and log.where("record_type = 'target_segment'").count() == segments.count() > 0
    assert log.where("decision = 'append' and reason = 'kept'").count() == merged.where("discovery_flags = 256").count()
    assert log.where("record_type = 'candidate'").count() == verdicts.count()
    with pytest.raises(ValueError):
        recall_rescue(seqs, fams, inst, 12, DiscoverParams(), l_delta=9)
    pairs = spark.createDataFrame([(1, 2, 0.9, 0.9, 0.9), (3, 2, 0.9, 0.1, 0.9)], "query_id long, target_id long, ratio double, identity double, fraction double")
    left = rescue.without_duplicates(spark.createDataFrame([(1,), (3,), (4,)], "family_id long"), pairs)
    assert sorted(r[0] for r in left.collect()) == [3, 4]


def in_turn(ids, evidence, least=0.8):
    """The candidates one after another, each against all known families and the candidates kept so far."""
    out, kept = {}, []
    for i in sorted(ids):
        there = sorted((not k, t, r, d, f) for q, t, k, r, d, f in evidence if q == i and (k or (t < q and t in kept)))
        match, best, dropped = (None, None, 0.0, 0.0, 0.0), 0.0, False
        for later, t, r, d, f in there:
            if r * d * f > best:
                match, best = (t, not later, r, d, f), r * d * f
            if min(r, d, f) >= least:
                match, dropped = (t, not later, r, d, f), True
                break
        if not dropped:
            kept.append(i)
        out[i] = (not dropped, *match, not dropped and min(match[2:4]) >= least and match[4] >= 0.5)
    return out


EVIDENCE = "query_id long, target_id long, known boolean, ratio double, identity double, fraction double"


def test_candidates_are_judged_in_order(spark):
    rng = random.Random(4)
    ids = rng.sample(range(500), 90)
    steps = [0.0, 0.3, 0.5, 0.79, 0.8, 0.9, 1.0]
    rows = {}
    for q in ids:
        for _ in range(8):
            known = rng.random() < 0.15
            rows[q, rng.choice(ids if not known else range(20)), known] = tuple(rng.choice(steps[rng.randrange(5):]) for _ in range(3))
    evidence = [(*k, *v) for k, v in rows.items()]
    fams = spark.createDataFrame([(i,) for i in ids], "family_id long")
    judged = rescue.judge_in_order(fams, spark.createDataFrame(evidence, EVIDENCE))
    got = {r.family_id: tuple(r)[1:] for r in judged.collect()}
    assert got == in_turn(ids, evidence) and 0 < sum(v[0] for v in got.values()) < len(ids)
    told = rescue.statistics(judged).first()
    assert (told.candidates, told.appended, told.duplicates) == (90, sum(v[0] for v in got.values()), sum(not v[0] for v in got.values()))
    assert told.near_duplicates == sum(v[6] for v in got.values()) and told.max_identity == max(v[4] for v in got.values())


def test_of_equal_candidates_one_stays(spark):
    fams = spark.createDataFrame([(3,), (5,), (9,)], "family_id long")
    equal = spark.createDataFrame([(5, 3, False, 1.0, 1.0, 1.0), (9, 5, False, 1.0, 1.0, 1.0), (9, 3, False, 0.9, 0.9, 0.6), (3, 3, False, 1.0, 1.0, 1.0)], EVIDENCE)
    got = {r.family_id: (r.kept, r.matched_id, r.near) for r in rescue.judge_in_order(fams, equal).collect()}
    assert got == {3: (True, None, False), 5: (False, 3, False), 9: (True, 3, True)}
    chain = [(i, i - 1, False, 1.0, 1.0, 1.0) for i in range(1, 12)]
    fams = spark.createDataFrame([(i,) for i in range(12)] + [(4,)], "family_id long")
    got = rescue.judge_in_order(fams, spark.createDataFrame(chain, EVIDENCE)).where("kept").collect()
    assert sorted(r.family_id for r in got) == [0, 2, 4, 6, 8, 10]
    alone = rescue.judge_in_order(fams, spark.createDataFrame([(2, None, True, None, 1.0, 1.0)], EVIDENCE))
    assert alone.where("kept and matched_id is null and ratio = 0").count() == 12
    assert rescue.judge_in_order(fams.where("false"), equal).count() == 0


def test_assembly_work_is_counted_without_a_join(spark):
    rng = random.Random(8)
    starts = [(r, rng.choice([rng.randrange(4_000_000), 1_048_570 + rng.randrange(12), 500])) for r in (0, 1) for _ in range(150)] + [(7, 10)]
    df = spark.createDataFrame([(i % 3, i, r, s) for i, (r, s) in enumerate(starts)], "family_id long, instance_idx long, seq_index long, start long")
    for distance in (0, 9, 700_000):
        got = {r.seq_index: (r.instances, r.comparisons) for r in assemble.comparisons(df, distance).collect()}
        for r in (0, 1, 7):
            own = sorted(s for q, s in starts if q == r)
            assert got[r] == (len(own), sum(b - a <= distance for i, a in enumerate(own) for b in own[i + 1 :]))
    assert assemble.comparisons(df.where("false"), 9).count() == 0


def test_kmers_that_span_records(spark):
    rng = random.Random(12)
    texts = [random_seq(rng, n) for n in (40, 1, 0, 2, 1, 1, 30, 3, 9, 10, 11, 25, 4)]
    texts[9] = "ACGNACGTAC"
    table = [(70_000 * (i % 3) + i, t) for i, t in enumerate(texts)]
    seqs = spark.createDataFrame([*table, (5_000_000, None)], "seq_index int, seq string").repartition(3)
    flip = str.maketrans("ACGT", "TGCA")
    for k in (1, 2, 6, 12):
        want, whole = [], "".join(t for _, t in sorted(table))
        g = 0
        for i, t in sorted(table):
            for pos in range(len(t)):
                f = whole[g + pos : g + pos + k]
                if len(f) == k and "N" not in f:
                    b = f.translate(flip)[::-1]
                    want.append((i, pos, min(f, b), f > b, g + pos))
            g += len(t)
        rows = kmers.spanning_rows(seqs, k, tile=7)
        assert sorted(map(tuple, rows.collect())) == sorted(want)
        for tandem in (1, 5, 30) if k == 2 else (30,):
            seen, last = {}, {}
            for *_, kmer, rev, at in sorted(want, key=lambda r: r[-1]):
                seen[kmer] = seen.get(kmer, 0) + (at - last.get((kmer, rev), -1000) >= tandem)
                last[kmer, rev] = at
            assert {r.kmer: r.freq for r in kmers.spanning_counts(rows, tandem, stretch=32).collect()} == seen
    assert kmers.spanning_rows(seqs.where("false"), 5).count() == 0 and kmers.spanning_rows(seqs.where("length(seq) < 2"), 4).count() == 0
    with pytest.raises(ValueError):
        kmers.spanning_counts(rows, 0)


def test_quality_report(spark):
    seqs = spark.createDataFrame([("ACGT",), ("GG",)], "seq string")
    stats, said = audit.quality_report(seqs, "auto", tool="no-such-tool", path="x")
    r = stats.first()
    assert (r.num_seqs, r.sum_len, r.min_len, r.max_len) == (2, 6, 2, 4) and "not installed" in said
    with pytest.raises(FileNotFoundError):
        audit.quality_report(seqs, "require", tool="no-such-tool", path="x")
    with pytest.raises(ValueError):
        audit.quality_report(seqs, "maybe")


def test_command_line_parameters():
    a = cli.parser().parse_args(["-sequence", "x", "-output", "y"])
    assert cli.parameters(a) == Params()
    b = cli.parser().parse_args(["-sequence", "x", "-output", "y", "-max-divergence", "0.2", "-mdl-mode", "upper"])
    assert cli.parameters(b).refine.max_divergence == 0.2 and cli.parameters(b).library.mode == "upper"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["-output", "y"])
    assert len(mutate(random.Random(1), "A" * 100, 0.1).replace("A", "")) == 10


def test_kernels_look_at_bounded_slices():
    """whatever the batch, some hundred thousand bases at a time."""
    tiles = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([0] * 100), pa.array([0] * 100), pa.array(["ACGT" * 2500] * 99 + ["C" * 300_000])], names=["seq_index", "at", "first", "part"])
    slices = list(kmers._sliced(iter([tiles.slice(0, 0), tiles.slice(1)])))
    assert [i for s in slices for i in s.column(0).to_pylist()] == list(range(1, 100))
    assert all(s.num_rows == 1 or sum(map(len, s.column(3).to_pylist())) <= kmers._SLICE for s in slices)


def test_spanning_counts_from_stretches(spark):
    """the counts of the rows, from stretches of the text that are shorter or longer than records, k-mers and distances."""
    rng = random.Random(21)
    texts = [random_seq(rng, n) for n in (40, 1, 0, 2, 1, 1, 30, 3, 9, 10, 11, 25, 4)] + ["ACACACACAC" * 4, "ACGNACGTAC"]
    seqs = spark.createDataFrame([*((70_000 * (i % 3) + i, t) for i, t in enumerate(texts)), (5_000_000, None)], "seq_index int, seq string").repartition(3)
    for k, tandem, stretch in ((1, 1, 7), (2, 5, 16), (6, 30, 50), (12, 30, 5), (4, 30, 100_000)):
        want = sorted(map(tuple, kmers.spanning_counts(kmers.spanning_rows(seqs, k), tandem).collect()))
        assert sorted(map(tuple, kmers.count_spanning(seqs, k, tandem, stretch).collect())) == want
    assert kmers.count_spanning(seqs.where("false"), 5).count() == 0


def test_capped_positions_leave_out_what_the_cap_drops(spark):
    """the rows of ``positions``, of which those behind the range that fills a k-mer's cap are not exchanged."""
    rng = random.Random(22)
    rows = [(7 * i - 50, random_seq(rng, rng.randrange(40))) for i in range(60)] + [(None, "ACGTTGCA"), (900, None)]
    seqs = spark.createDataFrame(rows, "seq_index long, seq string").repartition(3)
    for k, most, parts, few in ((2, 5, 8, 1 << 20), (3, 1, 64, 0), (3, 1000, 4, 10)):
        want = kmers.positions(kmers.kmer_rows(seqs, k), kmers.frequent(kmers.count_kmers(seqs, k, 6)), most)
        names = ["kmer", "seq_index", "pos", "is_rev", "rank"]
        got = kmers.capped_positions(seqs, k, most=most, tandem=6, parts=parts, few=few)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(names).collect()))
    assert kmers.capped_positions(seqs.where("false"), 3).count() == 0
