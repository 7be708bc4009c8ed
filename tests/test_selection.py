"""Selection, pruning and post-processing on fixtures with exact expectations."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import folds

from strandlake.functions import mdl
from strandlake.operators import select

INST = "family_id long, instance_idx long, seq_index long, start long, end long, aligned_length int, num_edits int, divergence double, strand int"


def make(spark, families, length=200):
    """families: {id: [(start, edits)]}"""
    rows = [(f, i, 0, s, s + length, length, e, e / length, 1) for f, items in families.items() for i, (s, e) in enumerate(items)]
    return spark.createDataFrame(rows, INST), spark.createDataFrame([(f, length) for f in families], "family_id long, consensus_length int")


def union(items):
    return len({x for s, e in items for x in range(s, e)})


def test_identical_positions_of_three(spark):
    inst, fams = make(spark, {0: [(1000, 2), (5000, 3), (9000, 1)], 1: [(1000, 15), (5000, 12), (9000, 18)]})
    got = {r.family_id: r for r in select.select_library(inst, fams).collect()}
    assert (got[0].state, got[1].state, got[1].tier) == ("exclusive", "standalone", "warn")
    both = mdl.BIT["standalone_fallback"] | mdl.BIT["no_exclusive_bases"]
    assert got[1].quality_flags & both == both
    s = select.library_summary(select.select_library(inst, fams), inst, 100_000).first()
    assert s.accepted == 2 and s.bases_covered == 600 and 0 <= s.ratio <= 1


def test_identical_positions_of_two(spark):
    inst, fams = make(spark, {0: [(1000, 2), (5000, 3)], 1: [(1000, 15), (5000, 12)]})
    got = {r.family_id: r for r in select.select_library(inst, fams).collect()}
    assert (got[0].state, got[1].state) == ("exclusive", "rejected") and got[1].score > 0


def test_disjoint(spark):
    inst, fams = make(spark, {0: [(1000, 2), (5000, 3), (9000, 1)], 1: [(20000, 2), (30000, 3), (40000, 1)]})
    sel = select.select_library(inst, fams)
    assert [(r.tier, r.quality_flags) for r in sel.collect()] == [("core", 0), ("core", 0)]
    assert select.library_summary(sel, inst, 100_000).first().bases_covered == 1200


@pytest.mark.parametrize("genome", [100_000, 4_000_000_000])
def test_coverage_equals_union(spark, genome):
    inst, fams = make(spark, {f: [(f * 100 + i * 1000, 5) for i in range(5)] for f in range(3)})
    sel = select.select_library(inst, fams)
    ok = [r.family_id for r in sel.collect() if r.state in ("exclusive", "standalone")]
    want = union([(r.start, r.end) for r in inst.collect() if r.family_id in ok])
    assert ok and select.library_summary(sel, inst, genome).first().bases_covered == want


def selected(spark, scores):
    return spark.createDataFrame([(f, s, "exclusive", 0) for f, s in scores.items()], "family_id long, score double, state string, quality_flags int")


def test_prune_one_of_three(spark):
    same = [(1000, 0), (3000, 0), (5000, 0)]
    inst, _ = make(spark, {0: same, 1: same, 2: [(10000, 0), (12000, 0), (14000, 0)]})
    got = {r.family_id: r.state for r in select.prune_redundant(selected(spark, {0: 100.0, 1: 200.0, 2: 300.0}), inst).collect()}
    assert got == {0: "pruned", 1: "exclusive", 2: "exclusive"}


def test_prune_keeps_disjoint_families(spark):
    inst, _ = make(spark, {f: [(f * 400, 0)] for f in range(10_000)})
    sel = selected(spark, {f: float(f) for f in range(10_000)})
    assert select.prune_redundant(sel, inst).where("state = 'pruned'").count() == 0


@pytest.mark.parametrize("seed,stretch", [(7, 1 << 16), (8, 300), (9, 1000)])
def test_selection_and_pruning_equal_the_folds(spark, seed, stretch):
    """Crowded libraries, long and short families, so that decisions hang on each other over many."""
    rng = random.Random(seed)
    rows, fams = [], {}
    for f in range(60):
        fams[f] = rng.choice((30, 60, 90))
        for i in range(rng.randrange(1, 6)):
            rec, start, n = rng.randrange(2), rng.randrange(-20, 2500), rng.choice((0, 40, 80, 120))
            edits = rng.randrange(0, n // 4 + 1)
            rows.append((f, i, rec, start, start + n, n, edits, edits / n if n else 0.0, 1))
    inst, table = spark.createDataFrame(rows, INST), spark.createDataFrame(list(fams.items()), "family_id long, consensus_length int")
    by = {f: [(r[2], r[3], r[4], r[7]) for r in rows if r[0] == f] for f in fams}
    selected = select.select_library(inst, table, stretch=stretch)
    got = {r.family_id: r for r in selected.collect()}
    want = folds.select({f: (r.score, r.model_cost, r.consensus_length, r.n) for f, r in got.items()}, by)
    assert {f: (got[f].state, got[f].exclusive_bases, got[f].exclusive_instances) for f in want} == {f: w[:3] for f, w in want.items()}
    assert {w[0] for w in want.values()} == {"exclusive", "standalone", "rejected"}
    assert all(got[f].state == "rejected" for f in set(fams) - set(want))
    for f, (_, bases, _, total) in want.items():
        assert bool(got[f].quality_flags & mdl.BIT["low_exclusive_fraction"]) == (0 < bases * 4 < total)
    pruned = {r.family_id for r in select.prune_redundant(selected, inst, stretch=stretch).where("state = 'pruned'").collect()}
    accepted = {f: got[f].score for f in got if got[f].state in ("exclusive", "standalone")}
    clipped = {f: [(rec, max(0, s), max(0, s, e)) for rec, s, e, _ in v] for f, v in by.items()}
    assert pruned == folds.prune(accepted, clipped)


def test_a_chain_of_decisions(spark):
    """Each family's fate turns the next one's: as many rounds as families, and still the fold's result."""
    fams = {f: [(f * 25, 0), (100_000 + f * 25, 0)] for f in range(12)}
    inst, table = make(spark, fams, 100)
    table = table.withColumn("consensus_length", (F.lit(40) + F.col("family_id")).cast("int"))
    got = {r.family_id: r for r in select.select_library(inst, table).collect()}
    want = folds.select({f: (r.score, r.model_cost, r.consensus_length, r.n) for f, r in got.items()}, {f: [(0, s, s + 100, 0.0) for s, _ in v] for f, v in fams.items()})
    assert {f: got[f].state for f in want} == {f: w[0] for f, w in want.items()}
    assert len({w[0] for w in want.values()}) == 2


def test_later_rounds_look_only_near_families_that_changed_sides(spark, monkeypatch):
    """A chain takes many rounds, which leave the other 600 instances alone."""
    fams = {f: [(f * 25, 0), (100_000 + f * 25, 0)] for f in range(8)} | {f: [(f * 400, 2), (f * 400 + 200, 2), (500_000 + f * 400, 2)] for f in range(100, 300)}
    inst, table = make(spark, fams, 100)
    table = table.withColumn("consensus_length", F.when(F.col("family_id") < 100, F.lit(40) + F.col("family_id")).otherwise(F.lit(60)).cast("int"))
    asked, real = spark.sparkContext.accumulator(0), select.unclaimed

    def counted(rank, inside, at, to):
        asked.add(len(rank))
        return real(rank, inside, at, to)

    monkeypatch.setattr(select, "unclaimed", counted)
    got = {r.family_id: r for r in select.select_library(inst, table).collect()}
    want = folds.select({f: (r.score, r.model_cost, r.consensus_length, r.n) for f, r in got.items()}, {f: [(0, s, s + 100, e / 100) for s, e in v] for f, v in fams.items()})
    assert {f: (got[f].state, got[f].exclusive_bases) for f in want} == {f: w[:2] for f, w in want.items()}
    assert 616 <= asked.value < 2 * 616


@pytest.mark.parametrize("portion", [1, 40, 1 << 20])
def test_free_bases_of_pieces_equal_single_bases(monkeypatch, portion):
    monkeypatch.setattr(select, "_PORTION", portion)
    rng = np.random.default_rng(portion)
    for n in (0, 1, 2, 30, 90):
        at = rng.integers(0, 200, n)
        to, rank = at + rng.integers(1, 40, n), rng.integers(1, 15, n)
        inside = np.isin(rank, rng.integers(1, 15, 7))
        families = [(set(range(a, b)), r, i) for a, b, r, i in zip(at, to, rank, inside, strict=True)]
        free = [len(x - set().union(*[y for y, q, i in families if i and q < r])) for x, r, _ in families]
        alone = [len(x - set().union(*[y for y, q, i in families if q != r and (i or q > r)])) for x, r, _ in families]
        assert select.unclaimed(rank, inside, at, to).tolist() == free and select.unshared(rank, inside, at, to).tolist() == alone
        some = rng.random(n) < 0.1
        assert select._meets(some, at, to).tolist() == [any(x & families[j][0] for j in np.flatnonzero(some)) for x, *_ in families]


def test_whole_groups_of_batches():
    keys = [(0, 0)] * 3 + [(0, 1)] * 2 + [(None, 1)] * 4 + [(1, 1)] * 9 + [(2, 0)]
    table = pa.table({"a": pa.array([k[0] for k in keys], pa.int64()), "b": [k[1] for k in keys], "i": range(len(keys))})
    for size in (1, 2, 5, 100):
        for least in (1, 4, 100):
            seen = []
            for t, group in select._whole_groups(table.to_batches(size), ["a", "b"], least):
                mine = list(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True))
                assert len(set(mine)) == len(set(group.tolist())) and not set(mine) & {keys[i] for i in seen}
                assert len(set(zip(mine, group.tolist(), strict=True))) == len(set(mine))
                seen += t["i"].to_pylist()
            assert seen == list(range(len(keys)))


def test_coalesce_keeps_order_rules(spark):
    rows = [
        (0, 1, 0, 100, 200, 100, 1, 0.0, 1), (0, 2, 0, 230, 300, 70, 2, 0.0, 1), (0, 3, 0, 240, 250, 10, 9, 0.0, 1),
        (0, 4, 0, 310, 320, 10, 1, 0.0, -1), (0, 5, 0, 330, 340, 10, 1, 0.0, 1), (0, 6, 1, 335, 345, 10, 1, 0.0, 1),
    ]
    inst = spark.createDataFrame(rows, INST)
    fams = spark.createDataFrame([(0, 2)], "family_id long, consensus_length int")
    got = sorted((r.seq_index, r.start, r.end, r.strand, r.num_edits, r.merged) for r in select.coalesce_tandem(inst, fams).collect())
    # the third starts far before the active end: it opens a new interval
    assert got == [(0, 100, 300, 1, 33, 2), (0, 240, 250, 1, 9, 1), (0, 310, 320, -1, 1, 1), (0, 330, 340, 1, 1, 1), (1, 335, 345, 1, 1, 1)]


@pytest.mark.parametrize("pages", [4096, 0])
def test_who_is_in_by_bits_and_by_join(spark, monkeypatch, pages):
    """Rounds after the first read a bit per family; beyond the bits' number they join. Instances cross stretches."""
    monkeypatch.setattr(select, "_MOST_PAGES", pages)
    fams = {f: [(f * 25, 0), (100_000 + f * 25, 0)] for f in range(8)}
    inst, table = make(spark, fams, 100)
    table = table.withColumn("consensus_length", (F.lit(40) + F.col("family_id")).cast("int"))
    got = {r.family_id: r for r in select.select_library(inst, table, stretch=64).collect()}
    want = folds.select({f: (r.score, r.model_cost, r.consensus_length, r.n) for f, r in got.items()}, {f: [(0, s, s + 100, 0.0) for s, _ in v] for f, v in fams.items()})
    assert {f: got[f].state for f in want} == {f: w[0] for f, w in want.items()}


def test_bitmap_of_ranks(spark):
    state = spark.createDataFrame([(1, True), (9, False), (70_000, True)], "rank long, is_in boolean")
    bits = select._bitmap(state)
    assert len(bits) == 3 * 4096 and {i for i in range(8 * len(bits)) if bits[i >> 3] >> (i & 7) & 1} == {1, 70_000}


def test_a_mean_at_the_limit_is_high(spark):
    """Its sum may come out a bit below."""
    below = 0.24999999999999997
    rows = [(0, i, 0, 1000 * i, 1000 * i + 200, 200, 50, below, 1) for i in range(4)]
    got = select.select_library(spark.createDataFrame(rows, INST), spark.createDataFrame([(0, 200)], "family_id long, consensus_length int")).first()
    assert got.n == 4 and got.mean_divergence < 0.25 and got.quality_flags & mdl.BIT["high_divergence"]
