"""Rules and options beside the main path: unions across bins, chains, flank growth, audits, sampling, reports."""

from __future__ import annotations

import random

import numpy as np
import pytest
from genomes import mutate, planted, random_seq
from pyspark.sql import functions as F

from strandlake import cli, report
from strandlake.operators import assemble, intervals, kernels, kmers, merge, scale, select
from strandlake.operators.discover import discover_families, pack
from strandlake.operators.hot_keys import join_hot, join_salted
from strandlake.plans import pipeline
from strandlake.plans.config import DiscoverParams, LibraryParams, Params, RefineParams, RescueParams, SampleParams
from strandlake.sources import synthetic
from strandlake.storage import cut


def test_union_across_bins(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), s := rng.randrange(-50, 900), s + rng.choice([-1, 0, 1, 5, 30, 200])) for _ in range(300)]
    df = spark.createDataFrame(rows, "seq_index int, start long, end long")
    want = set()
    for rec in range(3):
        merged = []
        for s, e in sorted((s, e) for r, s, e in rows if r == rec and e > s):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want |= {(rec, s, e) for s, e in merged}
    for width in (1, 7, 64, 1 << 20):
        got = [tuple(r) for r in intervals.interval_union(df, ["seq_index"], width=width).collect()]
        assert set(got) == want and len(got) == len(want), width


def test_kmer_kernel_against_column_expressions(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ACGTN", [5, 5, 5, 5, i % 2], k=rng.choice([0, 3, 30, 700, 2500])))) for i in range(24)]
    rows += [(100, "ACACAC" * 300), (101, "N" * 50), (102, None), (103, "A" * 1200)]
    s = spark.createDataFrame(rows, "seq_index long, seq string")
    for k in (1, 2, 5, 16, 31):
        plain = kmers._long_kmer_rows(s, k, 60)
        assert sorted(map(tuple, kmers.kmer_rows(s, k, tile=50).collect())) == sorted(map(tuple, plain.collect())), k
        for tandem in (1, 500):
            assert sorted(map(tuple, kmers.count_kmers(s, k, tandem, tile=70).collect())) == sorted(map(tuple, kmers.kmer_counts(plain, tandem).collect()))
    assert kmers.kmer_rows(s, 40).count() == kmers._long_kmer_rows(s, 40, 20_000).count()


def test_joins_of_hot_keys(spark):
    rows = cut(spark.range(20_000).select((F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 3000)).alias("k"), "id"), "rows")
    table = cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")), "table")
    plain = sorted(tuple(r) for r in rows.join(table, "k").select("k", "id", "n", "m").collect())
    assert sorted(tuple(r) for r in join_hot(rows, table, ["k"], "n", 20_000).select("k", "id", "n", "m").collect()) == plain
    salted = join_salted(rows, table, "k", F.col("id"), least=100)
    assert sorted(tuple(r) for r in salted.select("k", "id", "n", "m").collect()) == plain


def test_tandem_coalescing_against_a_plain_fold(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), i, rng.randrange(2), s := rng.randrange(2000), s + rng.randrange(1, 60), rng.choice([1, -1]), rng.randrange(5)) for i in range(400)]
    inst = spark.createDataFrame(rows, "family_id long, instance_idx long, seq_index int, start long, end long, strand int, num_edits int")
    fams = spark.createDataFrame([(f, 3 + f) for f in range(3)], "family_id long, consensus_length int")
    want = []
    for fam in range(3):
        for rec in range(2):
            active, most = None, max(50, 2 * (3 + fam))
            for s, e, strand, _, edits in sorted((r[3], r[4], r[5], r[1], r[6]) for r in rows if r[0] == fam and r[2] == rec):
                if active and active[0] == strand and -10 <= s - active[2] <= most:
                    if e > active[2]:
                        active[3] += edits + max(0, s - active[2])
                        active[2] = e
                    active[4] += 1
                else:
                    active = [strand, s, e, edits, 1]
                    want.append((fam, rec, active))
    got = select.coalesce_tandem(inst, fams, factor=2.0)
    assert sorted((r.family_id, r.seq_index, r.strand, r.start, r.end, r.num_edits, r.merged) for r in got.collect()) == sorted((f, r, *a) for f, r, a in want)
    assert got.schema["seq_index"].dataType.simpleString() == "int"


def test_medians_and_thinning_without_gathering(spark):
    rng = random.Random(7)
    gaps = {(a, 9): [rng.randrange(-5, 30) for _ in range(n)] for a, n in ((1, 2), (2, 3), (3, 10), (4, 501))}
    counts = spark.createDataFrame([(a, b, g, 1) for (a, b), l in gaps.items() for g in l], "a long, b long, gap long, c long").groupBy("a", "b", "gap").agg(F.sum("c").alias("c"))
    got = {r.a: (r.n, r["median"]) for r in assemble.upper_median(counts, ["a", "b"], "gap", "c").collect()}
    assert got == {a: (len(l), sorted(l)[len(l) // 2]) for (a, _), l in gaps.items()}
    rows = [(f, i, rng.randrange(3), rng.randrange(1 << 22)) for f, n in ((0, 5), (1, 57)) for i in range(n)]
    inst = spark.createDataFrame(rows, "family_id long, instance_idx long, seq_index int, start long")
    kept = {(r.family_id, r.instance_idx) for r in assemble.thinned(inst, most=10).collect()}
    ordered = {f: sorted((s, p, i) for g, i, s, p in rows if g == f) for f in (0, 1)}
    assert kept == {(0, x[2]) for x in ordered[0]} | {(1, ordered[1][j][2]) for j in range(0, 50, 5)}


def test_profiles_of_unlike_sizes_form_no_pair(spark):
    rng = random.Random(8)
    base = random_seq(rng, 400)
    seqs = spark.createDataFrame([(0, base), (1, mutate(rng, base, 0.02)), (2, base[:120]), (3, random_seq(rng, 400))], "id long, seq string")
    assert [(r.a, r.b) for r in merge.jaccard_pairs(seqs, least=0.15, ratio=0.7).collect()] == [(0, 1)]
    assert {(r.a, r.b) for r in merge.jaccard_pairs(seqs, least=0.15).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_long_pairs_merge_by_profiles_and_places(spark):
    genome, truth, units = planted(31, 18_000, [(7, 400, 0.01)])
    seqs = spark.createDataFrame([(0, genome)], "seq_index long, seq string")
    lib = pipeline.build_library(seqs, Params(refine=RefineParams(rounds=1, max_dp_cells=1)))  # none may be aligned
    spans = [(r.start, r.end) for r in lib.instances.collect()]
    assert sum(any(s < b and a < e for a, b in spans) for s, e, _ in truth) >= 6
    found = lib.families.select("consensus").collect()
    assert sum(abs(len(r.consensus) - 400) < 40 for r in found) == 1  # equal ones were united all the same


def test_flank_growth_stops_where_copies_part():
    rng = random.Random(9)
    shared = np.array([rng.randrange(4) for _ in range(700)], np.uint8)
    s = kernels.Scores()
    for copies, longest, whole in ((6, 3_000, False), (6, 500, True)):
        block = np.full((copies, longest + 64), kernels.OUTSIDE, np.uint8)
        for row in block:
            own = np.array([rng.randrange(4) for _ in range(longest + 64)], np.uint8)
            own[s.band : s.band + 700] = shared[: len(own[s.band : s.band + 700])]
            row[:] = own
        codes, full = kernels.extend_flank(lambda c: block[:, c : c + 2 * s.band + 1], copies, longest, s)
        assert full == whole and (codes[: min(690, longest - 5)] == shared[: min(690, longest - 5)]).all() and len(codes) <= min(longest, 760)


def test_band_cells_against_their_definition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        band, n = int(rng.integers(0, 6)), int(rng.integers(1, 5))
        s = kernels.Scores(band=band, gap=-int(rng.integers(0, 7)))
        prev, window = rng.integers(-40, 40, (n, 2 * band + 1)), rng.integers(0, 6, (n, 2 * band + 1)).astype(np.uint8)
        got = kernels._columns(prev, window, s)
        for base in range(4):
            for row, bases, cells in zip(prev.tolist(), window.tolist(), got[base].tolist(), strict=True):
                for j, cell in enumerate(cells):
                    ways = [row[i] + (j - i) * s.gap + (s.match if base in bases[i : j + 1] else s.mismatch) for i in range(j + 1)]
                    ways += [row[j + 1] + s.gap] if j + 1 < len(row) else []
                    assert cell == (0 if bases[j] == kernels.OUTSIDE else max(ways))


def test_chunks_follow_the_records(spark):
    rng = random.Random(10)
    lengths = [rng.randrange(0, 3000) for _ in range(60)] + [25_000]
    seqs = spark.createDataFrame([(i, "A" * n) for i, n in enumerate(lengths)], "seq_index long, seq string")
    rows = pipeline.chunked(seqs, 5_000, 0).collect()
    assert sum(len(r.seq) for r in rows) == sum(lengths)
    order = sorted(rows, key=lambda r: (r.seq_index, r.start))
    assert [r.chunk for r in order] == sorted(r.chunk for r in rows)
    load = {}
    for r in rows:
        load[r.chunk] = load.get(r.chunk, 0) + len(r.seq)
    assert max(load.values()) <= 5_000 + 9_000


def test_given_seeds_only(spark):
    genome, truth, units = planted(12, 6_000, [(6, 300, 0.0)])
    tiles = spark.createDataFrame([(0, 0, 0, genome)], "chunk long, seq_index long, start long, seq string")
    found, _ = discover_families(tiles, DiscoverParams(l=10))
    assert found.count() >= 1
    none, _ = discover_families(tiles, DiscoverParams(l=10), spark.createDataFrame([], "lmer string"))
    assert none.count() == 0
    one, _ = discover_families(tiles, DiscoverParams(l=10), spark.createDataFrame([(units[0][100:110],), ("ACGT",)], "lmer string"))
    assert [units[0] in r.consensus or r.consensus_length > 250 for r in one.collect()] == [True]
    assert pack("ACGTTG") == pack("CAACGT")


def test_sampled_windows_come_back_to_their_records(spark):
    seqs = spark.createDataFrame([(0, "A" * 950), (1, "C" * 80), (2, "G" * 400)], "seq_index long, seq string")
    lengths = seqs.select("seq_index", F.length("seq").cast("long").alias("length"))
    tiles = scale.sample_tiles(lengths, 100, 5)
    made = {r.seq_index: r.seq for r in scale.sampled_sequences(seqs, tiles).collect()}
    assert len(made) == 5 and all(len(s) == 100 for s in made.values())
    inst = spark.createDataFrame([(n, 3, 7) for n in made], "seq_index long, start long, end long")
    back = {(r.seq_index, r.start) for r in scale.from_samples(inst, tiles).collect()}
    assert back == {(r.seq_index, r.start + 3) for r in tiles.collect()}


def test_library_with_trace_rescue_and_sample(spark, tmp_path):
    genome, truth, _ = planted(14, 18_000, [(6, 300, 0.02)])
    seqs = spark.createDataFrame([(0, genome)], "seq_index long, seq string")
    seen = []
    params = Params(refine=RefineParams(rounds=1, recruit_short=True), library=LibraryParams(), rescue=RescueParams(flank=20))
    lib = pipeline.build_library(seqs, params, lambda number, name, families, instances: seen.append((number, name, families.count(), instances.count())))
    assert [s[:2] for s in seen] == list(enumerate(["discover", "compact", "merge", "split", "assemble", "mdl_select", "prune", "coalesce"], 1))
    assert seen[0][2] >= 1 and len(lib.rescue_audit.columns) == 15 and len(lib.split_audit.columns) == 19
    assert lib.split_audit.count() == lib.split_audit.where("decision is not null").count()
    params = Params(refine=RefineParams(rounds=1, max_instances=2), library=LibraryParams(coalesce_factor=0.0), sample=SampleParams(size=12_000, window=1_000))
    with pytest.warns(UserWarning, match="instance cap"):
        part = pipeline.build_library(seqs, params)
    assert part.capped >= 1 and part.instances.groupBy("family_id").count().agg(F.max("count")).first()[0] == 2


def test_command_line(spark, tmp_path):
    genome, _, _ = planted(15, 18_000, [(5, 250, 0.0)])
    (tmp_path / "g.fa").write_text(f">chr one\n{genome}\n")
    out = {n: str(tmp_path / n) for n in ("lib", "bed", "stats", "trace", "split", "rescue", "freq")}
    args = ["-sequence", str(tmp_path / "g.fa"), "-output", out["lib"], "-instances", out["bed"], "-stats", out["stats"], "-trace-dir", out["trace"]]
    args += ["-split-audit", out["split"], "-rescue-audit", out["rescue"], "-recall-rescue", "-freq-output", out["freq"], "-l", "10"]
    args += ["-coalesce-factor", "0"]  # copies less than 20 lengths apart would be reported as one
    assert cli.main(args, spark) == 0
    heads = [r.value for r in spark.read.text(out["lib"]).collect() if r.value.startswith(">")]
    assert heads and all(" topo=linear " in h and " qflags=" in h for h in heads)
    assert spark.read.csv(out["freq"], sep="\t").count() > 0 and (tmp_path / "trace" / "08_coalesce").exists()
    assert spark.read.csv(out["bed"], sep="\t").count() >= 5
    again = ["-sequence", str(tmp_path / "g.fa"), "-output", out["lib"], "-freq", out["freq"], "-l", "10"]
    assert cli.main(again, spark) == 0
    for bad in (["-chunk-size", "5"], ["-sample-size", "50"], ["-window-size", "50"], ["-recall-rescue", "-rescue-l-delta", "9"]):
        with pytest.raises(ValueError):
            cli.parameters(cli.parser().parse_args(["-sequence", "x", "-output", "y", *bad]))


def test_report(spark, tmp_path, capsys):
    (tmp_path / "p.bed").write_text("c\t100\t200\tp\t0\t+\nc\t900\t950\tq\t0\t+\n")
    (tmp_path / "t.bed").write_text("c\t100\t200\tL1\t0\t-\nc\t500\t600\tL2\t0\t-\n")
    base = ["--predicted", str(tmp_path / "p.bed"), "--truth", str(tmp_path / "t.bed")]
    assert report.main([*base, "--ignore-strand", "--by-class", "--output", str(tmp_path / "o.tsv")], spark) == 0
    lines = (tmp_path / "o.tsv").read_text().splitlines()
    assert lines[:2] == ["class\tTP\tFP\tFN\tprecision\trecall\tF1", "__overall__\t1\t1\t1\t0.5000\t0.5000\t0.5000"] and len(lines) == 5
    assert report.main(base, spark) == 0 and "__overall__\t0\t2\t2" in capsys.readouterr().out
    assert report.main([*base, "--min-overlap", "0"], spark) == 2
    assert report.main(["--predicted", str(tmp_path / "no"), "--truth", str(tmp_path / "t.bed")], spark) == 2


def test_backgrounds(spark):
    rng = random.Random(16)
    chain = "".join(rng.choice("AC") if i % 2 else "G" for i in range(120_000))
    seqs = spark.createDataFrame([(0, "N" * 10 + chain), (1, "T" * 50)], "seq_index long, seq string")
    initial, successors = synthetic.markov_model(seqs)
    assert initial[2] == pytest.approx(0.5, abs=0.01) and successors[2][3] < 0.001 and successors[0][2] > 0.99
    made = synthetic.markov_seq(np.random.default_rng(1), 5_000, initial, successors)
    assert len(made) == 5_000 and "GG" not in made and set(made) <= set("ACGT")
    with pytest.raises(ValueError):
        synthetic.markov_model(seqs.where("seq_index = 1"))
    assert synthetic.low_complexity("A" * 40) and synthetic.low_complexity("ACGT" * 30) and not synthetic.low_complexity(random_seq(rng, 400))
    assert len(synthetic.planted(1, 800, [(2, 50, 0.0)], background=(initial, successors))[0]) == 800
    assert synthetic.mutate_indels(rng, "A" * 200, 0.1, 0.05) != "A" * 200


def test_sieve_and_antijoin_keep_columns_of_any_name(spark):
    from strandlake.operators.antijoin import without_keys
    from strandlake.operators.sieve import BitSieve

    names = ["k", "_at", "_page", "_bitmap", "_may", "_sieveat", "a.b"]
    rows = [(i, *[f"{i}{n}" for n in names[1:]]) for i in range(50)]
    df = spark.createDataFrame(rows, names)
    keys = spark.createDataFrame([(i,) for i in range(0, 50, 5)], "k long")
    marked = BitSieve(keys, ["k"]).may_hold(df, [F.col("k")], "seen")
    assert marked.columns == [*names, "seen"]
    assert sorted(tuple(r)[:-1] for r in marked.collect()) == sorted(rows) and all(r.seen for r in marked.collect() if r.k % 5 == 0)
    left = without_keys(df, keys, "k")
    assert left.columns == names and sorted(map(tuple, left.collect())) == sorted(r for r in rows if r[0] % 5)
