"""Kernels, sources, evaluation and the whole analysis on small planted genomes."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from genomes import mutate, planted, random_seq, reverse_complement
from pyspark.sql import functions as F

from strandlake.operators import evaluate, intervals, kernels, kmers, rescue, scale
from strandlake.operators.discover import discover_chunk
from strandlake.operators.graph import connected_components
from strandlake.plans.config import DiscoverParams, LibraryParams, Params, RefineParams
from strandlake.plans.pipeline import build_library
from strandlake.sources import fasta, tables
from strandlake.streaming.kmers import running_counts


def covered(truth, found):
    bases = set()
    for s, e in found:
        bases.update(range(s, e))
    return sum(sum(x in bases for x in range(s, e)) for s, e, _ in truth) / sum(e - s for s, e, _ in truth)


# ---- kernels


def test_semiglobal():
    rng = random.Random(1)
    q = random_seq(rng, 200)
    t = random_seq(rng, 100) + q + random_seq(rng, 100)
    assert kernels.semiglobal(kernels.encode(q), kernels.encode(t)) == (1.0, 1.0)
    m = mutate(rng, q, 0.1)
    identity, share = kernels.semiglobal(kernels.encode(m), kernels.encode(t))
    assert 0.85 < identity <= 0.95 and share > 0.95
    assert kernels.semiglobal(kernels.encode(q), kernels.encode(t), most_cells=100) is None
    assert kernels.semiglobal(kernels.encode(q[:50]), kernels.encode(t)) is None


def test_semiglobal_score_against_plain_recurrence():
    rng = random.Random(2)
    for _ in range(20):
        q, t = random_seq(rng, rng.randrange(5, 30)), random_seq(rng, rng.randrange(5, 40))
        h = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
        for i in range(1, len(q) + 1):
            h[i][0] = -2 * i
            for j in range(1, len(t) + 1):
                h[i][j] = max(h[i - 1][j - 1] + (2 if q[i - 1] == t[j - 1] else -3), h[i - 1][j] - 2, h[i][j - 1] - 2)
        r = kernels.semiglobal(kernels.encode(q), kernels.encode(t), least=0)
        aligned = round(r[1] * len(q))
        assert r is not None and 0 <= r[0] <= 1 and aligned <= len(q) and max(h[-1]) >= -2 * len(q)


def test_pairwise_stops_at_the_end_of_similarity():
    rng = random.Random(3)
    shared = random_seq(rng, 150)
    cons = shared + random_seq(rng, 100)
    genome = random_seq(rng, 12) + mutate(rng, shared, 0.04) + random_seq(rng, 124)
    columns, score = kernels.pairwise(kernels.encode(cons)[None, :], np.array([250]), np.pad(kernels.encode(genome), (0, 300), constant_values=5)[None, : 250 + 24])
    assert 140 <= columns[0] <= 165 and score[0] > 100


def test_discovery_finds_planted_families():
    genome, truth, units = planted(5, 60_000, [(12, 300, 0.04), (10, 200, 0.0)], both_strands=True)
    found = discover_chunk([(0, 0, genome)], DiscoverParams())
    assert 1 <= len(found) <= 40
    spans = [(i["start"], i["end"]) for f in found for i in f["instances"]]
    assert covered(truth, spans) > 0.8 and all(0 <= s < e <= len(genome) for s, e in spans)
    exact = [f["consensus"] for f in found]
    assert any(units[1] in c or reverse_complement(units[1]) in c for c in exact)
    assert discover_chunk([(0, 0, "ACGT")], DiscoverParams()) == [] and discover_chunk([], DiscoverParams()) == []
    nothing = discover_chunk([(0, 0, random_seq(random.Random(1), 3_000))], DiscoverParams(min_threshold=4))
    assert nothing == []


# ---- relational operators


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3), (999, 999)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_overlap_join_lists_each_pair_once(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, s := rng.randrange(2_000), s + rng.randrange(0, 400)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, rec long, start long, end long")
    for width in (7, 100, 5_000):
        got = [(r.a_id, r.b_id) for r in intervals.overlap_join(df, df, ["rec"], width).collect()]
        want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]}
        assert len(got) == len(set(got)) and set(got) == want


def test_overlap_join_of_short_and_very_long_intervals(spark):
    rng = random.Random(7)
    make = lambda n, sizes: [(i, i % 2, s := rng.randrange(-500, 40_000), s + rng.choice(sizes), "x") for i in range(n)]
    left, right = make(300, (0, 1, 30, 45, 300, 9_000)), make(200, (2, 10, 41, 700, 90_000))
    a, b = (spark.createDataFrame(rows, "id long, rec long, start long, end long, l string") for rows in (left, right))
    for touching, pile in ((0, None), (15, 20), (0, 3)):
        got = [(r.a_id, r.b_id) for r in intervals.overlap_join(a, b, ["rec"], 10, touching, pile).collect()]
        want = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] < y[3] + touching and y[2] - touching < x[3] and x[2] < x[3] and y[2] < y[3]}
        assert len(got) == len(set(got)) and set(got) == want
    one = spark.createDataFrame([(0, 0, 0, 10**9, "x")], a.schema)
    assert intervals.overlap_join(one, a, ["rec"], 10).count() == sum(x[1] == 0 and x[2] < x[3] and x[3] > 0 for x in left)
    assert intervals.overlap_join(a.where("false"), b, ["rec"], 10, pile=1).count() == 0


def test_piled_up_intervals_are_dealt_over_tasks(spark):
    n = 3_000
    rows = spark.range(n).select(F.col("id"), F.lit(1).alias("rec"), (F.col("id") % 7).alias("start"), (F.col("id") % 7 + 20).alias("end"))
    pairs = intervals.overlap_join(rows.repartition(4), rows, ["rec"], 100, pile=100).where("a_id < b_id")
    by_task = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == n * (n - 1) // 2
    assert len(by_task) == 4 and max(r["count"] for r in by_task) < n * n // 4


def test_tandem_counts_against_sequential_counter(spark):
    rng = random.Random(8)
    seqs = [(i, "".join(rng.choices("ACGTN", weights=[5, 1, 1, 1, 0.2], k=rng.randrange(0, 400)))) for i in range(12)]
    got = {r.kmer: r.freq for r in kmers.kmer_counts(kmers.kmer_rows(spark.createDataFrame(seqs, "seq_index long, seq string"), 4, tile=50), 30).collect()}
    want: dict[str, int] = {}
    for _, s in seqs:
        last: dict[tuple[str, bool], int] = {}
        for p in range(len(s) - 3):
            f = s[p : p + 4]
            if "N" not in f:
                r = reverse_complement(f)
                key = (min(f, r), f > r)
                want.setdefault(key[0], 0)
                want[key[0]] += p - last.get(key, -(10**6)) >= 30
                last[key] = p
    assert got == want


def test_scale(spark):
    lengths = spark.createDataFrame([(0, 1000), (1, 150), (2, 4000)], "seq_index long, length long")
    parts = scale.split_records(lengths, 500, 10).collect()
    for rec, n in ((0, 1000), (1, 150), (2, 4000)):
        bases = sorted((p.start, p.end) for p in parts if p.seq_index == rec)
        assert bases[0][0] == 0 and bases[-1][1] == n and all(b[0] <= a[1] for a, b in zip(bases, bases[1:]))
    packed = scale.pack_segments([(i, 10 * i + 1) for i in range(20)], 300)
    assert set(packed) == set(range(20)) and len(set(packed.values())) == max(2, -(-sum(10 * i + 1 for i in range(20)) // 300))
    assert scale.pack_segments([], 5) == {}
    tiles = [tuple(r) for r in scale.sample_tiles(lengths, 100, 5).collect()]
    assert tiles == [tuple(r) for r in scale.sample_tiles(lengths.repartition(7), 100, 5).collect()] and len(tiles) == 5
    assert scale.sample_tiles(lengths, 10_000, 5).collect() == []


def test_rescue_identity():
    rng = random.Random(9)
    a = random_seq(rng, 100)
    assert rescue.window_identity(a, a) == rescue.window_identity(a, reverse_complement(a)) == 1.0
    assert rescue.window_identity(a, a[10:95]) == 1.0 and rescue.window_identity(a, a[:50]) == 0.0 and rescue.window_identity("", a) == 0.0


# ---- evaluation and files


def bed(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, chrom string, start long, end long, name string, strand string")


def test_metrics(spark):
    truth = [("c", 100, 200, "L1", "+"), ("c", 500, 600, "L2", "-")]
    perfect = evaluate.interval_metrics(bed(spark, truth), bed(spark, truth)).first()
    assert (perfect.precision, perfect.recall, perfect.f1) == (1.0, 1.0, 1.0)
    pred = bed(spark, [("c", 170, 250, "x", "+")])
    assert tuple(evaluate.interval_metrics(pred, bed(spark, truth[:1])).first())[:3] == (0, 1, 1)
    assert tuple(evaluate.interval_metrics(pred, bed(spark, truth[:1]), least=0.2).first())[:3] == (1, 0, 0)
    by = {r.name: (r.tp, r.fp, r.fn) for r in evaluate.class_metrics(bed(spark, [("c", 100, 200, "p", "."), ("z", 1, 2, "q", "+")]), bed(spark, truth)).collect()}
    assert by == {"L1": (1, 0, 0), "L2": (0, 0, 1), "__unmatched_pred__": (0, 1, 0)}
    with pytest.raises(ValueError):
        evaluate.interval_metrics(pred, pred, least=0)


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nac-g*t 12\nNRY\n>two\n\n>three\nGG\r\nTT\n")
    got = [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()]
    assert got == [(0, "one", "ACGTACGTNNN"), (1, "two", ""), (2, "three", "GGTT")]
    (tmp_path / "b.fa").write_text("ACGT\nAA\n")
    assert [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "b.fa")).collect()] == [(0, "", "ACGTAA")]
    (tmp_path / "x.bed").write_text("# c\ntrack x\nchr1\t5\t9\tn\t0\t+\nchr1\t9\t5\nchr1\ta\t5\nchr1\t7\nchr2\t1\t2\n\n")
    assert sorted(tuple(r) for r in tables.read_bed(spark, str(tmp_path / "x.bed")).collect()) == [("chr1", 5, 9, "n", "0", "+"), ("chr2", 1, 2, ".", ".", ".")]
    (tmp_path / "l.tsv").write_text("ACGTTGCA\t5\t10\nAAAAAAAA\t4\t3\nACGGTCAT\t3\t7\nTGCAACGT\t2\t1\nCCGATTGA\t2\t9\n")
    assert [r.lmer for r in tables.read_lmers(spark, str(tmp_path / "l.tsv"), 8).collect()] == ["ACGTTGCA", "ACGGTCAT"]
    with pytest.raises(ValueError):
        tables.read_lmers(spark, str(tmp_path / "l.tsv"), 9)


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([(0, "ACGTACGT")], "seq_index long, seq string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq_index long, seq string").parquet(f"{tmp_path}/in")
    q = running_counts(stream, 4).writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    # ACGT twice, CGTA and its reverse complement TACG, GTAC
    assert {r[0]: r[1] for r in spark.sql("select * from running").collect()} == {"ACGT": 2, "CGTA": 2, "GTAC": 1}


def test_parameters():
    for bad in (lambda: RefineParams(max_divergence=2), lambda: RefineParams(band=40), lambda: LibraryParams(mode="x"), lambda: DiscoverParams(min_threshold=1)):
        with pytest.raises(ValueError):
            bad()


# ---- the whole analysis


def test_library_end_to_end(spark):
    genome, truth, _ = planted(11, 16_000, [(8, 400, 0.05), (6, 250, 0.02)], both_strands=True)
    other, truth2, _ = planted(12, 2_000, [])
    seqs = spark.createDataFrame([(0, genome), (1, other), (2, "")], "seq_index long, seq string")
    params = Params(refine=RefineParams(rounds=2), library=LibraryParams(coalesce_factor=0.0))
    lib = build_library(seqs, params)
    ok = lib.selected.where("state in ('exclusive', 'standalone')")
    n = ok.count()
    assert 1 <= n <= 8
    spans = [(r.start, r.end) for r in lib.instances.join(ok, "family_id", "left_semi").where("seq_index = 0").collect()]
    assert covered(truth, spans) > 0.75
    summary = lib.summary.first()
    assert 0 <= summary.ratio <= 1 and summary.bases_covered >= 0.75 * sum(e - s for s, e, _ in truth)
    lengths = {0: len(genome), 1: len(other)}
    assert all(0 <= r.start < r.end <= lengths[r.seq_index] and r.strand in (1, -1) for r in lib.instances.collect())
    text = [r[0] for r in fasta.library_fasta(lib.selected, lib.families).collect()]
    assert len(text) == n and all(t.startswith(">R=") for t in text)
    assert tables.family_statistics(lib.selected).count() == lib.families.count()
    assert lib.split_audit.where(F.col("decision").isNull()).count() == 0


def test_seed_hits_with_sizes_spare_only_what_the_cap_drops(spark):
    from strandlake.operators import kmers, recruit

    rng = random.Random(5)
    seqs = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=300))) for i in range(30)], "seq_index long, seq string")
    fams = spark.createDataFrame([(f, "".join(rng.choices("ACGT", k=60))) for f in range(5)], "family_id long, consensus string")
    cons, rows = recruit.consensus_kmers(fams, 4), kmers.kmer_rows(seqs, 4)
    sizes = kmers.count_kmers(seqs, 4, tandem=1).withColumnRenamed("freq", "n")
    for most in (1, 37, 500, 100_000):
        want = sorted(map(tuple, recruit.seed_hits(cons, rows, most).collect()))
        assert want and sorted(map(tuple, recruit.seed_hits(cons, rows, most, sizes=sizes).collect())) == want


def test_tiles_are_drawn_in_many_tasks(spark):
    """One row of lengths is many windows."""
    lengths = spark.createDataFrame([(1, 1_000_000), (2, 150)], "seq_index long, length long").coalesce(1)
    want = sorted((hashlib.md5(f"42:{s}:{t}".encode()).hexdigest(), s, t) for s, n in ((1, 10_000), (2, 1)) for t in range(n))[:7]
    drawn = scale.sample_tiles(lengths, 100, 7)
    assert [(r.seq_index, r.tile) for r in drawn.collect()] == [x[1:] for x in want]
    assert "REPARTITION_BY_NUM" in drawn._jdf.queryExecution().executedPlan().toString()
