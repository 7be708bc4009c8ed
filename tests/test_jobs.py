"""The jobs over growing input, reruns, failures and odd tables."""

from __future__ import annotations

import random
import shutil
from collections import Counter
from pathlib import Path

import pytest

from jobs import annotation_tracks, kmer_catalogue
from jobs.settings import settings

SF = "/root/testdata/sf0.001"


def put(spark, folder: Path, number: int, texts: dict[int, str | None]) -> None:
    """One more file below ``folder``."""
    folder.mkdir(exist_ok=True)
    made = folder.parent / f"made-{number}"
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(str(made))
    shutil.copy(next(made.glob("part-*.parquet")), folder / f"file-{number}.parquet")


def canonical(kmer: str) -> str:
    return min(kmer, kmer[::-1].translate(str.maketrans("ACGT", "TGCA")))


def counts(texts, k: int, tandem: int, least: int) -> dict[str, int]:
    found: Counter = Counter()
    for t in texts:
        seq = "".join(c for c in (t or "").lower() if c in "acgt").upper()
        last: dict = {}
        for i in range(len(seq) - k + 1):
            kmer = seq[i : i + k]
            at = canonical(kmer), canonical(kmer) != kmer
            found[at[0]] += at not in last or i - last[at] >= tandem
            last[at] = i
    return {m: n for m, n in found.items() if n >= least}


def files(folder: Path) -> list[str]:
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*.parquet"))


def test_catalogue_of_growing_input(spark, tmp_path):
    rng = random.Random(1)
    unit = "".join(rng.choices("acgt", k=60))
    texts = {i: "".join(rng.choices("acgt xyz", k=rng.randrange(200))) + unit[rng.randrange(30) :] for i in range(40)} | {40: None, 41: "", 42: "acg", 43: unit * 4}
    source, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    changes = {"k": 8, "tandem": 100, "max_files_per_trigger": 1}

    def run():
        return {r.kmer: r.freq for r in kmer_catalogue.run(spark, str(source), str(out), str(mark), **changes).collect()}

    def part(lo, hi):
        return {i: texts[i] for i in range(lo, hi)}

    put(spark, source, 0, part(0, 10))
    put(spark, source, 1, part(10, 20))
    assert run() == counts(part(0, 20).values(), 8, 100, 2)
    first = files(out / "deltas")
    put(spark, source, 2, part(20, 44))
    want = counts(texts.values(), 8, 100, 2)
    assert run() == want
    assert set(first) < set(files(out / "deltas"))  # what was there is not read or written again
    assert len([f for f in files(out / "deltas") if "batch=2" in f]) >= 1
    second = files(out / "deltas")
    assert run() == want and files(out / "deltas") == second  # nothing new


def test_catalogue_after_a_failed_run(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    texts = {i: "".join(rng.choices("acgt", k=80)) for i in range(12)} | {12: "acgtacgtaa" * 9}
    source, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    changes = {"k": 5, "max_files_per_trigger": 1}
    for n in range(3):
        put(spark, source, n, {i: t for i, t in texts.items() if i % 3 == n})
    real, calls = kmer_catalogue.count_kmers, []

    def fails_once(*a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*a)

    monkeypatch.setattr(kmer_catalogue, "count_kmers", fails_once)
    with pytest.raises(Exception, match="lost"):
        kmer_catalogue.run(spark, str(source), str(out), str(mark), **changes)
    got = kmer_catalogue.run(spark, str(source), str(out), str(mark), **changes)
    assert {r.kmer: r.freq for r in got.collect()} == counts(texts.values(), 5, 500, 2)
    assert not spark.streams.active


def test_catalogue_runs_a_written_batch_again(spark, tmp_path):
    """A run that ends after a batch's rows are written, before Spark commits the batch, writes the same partition again."""
    rng = random.Random(3)
    source, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    put(spark, source, 0, {i: "".join(rng.choices("acgt", k=300)) for i in range(9)})
    args = (spark, str(source), str(out), str(mark))
    want = sorted(map(tuple, kmer_catalogue.run(*args, k=4).collect()))
    for p in (mark / "commits").iterdir():
        p.unlink()
    assert sorted(map(tuple, kmer_catalogue.run(*args, k=4).collect())) == want


def test_tracks_run_twice_and_by_class(spark, tmp_path):
    tables, out = tmp_path / "tables", tmp_path / "out"
    tables.mkdir()
    for t in ("lineitem", "part"):
        shutil.copy(f"{SF}/{t}.parquet", tables)
    want = sorted(map(tuple, annotation_tracks.run(spark, str(tables), str(out)).collect()))
    assert want and sorted(map(tuple, annotation_tracks.run(spark, str(tables), str(out)).collect())) == want
    some = want[0][-1]
    before = {f for f in files(out) if f"class={some}/" not in f}
    again = annotation_tracks.run(spark, str(tables), str(out), classes=[some])
    assert sorted(map(tuple, again.collect())) == want
    assert before == {f for f in files(out) if f"class={some}/" not in f}  # other classes stay as they are


def test_track_items_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        start = rng.randrange(0, 3000)
        rows.append((rng.randrange(12), i, rng.randrange(3), start, start + rng.choice((0, 1, 20, 40, 900 if i == 7 else 30)), 30, 1, rng.choice((0.0, 0.1, 0.5)), 1))
    inst = spark.createDataFrame(rows, "family_id long, instance_idx long, seq_index long, start long, end long, aligned_length int, num_edits int, divergence double, strand int")
    fams = spark.createDataFrame([(f, 20 + f) for f in range(12)], "family_id long, consensus_length int")
    classes = spark.createDataFrame([(f, f % 2) for f in range(11)], "family_id long, class int")
    got = {(r["class"], r.seq_index, r.start, r.end): (r.instances, r.families, r.divergence) for r in annotation_tracks.track_items(inst, fams, classes, 3, 0.3, 64).collect()}
    from strandlake.operators.select import family_scores

    good = {r.family_id for r in family_scores(inst, fams).collect() if r.score > 0 and r.n >= 3}
    want = {}
    for c in range(2):
        for rec in range(3):
            own = sorted((r[3], r[4], r[0], r[7]) for r in rows if r[0] < 11 and r[0] % 2 == c and r[0] in good and r[2] == rec and r[7] <= 0.3 and r[4] > r[3])
            while own:
                end, n = own[0][1], 1
                while n < len(own) and own[n][0] <= end:
                    end, n = max(end, own[n][1]), n + 1
                item, own = own[:n], own[n:]
                size = sum(b - a for a, b, *_ in item)
                want[c, rec, item[0][0], end] = n, len({x[2] for x in item}), round(sum(x[3] * (x[1] - x[0]) for x in item) / size, 6)
    assert got == want


def test_a_mean_at_half_a_unit_is_rounded_as_its_sum_in_order_of_place(spark):
    """The exact means are 0.0771875 and 0.1621875; doubles added in order of place come to less for the first one only."""
    low = [(2376, 43, 0.04), (2389, 42, 0.0), (2392, 28, 0.0), (2405, 15, 0.05)]
    even = [(1680, 19, 0.03), (1698, 20, 0.03), (1706, 46, 0.05), (1717, 43, 0.04)]
    rows = [(rec % 3, rec, at, at + n, n, 0, 4 * d) for rec in range(40) for at, n, d in random.Random(rec).sample(low if rec % 2 else even, 4)]
    inst = spark.createDataFrame(rows, "family_id long, seq_index long, start long, end long, aligned_length int, num_edits int, divergence double").repartition(4, "start")
    fams = spark.createDataFrame([(f, 20) for f in range(3)], "family_id long, consensus_length int")
    got = annotation_tracks.track_items(inst, fams, fams.selectExpr("family_id", "1 AS class"), 3, 0.3, 64).collect()
    assert {r.seq_index: r.divergence for r in got} == {rec: 0.077187 if rec % 2 else 0.162188 for rec in range(40)}


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"k": 9}')
    assert settings("kmer_catalogue", str(tmp_path / "c.json"), least=3)["k"] == 9
    with pytest.raises(ValueError, match="wrong"):
        settings("kmer_catalogue", wrong=1)


def test_command_lines_name_their_paths(capsys):
    for job in (kmer_catalogue, annotation_tracks):
        with pytest.raises(SystemExit):
            job.main([])
        assert "--output" in capsys.readouterr().err
