"""Byte ranges of FASTA files give the records, names and k-mers that whole records give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import kmers
from strandlake.sources import fasta, fasta_ranges


def _whole(parts):
    """Records of parts, after a check that the parts follow each other without gap or overlap."""
    out = {}
    for r in sorted(parts.collect(), key=lambda r: (r.seq_index, r.at)):
        name, seq, length = out.get(r.seq_index, (r.seq_id, "", r.length))
        assert (name, length, r.at) == (r.seq_id, r.length, len(seq))
        out[r.seq_index] = (name, seq + r.seq, length)
    assert all(len(s) == n for _, s, n in out.values())
    return [(i, *out[i][:2]) for i in sorted(out)]


def _folder(path, files):
    path.mkdir()
    for name, text in files.items():
        (path / name).write_bytes(text)
    return str(path)


ODD = {
    "a.fa": b"ACGTnn\nxx12\n>one first\r\nacgt\r\n\r\nGGCC\r\n>\n>   \n\n>two\n>three\ttab\nAC GT-*\n>" + b"n" * 1500 + b" rest\nTT\n> spaced\nAA>CC\n>last",
    "b.fa": b">\n>x\nAC",
    "c.fa": b"  \n>" + "été\U0001f9ec z".encode() + b"\nAC" + "é".encode() + b"GT\n",
    "d.fa": b"",
    "e one.fa": b">w\n" + b"ACGTTGCA" * 50,
}


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_ranges_give_the_records_that_whole_reading_gives(spark, tmp_path, size):
    path = _folder(tmp_path / "f", ODD)
    want = sorted(tuple(r) for r in fasta.read_fasta(spark, path).collect())
    assert [n for _, n, _ in want].count("w") == 1 and len(want) == 11
    assert _whole(fasta_ranges.read_parts(spark, path, size)) == want


def test_random_files_at_random_sizes(spark, tmp_path):
    rng = random.Random(3)
    for turn in range(2):
        text = "".join(rng.choice([">", "\n", "\n>", "A", "c", " ", "\r\n", "-", "GT", ">n"]) for _ in range(400)).encode()
        path = _folder(tmp_path / str(turn), {"a.fa": text})
        want = sorted(tuple(r) for r in fasta.read_fasta(spark, path).collect())
        assert _whole(fasta_ranges.read_parts(spark, path, rng.randint(2, 60))) == want, (turn, text)


def test_tiles_and_counts_of_a_record_in_many_ranges(spark, tmp_path):
    rng = random.Random(5)
    long = "".join(rng.choice("ACGT") for _ in range(3000))
    long = long + long[:700] + "N" * 5 + long[100:400] * 3
    records = [long, "ACGTAC", "", "ACGTACG", long[500:1500]]
    path = _folder(tmp_path / "f", {"a.fa": "".join(f">r{i}\n{s}\n" for i, s in enumerate(records)).encode()})
    parts = fasta_ranges.read_parts(spark, path, 100)
    assert parts.where("seq_index = 0").count() >= 45
    got = fasta_ranges.tiles(parts, tile=250, before=30, after=6)
    want = [
        (i, max(0, t - 30), t, s[max(0, t - 30) : t + 250 + 6]) for i, s in enumerate(records) for t in range(0, len(s) - 6, 250)
    ]
    assert sorted(tuple(r) for r in got.collect()) == want
    seqs = spark.createDataFrame(list(enumerate(records)), "seq_index int, seq string")
    count = lambda df: sorted(tuple(r) for r in df.collect())
    own = fasta_ranges.tiles(parts, tile=250, before=99, after=6)
    assert count(kmers.count_in_tiles(own, 7, 100)) == count(kmers.count_kmers(seqs, 7, 100))
    rows = kmers.tile_kmer_rows(fasta_ranges.tiles(parts, tile=250, after=6), 7)
    assert count(rows) == count(kmers.kmer_rows(seqs, 7))


def test_no_records(spark, tmp_path):
    path = _folder(tmp_path / "f", {"a.fa": b"", "b.fa": b" \r\n\n"})
    parts = fasta_ranges.read_parts(spark, path)
    assert parts.count() == 0 and fasta_ranges.tiles(parts).count() == 0
    assert parts.agg(F.sum("length")).first()[0] is None
