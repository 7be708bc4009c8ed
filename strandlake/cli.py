"""Command line: FASTA in; library, instances, statistics and audits out."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import kmers, scale
from strandlake.operators.kernels import Scores
from strandlake.plans.config import DiscoverParams, LibraryParams, Params, RefineParams, RescueParams, SampleParams
from strandlake.plans.pipeline import build_library
from strandlake.sources import audit, fasta, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake", description="Repeat families of DNA sequences")
    p.add_argument("-sequence", required=True, help="FASTA files to read")
    p.add_argument("-output", required=True, help="folder for the library")
    p.add_argument("-instances", help="folder for a BED table of instances")
    p.add_argument("-stats", help="folder for the family statistics")
    p.add_argument("-trace-dir", help="folder for Parquet tables after each stage")
    p.add_argument("-split-audit", help="folder for the split decisions")
    p.add_argument("-rescue-audit", help="folder for the targets and candidates of the rescue pass")
    p.add_argument("-freq", help="table of l-mers: only these are seeds")
    p.add_argument("-freq-output", help="folder for the table of l-mers")
    p.add_argument("-sample-output", help="folder for the FASTA of the sampled windows")
    p.add_argument("-external-qc", help="file for the external tool's statistics of the library")
    p.add_argument("-seqkit", default="seqkit", help="path of that tool")
    p.add_argument("-l", type=int)
    p.add_argument("-L", type=int, default=10_000)
    whole = {
        "minthresh": 2, "goodlength": 30, "maxgap": 5, "match": 1, "mismatch": -1, "gap": -5, "cappenalty": -20, "minimprovement": 3, "stopafter": 100,
        "tandemdist": 500, "maxoccurrences": 10_000, "maxrepeats": 100_000, "refine-gap": -5, "refine-maxoffset": 12, "max-instances": 10_000,
        "max-seed-hits": 50_000, "max-dp-cells": 10_000_000, "rescue-l-delta": 1, "rescue-maxrepeats": 2000, "rescue-min-gap": 200, "seed": 42,
    }
    for name, default in whole.items():
        p.add_argument(f"-{name}", type=int, default=default)
    p.add_argument("-chunk-size", type=int, default=20, help="chunk of discovery in millions of bases")
    p.add_argument("-sample-size", type=int, help="bases that discovery reads of larger genomes, in millions")
    p.add_argument("-window-size", type=int, default=1000, help="sampled windows in thousands of bases")
    for name, default in (("maxentropy", -0.70), ("max-divergence", 0.30), ("coalesce-factor", 20.0)):
        p.add_argument(f"-{name}", type=float, default=default)
    for name in ("recall-rescue", "rescue-full-genome", "recruit-short"):
        p.add_argument(f"-{name}", action="store_true")
    p.add_argument("-mdl-mode", default="exact", choices=["none", "exact", "upper"])
    p.add_argument("-external-tools", default="off", choices=["off", "auto", "require"])
    return p


def parameters(a: argparse.Namespace) -> Params:
    if a.chunk_size < 10:
        raise ValueError("-chunk-size is at least 10 (million bases)")
    if a.sample_size is not None and a.sample_size < 100:
        raise ValueError("-sample-size is at least 100 (million bases)")
    if not 100 <= a.window_size <= 10_000:
        raise ValueError("-window-size is 100..10000 (thousand bases)")
    scores = Scores(a.match, a.mismatch, a.gap, a.cappenalty, a.maxgap, a.minimprovement, a.stopafter, a.L)
    return Params(
        DiscoverParams(a.l, scores, a.maxoccurrences, a.maxrepeats, a.maxentropy, a.goodlength, a.minthresh, a.tandemdist),
        RefineParams(a.max_divergence, a.refine_gap, a.refine_maxoffset, a.max_instances, max(a.max_seed_hits, a.max_instances), a.max_dp_cells, recruit_short=a.recruit_short),
        LibraryParams(a.mdl_mode, a.coalesce_factor, a.chunk_size * 1_000_000),
        RescueParams(a.rescue_l_delta, a.rescue_maxrepeats, a.rescue_min_gap, full=a.rescue_full_genome) if a.recall_rescue else None,
        None if a.sample_size is None else SampleParams(a.sample_size * 1_000_000, a.window_size * 1000, a.seed),
    )


def write_lmers(seqs: DataFrame, l: int, folder: str) -> None:  # noqa: E741
    """The table of frequent l-mers (l-mer, frequency, last position), the most frequent first."""
    table = kmers.export_table(kmers.kmer_rows(seqs, l), kmers.frequent(kmers.count_kmers(seqs, l)))
    table.orderBy(F.desc("freq"), "lmer").select("lmer", "freq", "pos").write.mode("overwrite").csv(folder, sep="\t")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    params = parameters(a)
    spark = spark or SparkSession.builder.appName("strandlake").getOrCreate()
    seqs = fasta.read_fasta(spark, a.sequence)
    total = seqs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n")).first().n
    l = a.l or min(31, max(8, seqs.agg(kmers.S.auto_k(F.lit(max(total, 1)))).first()[0]))  # noqa: E741
    if a.freq_output:
        write_lmers(seqs, l, a.freq_output)
    seeds = None
    if a.freq:
        seeds = tables.read_lmers(spark, a.freq, l).where(F.col("freq") >= a.minthresh)
        params = replace(params, discover=replace(params.discover, l=l))
    if a.sample_output and params.sample is not None and total > params.sample.size:
        lengths = seqs.select("seq_index", F.length("seq").cast("long").alias("length"))
        windows = scale.sample_tiles(lengths, params.sample.window, params.sample.size // params.sample.window, params.sample.seed)
        named = windows.join(seqs, "seq_index").select(
            "seq_id", "start", "end", F.substring("seq", F.col("start").cast("int") + 1, F.lit(params.sample.window)).alias("seq")
        )
        fasta.segments_fasta(named).write.mode("overwrite").text(a.sample_output)
    trace = None if a.trace_dir is None else lambda number, name, families, instances: audit.write_trace(a.trace_dir, number, name, families, instances)
    lib = build_library(seqs, params, trace, seeds)
    fasta.library_fasta(lib.selected, lib.families).write.mode("overwrite").text(a.output)
    if lib.families.isEmpty():
        return 0  # an empty library is written alone
    if a.instances:
        bed = tables.instances_bed(lib.instances, seqs.withColumn("seq_index", F.col("seq_index").cast("long")), lib.selected)
        bed.write.mode("overwrite").csv(a.instances, sep="\t")
    if a.stats:
        audit.write_tsv(tables.family_statistics(lib.selected), a.stats)
    if a.split_audit:
        audit.write_tsv(lib.split_audit, a.split_audit)
    if a.rescue_audit and lib.rescue_audit is not None:
        audit.write_tsv(lib.rescue_audit, a.rescue_audit)
    if a.external_tools != "off":
        _, said = audit.quality_report(lib.families.select(F.col("consensus").alias("seq")), a.external_tools, tool=a.seqkit, path=a.output)
        if a.external_qc and said is not None:
            with open(a.external_qc, "w") as f:
                f.write(said)
        else:
            print(said)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
