"""Command line: precision and recall of predicted BED intervals against a truth, as a table."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.evaluate import class_metrics, interval_metrics
from strandlake.sources.tables import read_bed


def report_lines(pred: DataFrame, truth: DataFrame, least: float, by: str, by_class: bool) -> list[str]:
    """A header, the overall row and, with ``by_class``, one row per truth name."""
    rows = [("__overall__", interval_metrics(pred, truth, least, by).first())]
    if by_class:
        rows += sorted((r["name"], r) for r in class_metrics(pred, truth, least, by).collect())  # one row per class
    shown = [f"{name}\t{r['tp']}\t{r['fp']}\t{r['fn']}\t{r['precision']:.4f}\t{r['recall']:.4f}\t{r['f1']:.4f}" for name, r in rows]
    return ["class\tTP\tFP\tFN\tprecision\trecall\tF1", *shown]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake.report", description=__doc__)
    p.add_argument("--predicted", required=True, type=Path)
    p.add_argument("--truth", required=True, type=Path)
    p.add_argument("--min-overlap", type=float, default=0.5)
    p.add_argument("--overlap-mode", choices=("pred", "truth", "min"), default="min")
    p.add_argument("--ignore-strand", action="store_true")
    p.add_argument("--by-class", action="store_true")
    p.add_argument("--output", type=Path)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 2 for an overlap outside (0, 1] or a missing file."""
    a = parser().parse_args(argv)
    if not 0.0 < a.min_overlap <= 1.0:
        print("--min-overlap must be in (0, 1]", file=sys.stderr)
        return 2
    for what, path in (("predicted", a.predicted), ("truth", a.truth)):
        if not path.exists():
            print(f"{what} not found: {path}", file=sys.stderr)
            return 2
    spark = spark or SparkSession.builder.appName("strandlake-report").getOrCreate()
    beds = []
    for path in (a.predicted, a.truth):
        bed = read_bed(spark, str(path)).withColumn("id", F.monotonically_increasing_id())
        beds.append(bed.withColumn("strand", F.lit(".")) if a.ignore_strand else bed)
    text = "\n".join(report_lines(*beds, a.min_overlap, a.overlap_mode, a.by_class)) + "\n"
    if a.output:
        a.output.write_text(text)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
