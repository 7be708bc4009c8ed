"""Audit tables, stage traces and quality control of outputs."""

from __future__ import annotations

import shutil
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.sources.tables import sequence_statistics


def write_trace(folder: str, number: int, stage: str, families: DataFrame, instances: DataFrame) -> None:
    """One stage's families and instances as Parquet below ``folder``."""
    families.write.mode("overwrite").parquet(f"{folder}/{number:02d}_{stage}/families")
    instances.write.mode("overwrite").parquet(f"{folder}/{number:02d}_{stage}/instances")


def write_tsv(df: DataFrame, path: str) -> None:
    """A tab-separated table with a header."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def rescue_audit(segments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rescue audit: one row per target segment and per candidate of `recall_rescue`'s ``verdicts``, with its fate and
    the family that it matched best."""
    whole = lambda v: F.lit(v).cast("long").alias
    none = F.lit(0.0)
    seg = segments.select(
        F.lit("target_segment").alias("record_type"), F.lit("target").alias("decision"), F.lit("uncovered_gap").alias("reason"),
        (F.row_number().over(W.partitionBy("seq_index").orderBy("start")) - 1).cast("long").alias("source_family_id"), whole(-1)("output_family_id"),
        whole(-1)("matched_family_id"), F.col("seq_index").cast("long").alias("seq_index"), F.col("start").cast("long").alias("raw_start"),
        F.col("end").cast("long").alias("raw_end"), (F.col("end") - F.col("start")).cast("long").alias("length"), whole(0)("consensus_length"),
        whole(0)("num_instances"), none.alias("consensus_identity"), none.alias("contained_instance_fraction"), none.alias("length_ratio"),
    )
    number = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("long")
    cand = verdicts.select(
        F.lit("candidate").alias("record_type"), F.when(F.col("kept"), "append").otherwise("filter").alias("decision"),
        F.when(F.col("kept"), "kept").otherwise("duplicate_existing").alias("reason"), number("family_id").alias("source_family_id"),
        number("output_id").alias("output_family_id"), number("matched_id").alias("matched_family_id"), whole(-1)("seq_index"), whole(0)("raw_start"),
        whole(0)("raw_end"), whole(0)("length"), F.col("consensus_length").cast("long").alias("consensus_length"),
        F.col("num_instances").cast("long").alias("num_instances"), F.round("identity", 6).alias("consensus_identity"),
        F.round("fraction", 6).alias("contained_instance_fraction"), F.round("ratio", 6).alias("length_ratio"),
    )
    return seg.unionByName(cand)


def quality_report(sequences: DataFrame, mode: str = "off", tool: str = "seqkit", path: str | None = None, timeout: int = 300) -> tuple[DataFrame, str | None]:
    """Native statistics of (seq) and, by ``mode`` auto or require, an external tool's on ``path``. In mode auto a
    missing or failing tool is reported as text; in mode require it raises."""
    if mode not in ("off", "auto", "require"):
        raise ValueError("mode is off, auto or require")
    said = None
    if mode != "off" and path is not None:
        found = shutil.which(tool)
        if found:
            try:
                said = subprocess.run([found, "stats", "-T", path], capture_output=True, text=True, timeout=timeout, check=True).stdout
            except (subprocess.SubprocessError, OSError) as e:
                if mode == "require":
                    raise
                said = f"warning: {e}"
        elif mode == "require":
            raise FileNotFoundError(tool)
        else:
            said = f"warning: {tool} is not installed"
    return sequence_statistics(sequences), said
