"""FASTA in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import mdl
from strandlake.functions.seq import normalise, wrap


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_index, seq_id, seq): records of FASTA files in file order.

    Spark splits the text at ``\\n>``, so one record is one row and large files are read by many tasks. Records are
    numbered within their split, and a table of one row per split, which is all that is brought together, adds the
    records of the splits before. Sequence characters up to code 64 are dropped, case is folded, and letters other
    than ACGT become N. Text before the first header is a record without a name.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")
    )
    raw = raw.withColumn("_m", F.monotonically_increasing_id())
    opens = raw.where("_b = 0").groupBy("_f").agg(F.min("_m").alias("_open"))  # one row per file: nothing stands before its first record
    text = raw.where(F.trim(F.regexp_replace("value", "[\\r\\n]", "")) != "").withColumn("_k", F.monotonically_increasing_id())
    splits = text.groupBy("_f", "_b").agg(F.min("_k").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("_f", "_b", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).join(opens, "_f")
    parts = text.join(F.broadcast(splits), ["_f", "_b"]).withColumn("_first", F.col("_m") == F.col("_open"))
    parts = parts.withColumn("_head", ~F.col("_first") | F.col("value").startswith(">"))
    body = F.when(F.col("_first"), F.regexp_replace("value", "^>", "")).otherwise(F.col("value"))
    parts = parts.withColumn("_v", body)
    name = F.when(F.col("_head"), F.regexp_extract("_v", r"^([^\s]*)", 1)).otherwise(F.lit(""))
    seq = F.when(F.col("_head"), F.regexp_replace("_v", r"^[^\n]*\n?", "")).otherwise(F.col("_v"))
    number = (F.col("_before") + F.col("_k") - F.col("_least")).cast("int")
    return parts.select(number.alias("seq_index"), F.substring(name, 1, 1023).alias("seq_id"), normalise(seq).alias("seq"))


def library_fasta(selected: DataFrame, families: DataFrame) -> DataFrame:
    """Text lines of accepted families, best score first: a header with the family's figures and the wrapped consensus."""
    ok = selected.where("state in ('exclusive', 'standalone')").join(families.select("family_id", "consensus"), "family_id")
    head = F.format_string(
        ">R=%d length=%d copies=%d mdl=%.1f div=%.3f topo=linear accept=%s tier=%s flags=0x%08x qflags=%s",
        "family_id", "consensus_length", "n", "score", "mean_divergence", "state", "tier", "quality_flags", mdl.flag_names("quality_flags"),
    )
    return ok.orderBy(F.desc("score"), "family_id").select(F.concat(head, F.lit("\n"), wrap("consensus")).alias("value"))


def segments_fasta(segments: DataFrame) -> DataFrame:
    """Text lines of sequence segments, headed name:start-end."""
    head = F.format_string(">%s:%d-%d\n", "seq_id", "start", "end")
    return segments.select(F.concat(head, wrap("seq")).alias("value"))
