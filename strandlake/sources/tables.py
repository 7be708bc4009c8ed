"""BED, l-mer and alignment tables in; BED and statistics tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import mdl
from strandlake.functions.seq import canonical, low_entropy, periodic


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, name, score, strand): comments, track and browser lines, lines of fewer than three columns,
    unparsable numbers and empty intervals are skipped; a missing name, score or strand is '.'."""
    return parse_bed(spark.read.text(path))


def parse_bed(lines: DataFrame) -> DataFrame:
    v = F.rtrim(F.col("value"), F.lit("\r"))
    kept = lines.where(~v.rlike(r"^\s*$|^#|^track|^browser")).select(F.split(v, "\t").alias("c")).where(F.size("c") >= 3)
    opt = lambda i: F.coalesce(F.nullif(F.get("c", F.lit(i)), F.lit("")), F.lit("."))
    rows = kept.select(
        F.get("c", F.lit(0)).alias("chrom"), F.expr("try_cast(trim(c[1]) as bigint)").alias("start"), F.expr("try_cast(trim(c[2]) as bigint)").alias("end"),
        opt(3).alias("name"), opt(4).alias("score"), opt(5).alias("strand"),
    )
    return rows.where("start is not null and end is not null and end > start")


def read_lmers(spark: SparkSession, path: str, l: int) -> DataFrame:  # noqa: E741
    """(lmer, freq, pos) of a whitespace-separated table, up to its first repeated l-mer, without low-entropy and
    periodic ones. A length other than ``l`` is an error."""
    lines = spark.read.text(path).withColumn("_i", F.monotonically_increasing_id())
    c = F.split(F.trim("value"), r"\s+")
    rows = lines.select("_i", c.alias("c")).select("_i", F.col("c")[0].alias("lmer"), F.col("c")[1].cast("int").alias("freq"), F.col("c")[2].cast("long").alias("pos"))
    if rows.where(F.length("lmer") != l).limit(1).count():
        raise ValueError(f"the table has l-mers of another length than {l}")
    again = rows.withColumn("_k", canonical("lmer")).withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy("_i")))
    stop = again.where("_r > 1").agg(F.min("_i")).first()[0]
    kept = again if stop is None else again.where(F.col("_i") < stop)
    return kept.where(~low_entropy("lmer") & ~periodic("lmer")).select("lmer", "freq", "pos")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular alignment hits (tab-separated)."""
    return spark.read.csv(
        path, sep="\t", schema="query string, subject string, identity double, coverage double, qstart long, qend long, sstart long, send long, strand string, score double"
    )


def instances_bed(instances: DataFrame, sequences: DataFrame, selected: DataFrame) -> DataFrame:
    """(chrom, start, end, name, score, strand) of accepted families' instances; score is 1000 (1 - divergence), cut to
    0..1000 and truncated."""
    ok = selected.where("state in ('exclusive', 'standalone')").select("family_id")
    rows = instances.join(ok, "family_id", "left_semi").join(sequences.select("seq_index", "seq_id"), "seq_index")
    return rows.select(
        F.col("seq_id").alias("chrom"), "start", "end", F.concat(F.lit("R="), "family_id").alias("name"), bed_score("divergence").alias("score"),
        F.when(F.col("strand") > 0, "+").otherwise("-").alias("strand"),
    )


def bed_score(divergence):
    return F.greatest(F.lit(0), F.least(F.lit(1000), (1000 * (1 - F.col(divergence))).cast("int")))


def family_statistics(selected: DataFrame) -> DataFrame:
    """The statistics table of all families, rejected ones included."""
    return selected.select(
        "family_id", "consensus_length", F.col("n").alias("num_instances"), F.col("mean_divergence").alias("divergence_mean"), F.col("score").alias("mdl_score"),
        "model_cost", F.lit("linear").alias("topology"), F.col("score").alias("standalone_score"), "exclusive_score", "exclusive_bases", "exclusive_instances",
        F.col("state").alias("acceptance"), F.col("tier").alias("quality_tier"), "quality_flags", mdl.flag_names("quality_flags").alias("quality_notes"),
    )


def sequence_statistics(seqs: DataFrame) -> DataFrame:
    """One row: count, total, shortest, mean and longest length, GC share."""
    n = F.length("seq")
    gc = F.sum(F.length(F.regexp_replace("seq", "[^GC]", "")))
    return seqs.agg(
        F.count(F.lit(1)).alias("num_seqs"), F.sum(n).alias("sum_len"), F.min(n).alias("min_len"), F.avg(n).alias("avg_len"), F.max(n).alias("max_len"),
        (gc / F.sum(F.length(F.regexp_replace("seq", "[^ACGT]", "")))).alias("gc"),
    )
