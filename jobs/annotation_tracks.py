"""Writes annotation tracks: where, on each record, repeats of each class lie.

    python -m jobs.annotation_tracks --tables FOLDER --output FOLDER [--config FILE]

A library's instances overlap and come in thousands of families; a genome browser or a masking step wants one interval
per place and class. Families are scored by description length; those that save bits and have ``least_copies`` instances
stay, with their instances up to ``max_divergence``. Per class and record instances that touch become one track item with
its instances, families, mean divergence (weighted by length), BED score and the best family.

``output/class=N`` holds a class. Only classes that the run makes are overwritten (dynamic partition overwrite):
``classes`` names those to make anew, and [] is all. A rerun writes the same rows; one that fails leaves a class as it
was, or to be written by the next run.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobs.settings import log, log_to_stderr, settings
from strandlake import adapters
from strandlake.operators.intervals import interval_union, overlap_join
from strandlake.operators.select import family_scores
from strandlake.sources.tables import bed_score

_TRACK = "seq_index long, start long, end long, instances long, families long, divergence double, score int, best_family long, class int"


def track_items(instances: DataFrame, families: DataFrame, classes: DataFrame, least_copies: int, max_divergence: float, width: int) -> DataFrame:
    """(class, seq_index, start, end, instances, families, divergence, score, best_family) of ``instances``; ``classes`` has
    (family_id, class). Families without a class, and instances without length, are left out."""
    scored = family_scores(instances, families).where((F.col("score") > 0) & (F.col("n") >= least_copies))
    known = scored.join(classes, "family_id").select("family_id", "class", F.round("score", 6).alias("bits"))
    own = instances.where((F.col("divergence") <= max_divergence) & (F.col("end") > F.col("start"))).join(known, "family_id")
    keys = ["class", "seq_index"]
    own = own.select(*keys, "start", "end", "family_id", "bits", "divergence")
    # an instance lies in one merged interval, so this pairs each with one row however many meet at a place
    pairs = overlap_join(interval_union(own, keys), own, keys, width)
    item = ["a_class", "a_seq_index", "a_start", "a_end"]
    size = F.col("b_end") - F.col("b_start")
    # doubles are added in order of place: where the mean lies at half a unit, the order decides how it is rounded
    order = W.partitionBy(*item).orderBy("b_start", "b_end", "b_divergence").rowsBetween(W.unboundedPreceding, W.currentRow)
    pairs = pairs.withColumn("_size", size).withColumns({"_at": F.count(F.lit(1)).over(order), "_sum": F.sum(F.col("b_divergence") * F.col("_size")).over(order)})
    mean = F.max_by("_sum", "_at") / F.sum("_size")
    best = F.max(F.struct(F.col("b_bits"), (-F.col("b_family_id")).alias("f")))
    items = pairs.groupBy(*item).agg(
        F.count(F.lit(1)).alias("instances"), F.count_distinct("b_family_id").alias("families"),
        (F.round(mean * 1e6) / 1e6).alias("divergence"), best.alias("best"),
    )
    return items.select(
        F.col("a_class").alias("class"), F.col("a_seq_index").alias("seq_index"), F.col("a_start").alias("start"), F.col("a_end").alias("end"),
        "instances", "families", "divergence", bed_score("divergence").alias("score"), (-F.col("best.f")).alias("best_family"),
    )


def run(spark: SparkSession, tables: str, output: str, **changes) -> DataFrame:
    """Makes the tracks of ``tables`` and returns all that is below ``output`` then."""
    conf, say = settings("annotation_tracks", **changes), log("annotation_tracks")
    read, written = Observation(), Observation()
    instances = adapters.instances(spark, tables).observe(read, F.count(F.lit(1)).alias("rows"))
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("class")
    classes = adapters.table(spark, tables, "part").select(F.col("p_partkey").alias("family_id"), brand).where("class is not null")
    if conf["classes"]:
        classes = classes.where(F.col("class").isin(conf["classes"]))
    items = track_items(instances, adapters.families(spark, tables), classes, conf["least_copies"], conf["max_divergence"], conf["bin_width"])
    items = items.observe(written, F.count(F.lit(1)).alias("rows")).select([c.split()[0] for c in _TRACK.split(", ")])
    ordered = items.repartitionByRange("class", "seq_index", "start").sortWithinPartitions("class", "seq_index", "start")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("class").parquet(output)
    say.info("read %s from %s; wrote %d track items to %s", "instances", tables, written.get["rows"], output)
    return spark.read.schema(_TRACK).parquet(output)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="annotation_tracks", description="Annotation tracks of a library's instances")
    for name in ("tables", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="JSON file that changes some of annotation_tracks.json")
    a = p.parse_args(argv)
    log_to_stderr()
    spark = SparkSession.builder.appName("annotation_tracks").getOrCreate()
    try:
        run(spark, a.tables, a.output, **settings("annotation_tracks", a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
