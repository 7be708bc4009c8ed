"""Keeps a catalogue of strand-canonical k-mers up to date while files of sequences arrive.

    python -m jobs.kmer_catalogue --source FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]

Seeds of repeat families are frequent k-mers, and counting them is most of the work on a growing collection of
sequences. Each run reads only the Parquet files, below ``source`` or that one file, that came since the last one (a file
stream with a checkpoint, all that is there, then it ends) and adds their counts:

* ``output/deltas/batch=N``: counts of the records of one micro-batch. Spark numbers a micro-batch and its files in the
  checkpoint before it runs; one that is run again after a failure overwrites its own partition, so nothing counts twice.
* ``output/catalogue/lead=XY``: the k-mers that all deltas together hold ``least`` times, by their first bases, with
  freq and low_complexity. It is made anew from the deltas in each run: a run that fails before that is made good by the
  next, and one without new files leaves the same rows.

A record must be in one file only: k-mers that repeat within ``tandem`` bases of a record count once, which makes counts
additive over records but not over parts of one. Rows of deltas are distinct k-mers, 4^k / 2 at most a micro-batch,
however large the files are. Letters other than A, C, G and T are left out of a text.
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.settings import log, log_to_stderr, settings
from strandlake.adapters import nucleotides
from strandlake.functions.seq import low_entropy, periodic
from strandlake.operators.kmers import count_kmers, frequent

_DELTAS = "kmer string, freq long, batch long"


def run(spark: SparkSession, source: str, output: str, checkpoint: str, **changes) -> DataFrame:
    """Takes in what is new below ``source`` and returns the catalogue as it stands then."""
    conf, say = settings("kmer_catalogue", **changes), log("kmer_catalogue")
    deltas, catalogue = f"{output}/deltas", f"{output}/catalogue"
    spark.createDataFrame([], _DELTAS).write.mode("append").partitionBy("batch").parquet(deltas)  # the folder, where there is none yet

    def add(batch: DataFrame, number: int) -> None:
        seen, written = Observation(), Observation()
        seqs = batch.select(F.col(conf["id"]).alias("seq_index"), nucleotides(F.coalesce(conf["text"], F.lit(""))).alias("seq"))
        seqs = seqs.observe(seen, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))
        counts = count_kmers(seqs, conf["k"], conf["tandem"]).observe(written, F.count(F.lit(1)).alias("kmers"))
        rows = counts.withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(deltas)
        say.info("batch %d: read %d records, %d bases; wrote %d k-mers to %s", number, seen.get["records"], seen.get["bases"], written.get["kmers"], deltas)

    columns = spark.read.parquet(source).select(conf["id"], conf["text"]).schema
    pattern = f"{source.rstrip('/')[:-1]}[{source.rstrip('/')[-1]}]"  # matches the source alone; a stream takes a single file only by a pattern
    arriving = spark.readStream.schema(columns).option("maxFilesPerTrigger", conf["max_files_per_trigger"]).parquet(pattern)
    query = (
        arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .queryName(f"kmer-catalogue-{uuid.uuid4().hex}").start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()

    total = spark.read.schema(_DELTAS).parquet(deltas).groupBy("kmer").agg(F.sum("freq").alias("freq"))
    held = frequent(total, conf["least"]).withColumn("low_complexity", low_entropy("kmer") | periodic("kmer"))
    kept = Observation()
    held = held.observe(kept, F.count(F.lit(1)).alias("kmers")).withColumn("lead", F.substring("kmer", 1, conf["lead"]))
    # ranges of k-mers: few files a folder, and no task with all k-mers of one
    held.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").partitionBy("lead").parquet(catalogue)
    say.info("wrote %d k-mers to %s", kept.get["kmers"], catalogue)
    return spark.read.schema("kmer string, freq long, low_complexity boolean, lead string").parquet(catalogue)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="kmer_catalogue", description="Catalogue of k-mers of arriving sequences")
    for name in ("source", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="JSON file that changes some of kmer_catalogue.json")
    a = p.parse_args(argv)
    log_to_stderr()
    spark = SparkSession.builder.appName("kmer_catalogue").getOrCreate()
    try:
        run(spark, a.source, a.output, a.checkpoint, **settings("kmer_catalogue", a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
