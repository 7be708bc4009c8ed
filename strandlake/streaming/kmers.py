"""Running k-mer totals of a stream of sequences.

Tandem filtering needs a record's k-mers in order, so it stays with the batch operator; totals are additive and fit a
streaming aggregation whose state is one row per k-mer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.kmers import kmer_rows


def running_counts(stream: DataFrame, k: int) -> DataFrame:
    """(kmer, occurrences) of a streaming (seq_index, seq), for complete or update output."""
    return kmer_rows(stream, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("occurrences"))
