"""Recruitment of instances: seed hits, clusters with anchors, majority consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators.kmers import kmer_rows
from strandlake.storage import cut


def consensus_kmers(families: DataFrame, k: int) -> DataFrame:
    """(family_id, kmer, cons_pos, cons_rev): first occurrence of each canonical k-mer in a family's consensus."""
    rows = kmer_rows(families.select(F.col("family_id").alias("seq_index"), F.col("consensus").alias("seq")), k)
    first = rows.groupBy("seq_index", "kmer").agg(F.min(F.struct("pos", "is_rev")).alias("s"))
    return first.select(F.col("seq_index").alias("family_id"), "kmer", F.col("s.pos").alias("cons_pos"), F.col("s.is_rev").alias("cons_rev"))


def seed_hits(cons: DataFrame, index: DataFrame, most: int = 50_000, few: int = 500_000, sizes: DataFrame | None = None) -> DataFrame:
    """Consensus k-mers joined to their positions; strand +1 where both are read alike; ``most`` hits per family in
    consensus order. Where the consensus k-mers are counted to be ``few`` at most (some 50 MB) they are broadcast and
    the positions, usually the larger side by far, stay where they are.

    ``sizes`` (kmer, n: all its positions) spares hits that can't be among the ``most``: those of consensus places
    that begin behind as many hits of earlier places. A family then exchanges ``most`` hits and one k-mer's at most.
    """
    if sizes is not None:
        earlier = W.partitionBy("family_id").orderBy("cons_pos").rowsBetween(W.unboundedPreceding, -1)
        sized = cons.join(sizes.select("kmer", "n"), "kmer").withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        cons = cut(sized.where(F.col("_before") < most).select(cons.columns), "seeds")
    hits = (F.broadcast(cons) if cons.count() <= few else cons).join(index, "kmer").select(
        "family_id", "seq_index", "pos", "cons_pos", F.when(F.col("cons_rev") == F.col("is_rev"), 1).otherwise(-1).alias("strand")
    )
    order = W.partitionBy("family_id").orderBy("cons_pos", "seq_index", "pos")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def cluster_hits(hits: DataFrame, families: DataFrame, gap_factor: float = 1.5) -> DataFrame:
    """One row per cluster of hits: a new one begins at a gap over ``gap_factor`` consensus lengths, another strand or
    record; the anchor is the hit nearest the consensus midpoint, the first of equals."""
    h = hits.join(families.select("family_id", "consensus_length"), "family_id")
    part = W.partitionBy("family_id", "seq_index", "strand").orderBy("pos", "cons_pos")
    new = F.col("pos") - F.lag("pos").over(part) > gap_factor * F.col("consensus_length")
    marked = h.withColumn("_new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0))
    numbered = marked.withColumn("cluster", F.sum("_new").over(part.rowsBetween(W.unboundedPreceding, 0)))
    off = F.abs(F.col("cons_pos") - F.floor(F.col("consensus_length") / 2))
    return numbered.groupBy("family_id", "seq_index", "strand", "cluster").agg(
        F.count(F.lit(1)).alias("hits"), F.min(F.struct(off.alias("o"), "pos", "cons_pos")).alias("s")
    ).select("family_id", "seq_index", "strand", "cluster", "hits", F.col("s.pos").alias("anchor_pos"), F.col("s.cons_pos").alias("anchor_cons"))


def majority_consensus(bases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, consensus) of (keys, p, base, weight): the base of largest weight at each position, the least of equals;
    N is no vote."""
    votes = bases.where(F.col("base").isin("A", "C", "G", "T")).groupBy(*keys, "p", "base").agg(F.sum("weight").alias("w"))
    best = votes.groupBy(*keys, "p").agg(F.min(F.struct((-F.col("w")).alias("w"), "base")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col("s.base").alias("b")))), lambda x: x["b"]), "")
    return best.groupBy(*keys).agg(joined.alias("consensus"))
