"""Growing consensi at their ends by majority, from the flanks of instances that reach the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators.refine import Pieces, cut_windows


def end_flanks(families: DataFrame, instances: DataFrame, pieces: Pieces, longest: int = 100, tolerance: int = 5, most: int = 30) -> DataFrame:
    """(family_id, side, flank): bases beyond each end of the consensus, read away from it, of the first ``most``
    instances whose alignment comes within ``tolerance`` bases of that end. side is 5 or 3."""
    i = instances.join(families.select("family_id", "consensus_length"), "family_id")
    forward = F.col("strand") > 0
    three = i.where(F.col("consensus_length") - F.col("cons_end") <= tolerance).select(
        "family_id", "seq_index", "instance_idx", F.lit(3).alias("side"), F.when(forward, F.col("end")).otherwise(F.col("start")).alias("edge"), forward.alias("up")
    )
    five = i.where(F.col("cons_start") <= tolerance).select(
        "family_id", "seq_index", "instance_idx", F.lit(5).alias("side"), F.when(forward, F.col("start")).otherwise(F.col("end")).alias("edge"), (~forward).alias("up")
    )
    order = W.partitionBy("family_id", "side").orderBy("instance_idx")
    first = three.unionAll(five).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r", "instance_idx")
    lo = F.when(F.col("up"), F.col("edge")).otherwise(F.col("edge") - longest)
    cuts = cut_windows(first, pieces.reaching(longest), lo, F.when(F.col("up"), F.col("edge") + longest).otherwise(F.col("edge")))
    return cuts.select("family_id", "side", F.when(F.col("up"), F.col("window")).otherwise(S.reverse_complement("window")).alias("flank"))


def extend_boundaries(
    families: DataFrame, flanks: DataFrame, least: int = 3, occupancy: float = 0.5, majority: float = 0.5
) -> DataFrame:
    """(family_id, ext5, ext3, consensus, consensus_length): each end grows while at least ``occupancy`` of its flanks
    still have a base and one base has ``majority`` of those, up to the first offset where not; ends with fewer than
    ``least`` flanks stay."""
    n = flanks.groupBy("family_id", "side").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    bases = flanks.select("family_id", "side", F.posexplode(F.split("flank", "")).alias("o", "base")).where(F.col("base").isin("A", "C", "G", "T"))
    votes = bases.groupBy("family_id", "side", "o", "base").agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy("family_id", "side", "o").agg(F.sum("v").alias("all"), F.min(F.struct((-F.col("v")).alias("m"), "base")).alias("s"))
    judged = best.join(n, ["family_id", "side"]).withColumn(
        "ok", ((F.col("all") >= occupancy * F.col("n")) & (-F.col("s.m") >= majority * F.col("all"))).cast("int")
    )
    run = W.partitionBy("family_id", "side").orderBy("o").rowsBetween(W.unboundedPreceding, 0)
    unbroken = judged.withColumn("_ok", F.min("ok").over(run)).withColumn("_i", F.row_number().over(W.partitionBy("family_id", "side").orderBy("o")) - 1)
    kept = unbroken.where((F.col("_ok") == 1) & (F.col("_i") == F.col("o")))
    grown = kept.groupBy("family_id", "side").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col("s.base").alias("b")))), lambda x: x["b"]), "").alias("g")
    )
    wide = grown.groupBy("family_id").agg(F.max(F.when(F.col("side") == 5, F.col("g"))).alias("g5"), F.max(F.when(F.col("side") == 3, F.col("g"))).alias("g3"))
    joined = families.select("family_id", "consensus").join(wide, "family_id", "left").na.fill("", ["g5", "g3"])
    made = joined.select("family_id", F.length("g5").alias("ext5"), F.length("g3").alias("ext3"), F.concat(S.reverse_complement("g5"), "consensus", "g3").alias("consensus"))
    return made.withColumn("consensus_length", F.length("consensus"))
