"""Second discovery pass over what the first library leaves uncovered."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import rescue
from strandlake.operators.discover import discover_families
from strandlake.operators.intervals import interval_gaps
from strandlake.operators.select import densely
from strandlake.plans.config import DiscoverParams
from strandlake.storage import cut


def recall_rescue(
    seqs: DataFrame, families: DataFrame, instances: DataFrame, l: int, p: DiscoverParams, l_delta: int = 1, max_families: int = 2000,  # noqa: E741
    least_gap: int = 200, flank: int = 10_000, full: bool = False, chunk: int = 20_000_000,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(families, instances, verdicts, segments): new families of shorter seeds found in uncovered segments (or
    everywhere with ``full``), without those that repeat a known family or one kept before them; they are flagged and
    numbered on without gaps. ``verdicts`` has a row per candidate: what `judge_in_order` found, its ``output_id`` (null
    if dropped), length and instances; ``matched_id`` is a family of the result. Segments are dealt by a hash to as many
    tasks as they fill at ``chunk`` bases."""
    if not 0 <= l_delta <= 8 or max_families < 1 or least_gap < 1:
        raise ValueError("l_delta is 0..8, max_families and least_gap are positive")
    lengths = seqs.select("seq_index", F.length("seq").cast("long").alias("length"))
    if full:
        segments = lengths.select("seq_index", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    else:
        segments = interval_gaps(instances, lengths, ["seq_index"], least_gap, flank)
    segments = cut(segments, "rescue-segments")
    bins = max(1, -(-(segments.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0) // chunk))
    joined = segments.join(seqs.select("seq_index", "seq"), "seq_index")
    piece = F.substring("seq", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    tiles = joined.select(F.pmod(F.xxhash64("seq_index", "start"), F.lit(bins)).alias("chunk"), "seq_index", F.col("start").cast("long").alias("start"), piece.alias("seq"))
    found, raw = discover_families(tiles, replace(p, l=max(8, l - l_delta), max_families=max_families))
    found = cut(found, "rescue-found")
    inst = cut(raw.withColumn("instance_idx", F.monotonically_increasing_id()), "rescue-inst")
    measured = ["query_id", "target_id", "ratio", "identity", "fraction"]
    old = _measured(rescue.containment(inst, instances, 500), found, families)
    own = _measured(rescue.containment(inst, inst, 500).where("target_id < query_id"), found, found)
    evidence = cut(old.select(*measured, F.lit(True).alias("known")).unionByName(own.select(*measured, F.lit(False).alias("known"))), "rescue-evidence")
    judged = cut(rescue.judge_in_order(found, evidence), "rescue-verdicts")
    top = families.agg(F.coalesce(F.max("family_id"), F.lit(-1))).first()[0] + 1
    numbers = densely(judged.where("kept").select("family_id"), "family_id", "_new").select("family_id", (F.col("_new") + top).alias("output_id"))
    numbers = cut(numbers, "rescue-numbers")
    sizes = inst.groupBy("family_id").agg(F.count(F.lit(1)).alias("num_instances"))
    matched = numbers.select(F.col("family_id").alias("matched_id"), F.lit(False).alias("matched_known"), F.col("output_id").alias("_own"))
    verdicts = judged.join(matched, ["matched_id", "matched_known"], "left").withColumn("matched_id", F.coalesce("_own", "matched_id")).drop("_own", "matched_known")
    verdicts = verdicts.join(numbers, "family_id", "left").join(found.select("family_id", "consensus_length"), "family_id").join(sizes, "family_id", "left")
    verdicts = cut(verdicts.withColumn("num_instances", F.coalesce("num_instances", F.lit(0))), "rescue-verdicts")
    new = found.select("family_id", "consensus", "consensus_length", "discovery_flags").join(numbers, "family_id")
    known = families if "discovery_flags" in families.columns else families.withColumn("discovery_flags", F.lit(0))
    merged = rescue.append_rescued(known.select("family_id", "consensus", "consensus_length", "discovery_flags"), new)
    moved = inst.join(numbers, "family_id").drop("family_id").withColumnRenamed("output_id", "family_id")
    cols = ["family_id", "instance_idx", "seq_index", "start", "end", "num_edits", "divergence", "strand"]
    return merged, instances.select(cols).unionByName(moved.select(cols)), verdicts, segments


def _measured(contained: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``contained`` (query_id, target_id, fraction) with the consensi's length ratio and identity."""
    a = queries.select(F.col("family_id").alias("query_id"), F.col("consensus").alias("a_consensus"))
    b = targets.select(F.col("family_id").alias("target_id"), F.col("consensus").alias("b_consensus"))
    ratio = F.least(F.length("a_consensus"), F.length("b_consensus")) / F.greatest(F.length("a_consensus"), F.length("b_consensus"))
    return rescue.consensus_identity(contained.join(a, "query_id").join(b, "target_id").withColumn("ratio", ratio))
