"""Rescue pass: which discovered families are new against the accepted ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import mdl
from strandlake.operators.graph import first_come
from strandlake.operators.intervals import overlap_join, overlap_length
from strandlake.storage import cut


def containment(query: DataFrame, target: DataFrame, width: int, share: float = 0.80) -> DataFrame:
    """(query_id, target_id, contained, fraction): instances of a query family that an instance of the target family
    covers by ``share``, over all instances of the query family."""
    q = query.select("family_id", "instance_idx", "seq_index", "start", "end")
    pairs = overlap_join(q, target.select("family_id", "instance_idx", "seq_index", "start", "end"), ["seq_index"], width)
    good = pairs.where(overlap_length() >= share * (F.col("a_end") - F.col("a_start")))
    hit = good.groupBy(F.col("a_family_id").alias("query_id"), F.col("b_family_id").alias("target_id")).agg(F.countDistinct("a_instance_idx").alias("contained"))
    n = query.groupBy(F.col("family_id").alias("query_id")).agg(F.countDistinct("instance_idx").alias("_n"))
    return hit.join(n, "query_id").select("query_id", "target_id", "contained", (F.col("contained") / F.col("_n")).alias("fraction"))


_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")


def window_identity(a: str, b: str, ratio: float = 0.8) -> float:
    """Best share of equal bases of the shorter sequence slid along the longer one, either strand; 0 below ``ratio``."""
    x, y = sorted((a.encode(), b.encode()), key=len)
    if not x or len(x) < ratio * len(y):
        return 0.0
    long = np.lib.stride_tricks.sliding_window_view(np.frombuffer(y, np.uint8), len(x))
    best = 0
    for strand in (x, x.translate(_COMPLEMENT)[::-1]):
        s = np.frombuffer(strand, np.uint8)
        for at in range(0, len(long), 512):
            best = max(best, int(((long[at : at + 512] == s) & (s != 78)).sum(1).max()))
    return best / len(x)


def consensus_identity(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with a_consensus, b_consensus) and their ``identity``, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ab = zip(b.column("a_consensus").to_pylist(), b.column("b_consensus").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([window_identity(x or "", y or "") for x, y in ab], pa.float64())], names=[*b.schema.names, "identity"]
            )

    return pairs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in pairs.dtypes), "identity double"]))


def without_duplicates(candidates: DataFrame, evidence: DataFrame, least: float = 0.80) -> DataFrame:
    """Candidates that no accepted family repeats: length ratio, identity and containment all reach ``least``.
    ``evidence`` has (query_id, target_id, ratio, identity, fraction)."""
    same = evidence.where((F.col("ratio") >= least) & (F.col("identity") >= least) & (F.col("fraction") >= least))
    return candidates.join(same.select(F.col("query_id").alias("family_id")), "family_id", "left_anti")


def judge_in_order(candidates: DataFrame, evidence: DataFrame, least: float = 0.80) -> DataFrame:
    """(family_id, kept, matched_id, matched_known, ratio, identity, fraction, near): ``candidates`` (family_id) held, in
    ascending order, against the known families and the candidates kept before.

    ``evidence`` has (query_id, target_id, known, ratio, identity, fraction), a row per pair that may be alike: ``known``
    tells a known family from a candidate, of which those before the query count. A candidate of which ratio, identity
    and containment all reach ``least`` with one of them is dropped; its match is the first such one, known families
    before candidates, by id. The match of a kept one is what has the largest product of the three, the first of equals;
    without a positive product it is null and the three are 0. ``near`` marks kept candidates whose match reaches
    ``least`` but for a containment of at least a half. Null measures count as 0.
    """
    measures = ("ratio", "identity", "fraction")
    e = evidence.withColumns({m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in measures})
    e = cut(e.where("known or target_id < query_id").select("query_id", "target_id", "known", *measures), "rescue-judged")
    same = F.least(*measures) >= least
    barred = e.where(same & F.col("known")).select(F.col("query_id").alias("node"))
    links = e.where(same & ~F.col("known")).select(F.col("query_id").alias("node"), F.col("target_id").alias("before"))
    states = cut(first_come(candidates.select(F.col("family_id").alias("node")), links, barred), "rescue-states")
    there = e.join(states.where("kept").select(F.col("node").alias("target_id")), "target_id", "left_semi").where(~F.col("known"))
    held = e.where("known").unionByName(there)
    product = F.col("ratio") * F.col("identity") * F.col("fraction")
    place = [(~F.col("known")).alias("later"), F.col("target_id").alias("id"), *measures]
    found = held.groupBy(F.col("query_id").alias("node")).agg(
        F.min(F.when(same, F.struct(F.lit(0.0).alias("p"), *place))).alias("_same"), F.min(F.when(product > 0, F.struct((-product).alias("p"), *place))).alias("_best")
    )
    best = F.coalesce("_same", "_best")
    rows = states.join(found, "node", "left").select(F.col("node").alias("family_id"), "kept", best.alias("_m"))
    rows = rows.select(
        "family_id", "kept", F.col("_m.id").alias("matched_id"), (~F.col("_m.later")).alias("matched_known"), *[F.coalesce(f"_m.{m}", F.lit(0.0)).alias(m) for m in measures]
    )
    return rows.withColumn("near", F.col("kept") & (F.least("ratio", "identity") >= least) & (F.col("fraction") >= 0.5))


def statistics(verdicts: DataFrame) -> DataFrame:
    """One row: candidates, appended, duplicates, near_duplicates and the largest identity, containment and length ratio
    of the candidates' matches."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("kept").alias("appended"), F.count_if(~F.col("kept")).alias("duplicates"),
        F.count_if("near").alias("near_duplicates"),
        *[F.coalesce(F.max(m), F.lit(0.0)).alias(f"max_{m}") for m in ("identity", "fraction", "ratio")],
    )


def append_rescued(families: DataFrame, rescued: DataFrame) -> DataFrame:
    """Families with the rescued ones (family_id, output_id, ...) behind them, flagged, under their ``output_id``."""
    moved = rescued.drop("family_id").withColumnRenamed("output_id", "family_id")
    moved = moved.withColumn("discovery_flags", F.col("discovery_flags").bitwiseOR(mdl.BIT["rescue_discovery"]))
    return families.unionByName(moved)
