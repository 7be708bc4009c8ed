"""Exact deduplication by progressive refinement, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.hot_keys import split_hot
from strandlake.operators.sieve import BitSieve, sieve_bits
from strandlake.storage import cut


def exact_dedup(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", prefix_chars: int = 256, carry_text: bool = False, most_bits: int = 27
) -> DataFrame:
    """``df`` with keep_id, group_size (long) and kept (boolean); texts are equal when they are identical.

    Refinement: (1) rows are grouped by the text's length in bytes; (2) only rows whose length others have too get a
    hash of their first ``prefix_chars`` characters and are grouped by both; (3) only rows whose length and prefix
    others share too have their full content read, hashed (SHA-256) and grouped. Each level's repeated keys are
    stored; rows learn from a bit sieve sized by their number (2^``most_bits`` bits at most, which some 100 million
    keys fill; past that the levels spare less) whether they survive, so no text is exchanged for that; level 3 is exact.

    Hot groups: counts and maxima are combined map-side. Groups of more than one row in 4096 are fewer than 4096, so
    their rows stay in place and meet a broadcast; only rows of smaller groups are exchanged, rows without a partner
    not at all.

    Cases: null text counts as empty, and all empty texts are one group. Very long texts are read by their length and
    prefix, whole only if both repeat. Of a group the row with the largest ``id_col`` is kept; rows that repeat that id
    with the same text are kept with it; a null id loses to any other, and a group with null ids only is kept whole.
    An empty table gives an empty table. Other columns pass through unchanged (``text_col`` only with ``carry_text``);
    columns that clash with an output name are replaced.
    """
    out = ("keep_id", "group_size", "kept")
    others = [c for c in df.columns if c not in (*out, text_col, id_col)]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]) if others else F.lit(None).cast("int")
    base = df.select(F.col(f"`{id_col}`").alias("_dedup_id"), F.col(f"`{text_col}`").alias("_dedup_text"), rest.alias("_dedup_rest"))
    text = F.coalesce(F.col("_dedup_text"), F.lit(""))
    length, prefix = F.octet_length(text).cast("long"), F.xxhash64(F.substring(text, 1, prefix_chars))
    count = F.count(F.lit(1))

    by_length = cut(base.select(length.alias("_len")).groupBy("_len").agg(count.alias("_n")), "dedup-length")
    rows, lengths = by_length.agg(F.sum("_n"), F.count_if(F.col("_n") > 1)).first()
    level1 = BitSieve(by_length.where("_n > 1"), ["_len"], sieve_bits(lengths, most=most_bits))
    second = level1.may_hold(base.withColumn("_dedup_len", length), [F.col("_dedup_len")], "_dedup_1")
    second = second.withColumn("_dedup_pre", F.when(F.col("_dedup_1"), prefix))

    by_prefix = second.where("_dedup_1").groupBy(F.col("_dedup_len").alias("_len"), F.col("_dedup_pre").alias("_pre")).agg(count.alias("_n"))
    by_prefix = cut(by_prefix.where("_n > 1"), "dedup-prefix")
    level2 = BitSieve(by_prefix, ["_len", "_pre"], sieve_bits(by_prefix.count(), most=most_bits))
    third = level2.may_hold(second, [F.col("_dedup_len"), F.col("_dedup_pre")], "_dedup_2")
    full = F.when(F.col("_dedup_1") & F.col("_dedup_2"), F.unhex(F.sha2(text, 256)))
    hashed = third.withColumn("_dedup_full", full).drop("_dedup_1", "_dedup_2", "_dedup_pre")
    if not carry_text:
        hashed = hashed.drop("_dedup_text")

    keys = ["_dedup_len", "_dedup_full"]
    groups = (
        hashed.where(F.col("_dedup_full").isNotNull())
        .groupBy(*keys)
        .agg(F.max("_dedup_id").alias("keep_id"), count.alias("group_size"))
        .where("group_size > 1")
    )
    hot, cold = split_hot(cut(groups, "dedup-group"), "group_size", rows or 0)
    known = hashed.join(F.broadcast(hot), keys, "left")
    settled = known.where(F.col("_dedup_full").isNull() | F.col("group_size").isNotNull())
    open_ = known.where(F.col("_dedup_full").isNotNull() & F.col("group_size").isNull()).drop("keep_id", "group_size")
    both = settled.unionByName(open_.join(cold, keys, "left"))
    keep = F.when(F.col("group_size").isNull(), F.col("_dedup_id")).otherwise(F.col("keep_id"))
    named = {id_col: F.col("_dedup_id"), text_col: F.col("_dedup_text")} | {c: F.col(f"_dedup_rest.c{i}") for i, c in enumerate(others)}
    passed = [named[c].alias(c) for c in df.columns if c in named and c not in out and (carry_text or c != text_col)]
    whole = both.withColumn("keep_id", keep).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    return whole.select(*passed, "keep_id", "group_size", F.col("_dedup_id").eqNullSafe(F.col("keep_id")).alias("kept"))
