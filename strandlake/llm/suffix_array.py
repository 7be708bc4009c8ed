"""Distributed suffix sorting by the difference cover {1, 2} modulo 3, as joins, range sorts and windows.

A text is a set of strings; a string is rows (s, i, x): its number, the place from 0 on without gaps, the letter (a
positive long). A name is a positive long whose order is that of what it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.storage import cut, grown

_PART = 1 << 33  # monotonically_increasing_id counts up to so many rows in a partition


def named(df: DataFrame, columns: list[str], name: str, *more) -> DataFrame:
    """One row per distinct ``columns`` with aggregates ``more`` and a name in their order. Equal rows are combined
    map-side before the range sort, so no range holds more of a frequent one than others do."""
    groups = df.groupBy(*columns).agg(*more) if more else df.select(*columns).distinct()
    return cut(groups.orderBy(*columns).withColumn(name, F.monotonically_increasing_id() + 1), "suffix-names")


def running_max(table: DataFrame, name: str, value: str, out: str) -> DataFrame:
    """``table`` with the largest ``value`` at or before each ``name``: within each range of the sort that gave the
    names, and over the ranges before it, of which there is one row each."""
    ranged = table.withColumn("_range", F.floor((F.col(name) - 1) / _PART))
    ends = ranged.groupBy("_range").agg(F.max(value).alias("_most"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per partition of the sort
    carried = ends.select("_range", F.coalesce(F.max("_most").over(before), F.lit(0)).alias("_carried"))
    own = F.max(value).over(W.partitionBy("_range").orderBy(name).rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = ranged.withColumn("_own", own).join(F.broadcast(carried), "_range")
    return joined.withColumn(out, F.greatest(F.coalesce("_own", F.lit(0)), "_carried")).drop("_range", "_own", "_carried")


def suffix_ranks(letters: DataFrame) -> DataFrame:
    """(s, i, rank): ranks have the order of the suffixes; equal suffixes have equal ranks. Strings end before any letter.

    Triples of letters at the places i mod 3 in {1, 2} are sorted and named; the named strings of a third of the length
    (one per string and residue) are ranked by recursion unless the names say all, which ends after log3 of the longest
    string. A suffix at i mod 3 = 0 is its letter and the sampled suffix behind it: it is placed among the samples of
    residue 1 by (letter, rank at i + 1), among those of residue 2 by (two letters, rank at i + 2), and behind the later of
    the two. All of it is equi-joins on (s, i) and range sorts of distinct keys; windows are within a string or a range.

    ``s`` must leave room for the depth: s * 2^depth has to be a long. ``letters`` should be stored.
    """
    at = W.partitionBy("s").orderBy("i")

    def after(name: str, places: int):
        return F.coalesce(F.lead(name, places).over(at), F.lit(0))

    full = letters.withColumns({"x1": after("x", 1), "x2": after("x", 2)})
    samples = full.where("i % 3 <> 0")
    names = named(samples, ["x", "x1", "x2"], "name")
    sampled = cut(samples.join(grown(names), ["x", "x1", "x2"]).select("s", "i", "name"), "suffix-samples")
    thirds = sampled.select((F.col("s") * 2 + F.when(F.col("i") % 3 == 2, 1).otherwise(0)).alias("s"), F.floor(F.col("i") / 3).cast("int").alias("i"), F.col("name").alias("x"))
    longest, rows = thirds.agg(F.max("i"), F.count(F.lit(1))).first()
    if rows and longest > 0 and names.count() < rows:
        ranks = suffix_ranks(thirds)
        sampled = ranks.select(F.floor(F.col("s") / 2).alias("s"), (F.col("i") * 3 + 1 + F.col("s") % 2).cast("int").alias("i"), F.col("rank").alias("name"))

    ranked = full.join(grown(sampled), ["s", "i"], "left").withColumns({"r1": after("name", 1), "r2": after("name", 2)})
    ranked = cut(ranked.drop("x2"), "suffix-ranked")
    residue = F.col("i") % 3
    one = named(ranked.where(residue != 2), ["x", "r1"], "at_1", F.max(F.when(residue == 1, F.col("name"))).alias("same_1"))
    two = named(ranked.where(residue != 1), ["x", "x1", "r2"], "at_2", F.max(F.when(residue == 2, F.col("name"))).alias("same_2"))
    one, two = running_max(one, "at_1", "same_1", "below_1"), running_max(two, "at_2", "same_2", "below_2")
    rest = ranked.where(residue == 0).join(grown(one), ["x", "r1"]).join(grown(two), ["x", "x1", "r2"])
    equal = F.coalesce("same_1", "same_2")
    placed = rest.select(
        "s", "i", F.coalesce(equal, F.greatest("below_1", "below_2")).alias("a"), F.when(equal.isNotNull(), 0).otherwise(F.col("at_1")).alias("b")
    )
    both = cut(placed.unionByName(ranked.where(residue != 0).select("s", "i", F.col("name").alias("a"), F.lit(0).cast("long").alias("b"))), "suffix-placed")
    return cut(both.join(grown(named(both, ["a", "b"], "rank")), ["a", "b"]).select("s", "i", "rank"), "suffix-ranks")
