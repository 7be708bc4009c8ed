"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.storage import cut

#: A key is hot if it holds more than one row in so many; hence there are fewer hot keys than this.
SHARE = 4096


def split_hot(table: DataFrame, size: str, total: int, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """``table`` (one row per key, its number of rows in ``size``) as (hot keys, the others). As the sizes add up to
    ``total`` at most, fewer than ``share`` keys are hot, whatever the data: they may be broadcast."""
    hot = F.col(size) * share > total
    return table.where(hot), table.where(~hot)


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, a row per key ``on`` with the key's number of rows in ``size``.

    Rows of hot keys stay where they are and meet a broadcast of fewer than ``SHARE`` rows, which should be slim; the
    others are exchanged, and none of their keys holds more than one in ``SHARE`` of all rows. Both sides are read
    twice, so they should be stored.
    """
    hot, cold = split_hot(table, size, total)
    here = rows.join(F.broadcast(hot), on)
    there = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return here.unionByName(there)


def join_salted(rows: DataFrame, table: DataFrame, on: str, spread: Column, least: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, a row per key ``on``, which may be too wide to broadcast.

    Keys of more than ``least`` rows and more than one row in ``SHARE`` are dealt over as many parts as they hold such
    portions, by a hash of ``spread``; the table's row is copied to each part. There are fewer than ``SHARE`` such keys
    and fewer than twice as many copies. ``rows`` should be stored.
    """
    total = rows.count()
    limit = max(least, -(-total // SHARE))
    many = rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    many = F.broadcast(cut(many.select(on, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")), "hot"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(many, on, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    copies = table.join(many, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [on, "_part"]).drop("_part")
