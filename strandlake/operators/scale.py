"""Cutting long records, packing chunks, sampling tiles, carrying coordinates through both."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_records(lengths: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(seq_index, part, start, end): records over 1.8 chunks are halved until parts fit, each with ``overlap`` bases of
    its neighbours, clipped to the record."""
    ratio = F.col("length") / F.lit(1.8 * chunk)
    parts = F.when(ratio > 1, F.pow(F.lit(2.0), F.ceil(F.log2(ratio)))).otherwise(F.lit(1.0)).cast("long")
    rows = lengths.withColumn("_n", parts).select("seq_index", "length", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("part"))
    size = F.ceil(F.col("length") / F.col("_n"))
    return rows.select(
        "seq_index", "part", F.greatest(F.lit(0), F.col("part") * size - overlap).cast("long").alias("start"),
        F.least("length", (F.col("part") + 1) * size + overlap).cast("long").alias("end"),
    )


def pack_segments(segments: list[tuple[int, int]], chunk: int) -> dict[int, int]:
    """Segment -> bin by largest first into the least loaded bin, max(2, ceil(total / chunk)) bins, as many as segments
    at most. ``segments`` is (id, length) of a few thousand chunks: one entry per chunk-sized piece of the genome."""
    if not segments:
        return {}
    bins = min(len(segments), max(2, -(-sum(n for _, n in segments) // chunk)))
    loads = [(0, i) for i in range(bins)]
    out = {}
    for ident, n in sorted(segments, key=lambda x: (-x[1], x[0])):
        load, i = heapq.heappop(loads)
        out[ident] = i
        heapq.heappush(loads, (load + n, i))
    return out


_BLOCK = 1000  # windows of a record that one task draws from at a time


def sample_tiles(lengths: DataFrame, window: int, tiles: int, seed: int = 42) -> DataFrame:
    """``tiles`` full windows drawn by a seeded hash (the same for any partitioning), none if no record holds one.

    A small table of lengths may stand for very many windows, so blocks of them are dealt over the tasks."""
    last = F.floor(F.col("length") / window) - 1
    blocks = lengths.where(F.col("length") >= window).select("seq_index", last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(_BLOCK).cast("long"))).alias("_first"))
    # a number of partitions that is given is kept; by their few bytes they would be put together again
    dealt = blocks.repartition(int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_index", "_first")
    full = dealt.select("seq_index", F.explode(F.sequence("_first", F.least("_last", F.col("_first") + _BLOCK - 1))).alias("tile"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("seq_index").cast("string"), F.col("tile").cast("string")))
    return full.orderBy(drawn, "seq_index", "tile").limit(tiles).select(
        "seq_index", "tile", (F.col("tile") * window).alias("start"), ((F.col("tile") + 1) * window).alias("end")
    )


def from_segments(instances: DataFrame, segments: DataFrame) -> DataFrame:
    """Instances on segments (segment_id, start, end) moved to record coordinates; ``segments`` has (segment_id,
    seq_index, raw_start)."""
    joined = instances.join(segments.select("segment_id", "seq_index", "raw_start"), "segment_id")
    moved = joined.withColumn("start", F.col("start") + F.col("raw_start")).withColumn("end", F.col("end") + F.col("raw_start"))
    return moved.drop("raw_start", "segment_id")


def segment_sequences(seqs: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, seq) cut out of their records."""
    joined = seqs.join(segments, "seq_index")
    return joined.select("segment_id", F.substring("seq", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("seq"))


def sampled_sequences(seqs: DataFrame, tiles: DataFrame) -> DataFrame:
    """(seq_index, seq) of sampled windows (seq_index, tile, start, end), each as a record of its own, numbered by
    ``sample_number``."""
    rows = tiles.select(sample_number().alias("segment_id"), "seq_index", "start", "end")
    return segment_sequences(seqs, rows).select(F.col("segment_id").alias("seq_index"), "seq")


def sample_number():
    """A window's number as a record: its record's and its own, which are below 2^31 each."""
    return (F.col("seq_index").cast("long") * (1 << 31) + F.col("tile")).cast("long")


def from_samples(instances: DataFrame, tiles: DataFrame) -> DataFrame:
    """Instances found in sampled windows, in coordinates of the records that the windows are from."""
    segments = tiles.select(sample_number().alias("segment_id"), F.col("seq_index").cast("long").alias("seq_index"), F.col("start").alias("raw_start"))
    return from_segments(instances.withColumnRenamed("seq_index", "segment_id"), segments).select(instances.columns)
