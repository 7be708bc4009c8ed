"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tempered_weights(sizes: dict, exponent: float = 0.7) -> dict:
    """Target weights proportional to size ** exponent; an empty source gets none."""
    raw = {k: float(v) ** exponent for k, v in sizes.items() if v and v > 0}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def whole_weights(weights: dict) -> dict:
    """Integers in exactly the ratios of the positive weights, each read as the decimal that it prints as."""
    exact = {k: Fraction(str(w)) for k, w in weights.items() if w > 0}
    unit = lcm(*[w.denominator for w in exact.values()])
    return {k: int(w * unit) for k, w in exact.items()}


def pfair_slots(whole: dict, first: int = 0, served: dict | None = None) -> Iterator[tuple]:
    """(slot, source, number of its block) from slot ``first`` on, without end; ``served`` are the blocks before it.

    With weight w (a ratio of integers, not rounded to slots) block j (from 0) of a source is released at floor(j / w)
    and due at ceil((j + 1) / w); of the released blocks the one due first takes the slot. The weights add up to 1, so
    every block meets its deadline, and after any number of slots each source is less than one block away from its
    weight's part. What comes next depends on ``served`` only, so ranges of slots can be planned apart.
    """
    total = sum(whole.values())
    done = served or {}
    waiting = [(done.get(k, 0) * total // n, str(k), k, done.get(k, 0)) for k, n in whole.items()]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    slot = first
    while whole:
        while waiting and waiting[0][0] <= slot:
            _, name, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // whole[k]), name, j, k))
        due, name, j, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        yield slot, k, j
        heapq.heappush(waiting, ((j + 1) * total // whole[k], name, k, j + 1))
        slot += 1


def plan_mix(whole: dict, sizes: dict, block_chars: int, repeat: bool, step: int, max_slots: int) -> tuple[list, int, list]:
    """(ranges of at most ``step`` slots as (first slot, slots, blocks served before), end of the schedule, tail).

    With ``repeat`` the schedule ends when every source has had its first pass, but at the latest when the last block
    of every long source is due. Long are sources of a whole block (or the longest, if none has one); a source of less
    than a block may be due far behind that, and those that have not come then take one slot each in the tail.
    """
    total = sum(whole.values())
    blocks = {k: -(-sizes[k] // block_chars) for k in whole}
    least = min(block_chars, max((sizes[k] for k in whole), default=0))
    latest = max((-(-blocks[k] * total // n) for k, n in whole.items() if sizes[k] >= least), default=0)
    if not repeat:
        latest = min((-(-blocks[k] * total // n) for k, n in whole.items()), default=0)
    if latest > max_slots:
        raise ValueError(f"the weights demand up to {latest} slots, more than {max_slots}: give larger blocks or weights")
    served, ranges, left = dict.fromkeys(whole, 0), [], set(whole)
    end = 0
    for slot, k, j in pfair_slots(whole):
        if slot == latest or not left or (not repeat and len(left) < len(whole)):
            break
        if slot % step == 0:
            ranges.append([slot, 0, list(served.values())])
        served[k] = j + 1
        if j + 1 == blocks[k]:
            left.discard(k)
        ranges[-1][1] += 1
        end = slot + 1
    tail = sorted(left, key=lambda k: (-(-total // whole[k]), str(k))) if repeat else []
    return ranges, end, tail


def hash_range(h: str, ranges: str) -> Column:
    """Which of ``ranges`` equal parts of all values the 64-bit hash ``h`` lies in."""
    upper = F.shiftright(h, 12).bitwiseAND((1 << 52) - 1)
    return F.floor(upper.cast("double") * F.col(ranges) / float(1 << 52)).cast("long")


def block_size(total: int) -> int:
    """Characters of a block for so many in all: a 1024th, so that small tables interleave too, but no more than 200,000
    unless that would make more than ten million blocks, as the schedule takes one pass over them on the driver."""
    return max(1, min(200_000, total // 1024), -(-total // 10_000_000))


def mix_sources(
    df: DataFrame,
    weights: dict | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int | None = None,
    exponent: float = 0.7,
    repeat: bool = True,
    range_chars: int = 8_000_000,
    max_sources: int = 10_000,
    carry: bool = False,
    step: int = 10_000,
    max_slots: int = 100_000_000,
) -> DataFrame:
    """(id, source, epoch, block, slot, place): when each row's turn comes in the mix. All are long but the first two.

    With ``carry`` the result has a struct ``row`` of all columns of ``df``, whatever their names, in place of id and
    source; without it other columns are ignored.

    Rows of a source follow each other in the order of a hash of their id and are cut into blocks of ``block_chars``
    characters (by default ``block_size`` of all characters that have a weight) by the place where they start, so any two blocks of a source differ by one row's length at most. Blocks
    take the slots that ``pfair_slots`` gives their source; ``place`` orders rows within a slot. ``weights`` default to
    ``tempered_weights`` of the sources' characters and are not rounded, so that each source stays less than one block
    away from its part over the whole schedule, however long.

    With ``repeat`` every row comes at least once: the mix ends when the source that lasts longest has come to its
    end, and sources that end sooner start over (``epoch`` 1, 2, ...), as target weights demand; no row is dropped.
    A source of less than one block whose turn would be due behind that end gets one slot after it (``plan_mix``);
    within that tail, of fewer slots than there are sources, the other sources wait.
    Without it the mix ends where the first source does, and rows behind that are left out.

    Driver memory: one (source, characters) per source, checked against ``max_sources``, and the blocks of each source
    at every ``step``-th slot. From those, executors plan the slots, which are brought to the hash range that holds
    the block. Running sums are taken within hash ranges of some ``range_chars`` characters (2^20 ranges a source at
    most) and offset by the ranges' totals, so no source, however large, is ordered in one task.

    Cases: rows with a null source are a source of their own; null and empty texts count as one character; a text longer
    than a block takes the block in which it starts, and the following blocks it covers are empty; null and repeated
    ids are ordered by their text; with given weights, rows of sources without a positive one are left out. An empty
    table gives an empty table.
    """
    size = F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    own = F.struct(*[F.col(c) for c in (df.columns if carry else (id_col, source_col))])
    rows = df.select(
        own.alias("row"),
        F.col(id_col).alias("_id"),
        source.alias("_s"),
        F.greatest(size, F.lit(1)).alias("_n"),
        F.xxhash64(F.col(id_col), F.lit(17)).alias("_h"),
        F.xxhash64(text_col).alias("_t"),
    )
    totals = rows.groupBy("_s").agg(F.sum("_n").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources: give a coarser source column")
    sizes = {r["_s"]: r["n"] for r in totals}
    spark = df.sparkSession
    dealt = [(k, min(1 << 20, -(-n // range_chars))) for k, n in sizes.items()]  # one row a source
    rows = rows.join(F.broadcast(spark.createDataFrame(dealt, "_s string, _ranges long")), "_s").withColumn("_r", hash_range("_h", "_ranges"))
    target = tempered_weights(sizes, exponent) if weights is None else {
        s: w for k, w in weights.items() if (s := "null" if k is None else f"={k}") in sizes and w > 0
    }
    whole = whole_weights(target)
    if block_chars is None:
        block_chars = block_size(sum(sizes[k] for k in whole))
    planned, end, tail = plan_mix(whole, sizes, block_chars, repeat, step, max_slots)
    names = list(whole)
    blocks = [-(-sizes[k] // block_chars) for k in names]
    at = {k: i for i, k in enumerate(names)}
    schema = pa.schema([("_s", pa.string()), ("epoch", pa.int64()), ("block", pa.int64()), ("slot", pa.int64())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, served in zip(*[c.to_pylist() for c in b.columns], strict=True):
                turns = pfair_slots(whole, first, dict(zip(names, served, strict=True)))
                got = [(k, *divmod(j, blocks[at[k]]), slot) for (slot, k, j), _ in zip(turns, range(n))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), schema, strict=True)], schema=schema)

    slots_of = "_s string, epoch long, block long, slot long"
    turns = spark.createDataFrame(planned, "first long, n long, served array<long>").repartition(max(1, min(len(planned), 200)))
    turns = turns.mapInArrow(expand, slots_of)
    if tail:
        turns = turns.unionAll(spark.createDataFrame([(k, 0, 0, end + i) for i, k in enumerate(tail)], slots_of))

    before = W.partitionBy("_s").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("_s", "_r").agg(F.sum("_n").alias("_sum"))
    offsets = offsets.select("_s", "_r", "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    low, high = (F.floor(x / block_chars).cast("long") for x in (F.col("_offset"), F.col("_offset") + F.col("_sum") - 1))
    held = offsets.select("_s", "_r", "_offset", low.alias("_low"), (high - low + 1).alias("_held"), F.explode(F.sequence(low, high)).alias("block"))
    # slots of the blocks that a range holds, pass after pass; those behind the end are missing at the end only
    taken = held.join(turns, ["_s", "block"]).groupBy("_s", "_r", "_offset", "_low", "_held").agg(
        F.array_sort(F.collect_list(F.struct("epoch", "block", "slot")))["slot"].alias("_slots")
    )
    within = W.partitionBy("_s", "_r").orderBy("_h", "_id", "_t").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("_start", F.sum("_n").over(within) - F.col("_n")).join(taken, ["_s", "_r"])
    start = F.col("_start") + F.col("_offset")
    passes = F.ceil(F.size("_slots") / F.col("_held")).cast("long")
    timed = placed.select(
        "row", F.floor(start / block_chars).cast("long").alias("block"), start.alias("place"), "_low", "_held", "_slots",
        F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("epoch"),
    )
    slot = F.get("_slots", (F.col("epoch") * F.col("_held") + F.col("block") - F.col("_low")).cast("int"))
    timed = timed.select("row", "epoch", "block", slot.alias("slot"), "place").where(F.col("slot").isNotNull())
    return timed if carry else timed.select("row.*", "epoch", "block", "slot", "place")
