"""Half-open integer intervals [start, end) within records: unions, overlap joins, gaps and coordinate maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.storage import cut


def binned_islands(df: DataFrame, keys: list[str], width: int, touching: bool, start: str = "start", end: str = "end") -> DataFrame:
    """``df`` with each interval cut at multiples of ``width`` (_bin, _from, _to) and the number _island of the merged
    interval that the piece belongs to within its bin. So no task sorts a whole record. With ``touching`` pieces that
    touch are one island, else only those that overlap."""
    rows = df.where(F.col(end) > F.col(start)).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    )
    rows = rows.withColumn("_from", F.greatest(F.col(start).cast("long"), F.col("_bin") * width)).withColumn(
        "_to", F.least(F.col(end).cast("long"), (F.col("_bin") + 1) * width)
    )
    order = W.partitionBy(*keys, "_bin").orderBy("_from", "_to")
    seen = F.max("_to").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col("_from") > seen if touching else F.col("_from") >= seen
    marked = rows.withColumn("_new", F.when(seen.isNull() | apart, 1).otherwise(0))
    return marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def interval_union(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = 1 << 20) -> DataFrame:
    """Maximal merged intervals per ``keys``; touching intervals merge, empty or inverted ones are ignored.

    Intervals are merged within bins of ``width`` bases; then only those that reach a bin's end, two a bin at most, are
    put in order per record and joined across bins.
    """
    types = dict(df.dtypes)
    pieces = binned_islands(df.select(*keys, start, end), keys, width, True, start, end)
    merged = pieces.groupBy(*keys, "_bin", "_island").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    reaches = (F.col("_from") == F.col("_bin") * width) | (F.col("_to") == (F.col("_bin") + 1) * width)
    inner = merged.where(~reaches).select(*keys, "_from", "_to")
    order = W.partitionBy(*keys).orderBy("_from")
    fresh = F.when(F.lag("_to").over(order) == F.col("_from"), 0).otherwise(1)
    chain = merged.where(reaches).select(*keys, "_from", "_to", fresh.alias("_new"))
    chain = chain.withColumn("_chain", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    across = chain.groupBy(*keys, "_chain").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to")).select(*keys, "_from", "_to")
    both = inner.unionByName(across)
    return both.select(*keys, F.col("_from").cast(types[start]).alias(start), F.col("_to").cast(types[end]).alias(end))


_WIDER = 4  # each level's bins are so many times as wide as those of the level before
_LEVELS = 16


def _level(start: str, end: str, width: int) -> Column:
    """Level of an interval: its bins are wider than a quarter of it, so that it meets five at most."""
    up = F.ceil(F.log((F.col(end) - F.col(start)) / width) / math.log(_WIDER)) - 1
    return F.least(F.greatest(up, F.lit(0)), F.lit(_LEVELS)).cast("int")


def _listed(df: DataFrame, p: str, width: int, pad: int, mine: list[int], others: list[int], first: bool) -> DataFrame:
    """Rows with each level, kind and bin in which an interval (of the levels ``mine``) may meet those of the levels
    ``others``: kind 0 for two of one level, 1 where the left one is of the higher level, 2 where the right one is. Pairs
    meet at the higher level."""
    own = F.col(f"{p}__level")
    above, below = (1, 2) if first else (2, 1)
    entry = lambda level, kind: F.struct(F.lit(level).alias("l"), F.lit(kind).alias("k"))
    at = [F.when(own == level, entry(level, 0)) for level in mine if level in others]
    at += [F.when(own == level, entry(level, above)) for level in mine if any(o < level for o in others)]
    at += [F.when(own < level, entry(level, below)) for level in others if any(m < level for m in mine)]
    if not at:  # a side is empty
        at = [F.when(F.lit(False), entry(0, 0))]
    rows = df.withColumn("_at", F.explode(F.array_compact(F.array(*at))))
    wide = F.lit(width) * F.pow(F.lit(_WIDER), F.col("_at.l")).cast("long")
    lo, hi = F.floor((F.col(f"{p}_start") - pad) / wide), F.floor((F.col(f"{p}_end") + pad - 1) / wide)
    rows = rows.select("*", F.col("_at.l").alias(f"{p}__l"), F.col("_at.k").alias(f"{p}__k"), lo.alias(f"{p}__bin0"), F.explode(F.sequence(lo, hi)).alias(f"{p}__bin"))
    return rows.drop("_at", f"{p}__level")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, touching: int = 0, pile: int | None = None) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose [start, end) overlap; columns are prefixed a_ and b_.

    Spark has no interval join, so each interval is listed in the bins that it meets, bins are joined by equality, and a
    pair is kept in the later of the two intervals' first bins only: no pair comes twice and nothing has to be made
    distinct. ``width`` should be near the usual interval length. Intervals beyond four such bins are of a higher level,
    whose bins are wider, and meet five there at most; the others are listed in the bins of those levels that the other
    side has, so one long interval costs the short ones one row each at most, not itself one row per bin. Which levels
    there are is asked first, seventeen numbers a side at most.

    ``touching`` widens the right side by that many bases at both ends. With ``pile``, bins that hold more rows of the left
    side are dealt over as many tasks as they hold such portions, and the right side's rows are copied to each.
    """
    named = {}
    for df, p in ((left, "a"), (right, "b")):
        some = df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]).where(F.col(f"{p}_end") > F.col(f"{p}_start"))
        named[p] = some.withColumn(f"{p}__level", _level(f"{p}_start", f"{p}_end", width))
    asked = named["a"].select(F.lit("a").alias("p"), F.col("a__level").alias("l")).unionAll(named["b"].select(F.lit("b"), "b__level"))
    found = asked.distinct().collect()  # seventeen levels a side at most
    levels = {p: sorted(r.l for r in found if r.p == p) for p in "ab"}
    a = _listed(named["a"], "a", width, 0, levels["a"], levels["b"], True)
    b = _listed(named["b"], "b", width, touching, levels["b"], levels["a"], False)
    same = [*keys, "_l", "_k", "_bin"]
    if pile is not None:
        many = a.groupBy(*[f"a_{c}" for c in same]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > pile)
        many = cut(many.select(*[F.col(f"a_{c}").alias(f"_{c}") for c in same], F.ceil(F.col("_n") / pile).cast("int").alias("_parts")), "piles")
        if (piles := many.count()) > 0:
            few = F.broadcast(many) if piles <= 100_000 else many
            parts = F.coalesce("_parts", F.lit(1))
            held = lambda df, p: df.join(few, [F.col(f"{p}_{c}") == F.col(f"_{c}") for c in same], "left")
            dealt = held(a, "a").withColumn("a__part", F.pmod(F.xxhash64(*a.columns), parts).cast("int")).select(*a.columns, "a__part")
            copied = held(b, "b").withColumn("b__part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*b.columns, "b__part")
            same = [*same, "_part"]
            # a number of partitions that is given is kept; by their few bytes they would be put together again
            tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            a, b = dealt.repartition(tasks, *[f"a_{c}" for c in same]), copied.repartition(tasks, *[f"b_{c}" for c in same])
    cond = (F.col("a_start") < F.col("b_end") + touching) & (F.col("b_start") - touching < F.col("a_end"))
    cond = cond & (F.col("a__bin") == F.greatest("a__bin0", "b__bin0"))
    for c in same:
        cond = cond & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return a.join(b, cond).drop(*[f"{p}_{c}" for p in "ab" for c in ("_l", "_k", "_bin", "_bin0", "_part")])


def overlap_length() -> Column:
    """Bases that a pair of ``overlap_join`` shares."""
    return F.least("a_end", "b_end") - F.greatest("a_start", "b_start")


def interval_gaps(df: DataFrame, lengths: DataFrame, keys: list[str], least: int = 200, flank: int = 0) -> DataFrame:
    """Uncovered stretches of at least ``least`` bases of each record in ``lengths`` (keys, length), widened by
    ``flank`` within the record and merged again. Records without intervals are one gap."""
    covered = interval_union(df, keys)
    order = W.partitionBy(*keys).orderBy("start")
    inner = covered.select(*keys, F.coalesce(F.lag("end").over(order), F.lit(0)).alias("gs"), F.col("start").alias("ge"))
    tail = covered.groupBy(*keys).agg(F.max("end").alias("gs"))
    tail = lengths.join(tail, keys, "left").select(*keys, F.coalesce("gs", F.lit(0)).alias("gs"), F.col("length").alias("ge"))
    gaps = inner.unionByName(tail).where(F.col("ge") - F.col("gs") >= least).join(lengths.select(*keys, "length"), keys)
    wide = gaps.select(
        *keys, F.greatest(F.lit(0), F.col("gs") - flank).alias("start"), F.least("length", F.col("ge") + flank).alias("end")
    )
    return interval_union(wide, keys)


def intersection_length(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Bases per ``keys`` that two sets of merged intervals share (keys without any are absent)."""
    shared = overlap_join(left.select(*keys, "start", "end"), right.select(*keys, "start", "end"), keys, width)
    return shared.groupBy(*[F.col(f"a_{k}").alias(k) for k in keys]).agg(F.sum(overlap_length()).alias("bases"))


def to_records(positions: DataFrame, records: DataFrame, position: str = "position") -> DataFrame:
    """Positions on the concatenation of all records -> record and local position (as-of join).

    ``records`` has (seq_index, raw_start, length). The line is cut into bins, as many as there are records (256 at least,
    a million at most), and each record is listed in the bins it meets: one a record and one a bin together, so a
    position meets a few records however many there are.
    """
    span, count = records.agg(F.max(F.col("raw_start") + F.col("length")), F.count(F.lit(1))).first()
    width = max(1, (span or 1) // min(1_000_000, max(256, count)))
    starts = records.select(F.col("raw_start").alias("_at"), "seq_index", "length")
    bins = starts.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("_at") / width), F.floor((F.col("_at") + F.greatest("length", F.lit(1)) - 1) / width)))
    )
    probe = positions.withColumn("_bin", F.floor(F.col(position) / width))
    hit = (F.col(position) >= F.col("_at")) & (F.col(position) < F.col("_at") + F.col("length"))
    joined = probe.join(bins, "_bin").where(hit)
    return joined.withColumn("local", F.col(position) - F.col("_at")).drop("_bin", "_at", "length")
