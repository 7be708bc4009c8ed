"""Library selection: scores, greedy exclusive coverage, pruning, tandem coalescing, final filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import mdl
from strandlake.operators.intervals import interval_union, overlap_join
from strandlake.storage import cut


def _integers(column: pa.ChunkedArray | pa.Array, where_null: np.ndarray | int) -> np.ndarray:
    return np.where(np.asarray(column.is_null()), where_null, np.asarray(column.fill_null(0))).astype(np.int64)


def family_scores(instances: DataFrame, families: DataFrame, mode: str = "exact") -> DataFrame:
    """(family_id, consensus_length, n, mean_divergence, model_cost, savings, score).

    Costs are taken in batches by an Arrow kernel; iterated logarithms of column functions are not compiled.
    """
    edits = mdl.known_edits("num_edits", "divergence", "aligned_length").cast("long")
    rows = instances.select("family_id", "divergence", F.col("aligned_length").cast("long").alias("length"), edits.alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = _integers(b.column(2), 0)
            saved = 2.0 * length - mdl.instance_costs(length, _integers(b.column(3), length), mode)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(saved, mask=np.asarray(b.column(2).is_null()))], names=["family_id", "divergence", "saved"])

    kinds = dict(rows.dtypes)
    saved = rows.mapInArrow(run, f"family_id {kinds['family_id']}, divergence {kinds['divergence']}, saved double")
    sums = saved.groupBy("family_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("divergence").alias("mean_divergence"), F.sum("saved").alias("savings")
    )
    joined = families.select("family_id", "consensus_length").join(sums, "family_id", "left")
    cost = mdl.model_cost("consensus_length")
    savings = F.coalesce("savings", F.lit(0.0))
    return joined.select(
        "family_id", "consensus_length", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_divergence", F.lit(0.0)).alias("mean_divergence"),
        cost.alias("model_cost"), savings.alias("savings"), (savings - cost).alias("score"),
    )


#: Pieces of instances are handled in stretches of so many bases of a record.
STRETCH = 1 << 16


def numbered(instances: DataFrame, ranks: DataFrame, *more: str) -> DataFrame:
    """(row, rank, seq_index, start, end, size) and ``more`` of the instances of families in ``ranks``, from base 0
    on, each with a number of its own (instances may repeat, their indices too)."""
    own = instances.join(ranks.select("family_id", "rank"), "family_id").withColumns(
        {"start": F.greatest(F.lit(0).cast("long"), F.col("start").cast("long")), "end": F.col("end").cast("long"), "row": F.monotonically_increasing_id()}
    )
    return cut(own.select("row", "rank", "seq_index", "start", "end", F.greatest(F.lit(0), F.col("end") - F.col("start")).alias("size"), *more), "own")


def stretches(own: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``own`` with _bin, _from, _to in place of start and end: the instances cut at multiples of ``stretch``."""
    rows = own.where("end > start").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / stretch), F.floor((F.col("end") - 1) / stretch))))
    ends = F.greatest("start", F.col("_bin") * stretch).alias("_from"), F.least("end", (F.col("_bin") + 1) * stretch).alias("_to")
    return rows.select("_bin", *ends, *[c for c in own.columns if c not in ("start", "end")])


_PAGE = 32768  # bits in one value of bitmap_construct_agg
_MOST_PAGES = 4096


def ranking(families: DataFrame, score: str, weakest_first: bool) -> DataFrame:
    """``families`` with their rank: places from 1, without gaps, in order of the score, to a millionth of a bit, then of the
    id. They are counted within the ranges of a sort, of which one row each is added up, so no task holds all."""
    by = F.round(score, 6)
    ordered = families.orderBy(F.asc(by) if weakest_first else F.desc(by), "family_id").withColumn("_m", F.monotonically_increasing_id())
    ordered = cut(ordered.withColumn("_range", F.shiftright("_m", 33)), "ranking")
    sizes = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    return cut(ordered.join(F.broadcast(offsets), "_range").withColumn("rank", place).drop("_range", "_m", "_before"), "ranks")


#: Pieces are looked at by their segments, so many of these at a time.
_PORTION = 1 << 20
#: A task that looks at stretches has so many instances on average.
_TASK = 1 << 20


def _portions(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Consecutive pieces, how many segments each of them has, and these segments, piece by piece."""
    so_far = np.concatenate([[0], np.cumsum(hi - lo)])
    at = 0
    while at < len(lo):
        stop = max(at + 1, int(np.searchsorted(so_far, so_far[at] + _PORTION, side="right")) - 1)
        count = hi[at:stop] - lo[at:stop]
        yield slice(at, stop), count, np.arange(so_far[at], so_far[stop]) + np.repeat(lo[at:stop] - so_far[at:stop], count)
        at = stop


class _Segments:
    """The elementary segments of some pieces, which are taken in the order of their ranks."""

    def __init__(self, rank: np.ndarray, at: np.ndarray, to: np.ndarray, falling: bool) -> None:
        cuts, number = np.unique(np.concatenate([at, to]), return_inverse=True)
        self.sizes = np.diff(cuts)
        self.order = np.argsort(-rank if falling else rank, kind="stable")
        self.lo, self.hi = number[: len(at)][self.order], number[len(at) :][self.order]
        self.rank = rank[self.order]
        few = int((self.hi - self.lo).sum()) <= _PORTION
        self._made = list(_portions(self.lo, self.hi)) if few else None

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some pieces' segments, the ranks of these, and at which of them each piece begins."""
        for some, count, segment in self._made if self._made is not None else _portions(self.lo, self.hi):
            yield some, segment, np.repeat(self.rank[some], count), np.cumsum(count) - count

    def summed(self, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Of each piece, the sizes of its segments that fit its rank."""
        out = np.zeros(len(self.order), np.int64)
        for some, segment, rank, first in self:
            out[self.order[some]] = np.add.reduceat(np.where(fits(segment, rank), self.sizes[segment], 0), first)
        return out


def unclaimed(rank: np.ndarray, inside: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Bases of each piece that no family which is in and comes before its own holds."""
    if not len(rank):
        return np.zeros(0, np.int64)
    segments = _Segments(rank, at, to, True)
    first = np.full(len(segments.sizes), np.iinfo(np.int64).max)
    holds = inside[segments.order]
    for some, segment, ranks, start in segments:
        held = np.repeat(holds[some], np.diff(start, append=len(segment)))
        first[segment[held]] = ranks[held]  # the last of equal places is kept: the first family that holds a segment
    return segments.summed(lambda segment, ranks: first[segment] >= ranks)


def unshared(rank: np.ndarray, inside: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Bases of each piece outside all other families that are in or come after its own."""
    if not len(rank):
        return np.zeros(0, np.int64)
    segments = _Segments(rank, at, to, False)
    last = np.zeros(len(segments.sizes), np.int64)  # the last family of a segment
    for _, segment, ranks, _ in segments:
        last[segment] = ranks
    shared = np.zeros(len(last), bool)  # whether a family before it is in
    holds = inside[segments.order]
    for some, segment, ranks, start in segments:
        held = np.repeat(holds[some], np.diff(start, append=len(segment))) & (ranks != last[segment])
        shared[segment[held]] = True
    alone = np.where(shared, -1, last)
    return segments.summed(lambda segment, ranks: alone[segment] == ranks)


def _meets(some: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each piece overlaps one of those in ``some`` (itself, if it is)."""
    chosen = np.flatnonzero(some)
    if len(chosen) in (0, len(some)):
        return some.copy()
    chosen = chosen[np.argsort(at[chosen], kind="stable")]
    reach = np.maximum.accumulate(to[chosen])
    begins = np.concatenate([[True], at[chosen][1:] > reach[:-1]])
    starts, ends = at[chosen][begins], reach[np.concatenate([np.flatnonzero(begins)[1:] - 1, [len(chosen) - 1]])]
    next_end = np.searchsorted(ends, at, side="right")
    return np.append(starts, np.iinfo(np.int64).max)[next_end] < to


def _bitmap(state: DataFrame) -> bytes:
    """A bit for each rank: whether the family is in."""
    pages = state.where("is_in").groupBy((F.col("rank") / _PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("rank") % _PAGE).alias("bits"))
    found = {r.page: bytes(r.bits) for r in pages.collect()}  # 4,096 pages of 4 KB at most
    return b"".join(found.get(p, bytes(_PAGE // 8)) for p in range(max(found, default=-1) + 1))


def _has_bit(bits: bytes | None, rank: np.ndarray) -> np.ndarray:
    """Whether each rank's bit is set; without bits all are."""
    if bits is None:
        return np.ones(len(rank), bool)
    held = np.frombuffer(bits, np.uint8)
    if not len(held):
        return np.zeros(len(rank), bool)
    byte = np.minimum(rank >> 3, len(held) - 1)
    return (rank < 8 * len(held)) & ((held[byte] >> (rank & 7).astype(np.uint8)) & 1).astype(bool)


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of ``least`` rows or more (the last one of any number) that end with a group of equal, adjacent ``keys``, and
    the number of each row's group within the table."""

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = table.column(k).combine_chunks()
            x, y = c[1:], c[:-1]
            new[1:] |= np.asarray(pc.coalesce(pc.not_equal(x, y), pc.xor(pc.is_null(x), pc.is_null(y))))
        return new

    held, rows, limit = [], 0, least
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < limit:
            continue
        table = pa.Table.from_batches(held)
        new = begins(table)
        stop = int(np.flatnonzero(new)[-1])
        if stop:
            yield table.slice(0, stop), np.cumsum(new[:stop]) - 1
            held, rows, limit = table.slice(stop).to_batches(), rows - stop, least
        else:
            limit = 2 * rows  # all of it is one group so far
    if rows:
        table = pa.Table.from_batches(held)
        yield table, np.cumsum(begins(table)) - 1


def decide_in_order(
    own: DataFrame, ranks: DataFrame, stretch: int, free_bases: Callable, worth: Callable, parts: tuple[Column, Column], judge: Callable[[DataFrame], DataFrame], most: int = 10_000
) -> DataFrame:
    """The families of ``ranks`` (rank and more) as a fold in order of rank would decide them, without the fold.

    First all are taken to be in. In a round every family is judged by the bases that the families before it, as they
    stand, leave free. If all before a family stand as the fold has them, it does after the round; so the first wrong
    family is right after each round, for good, and a round that changes nothing has what the fold gives. (It usually takes
    three to six, as few families change sides when others do.)

    The instances ``own`` go to their stretch once, and stay on the executors' disks in packets of whole stretches. In the
    first round a kernel finds their free bases and ``worth`` (free, size, divergence) what they save and whether they are
    used; in the others it looks only at what overlaps instances of families that changed sides, and sums are told what is
    gained or lost. Instances that lie in several stretches are put together in each round; ``parts`` is what they save, and
    whether they are used, of the columns free, size and divergence. ``judge`` gives ``ranks`` with saved, bases and used of
    each family is_in. Who is in, and was, is told by a bit per family, 16 MB at most, beyond which the pieces are joined
    with it. No group is larger than a stretch, and no component meets in one.
    """
    spark = own.sparkSession
    few = ranks.count() < _PAGE * _MOST_PAGES
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.count() // _TASK + 1)
    several = F.col("_to") - F.col("_from") < F.col("size")
    divergence = F.col("divergence") if "divergence" in own.columns else F.lit(None)
    pieces = stretches(own, stretch).select(
        "seq_index", "_bin", "rank", (F.col("_from") - F.col("_bin") * stretch).cast("int").alias("at"), (F.col("_to") - F.col("_bin") * stretch).cast("int").alias("to"),
        F.when(several, F.col("row")).alias("row"), F.when(several, F.col("size")).alias("size"), divergence.cast("double").alias("divergence"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches, ["seq_index", "_bin"]):
            at, to = (np.asarray(table.column(c)) + group * stretch for c in ("at", "to"))
            for name, x in (("at", at), ("to", to)):
                table = table.set_column(table.column_names.index(name), name, pa.array(x))
            table = table.drop_columns(["seq_index", "_bin"]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()])], names=["packet"])

    def packed(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "seq_index", "_bin").sortWithinPartitions("seq_index", "_bin").mapInArrow(pack, "packet binary")

    stored = packed(pieces).persist(StorageLevel.DISK_ONLY) if few else pieces
    kinds = {"rank": pa.int64(), "row": pa.int64(), "free": pa.int64(), "size": pa.int64(), "divergence": pa.float64(), "saved": pa.float64(), "used": pa.int64()}
    schema = pa.schema(list(kinds.items()))

    def look(table: pa.Table, bits: tuple[bytes | None, bytes] | None) -> pa.RecordBatch:
        rank, at, to = (table.column(c).to_numpy() for c in ("rank", "at", "to"))
        several = np.asarray(table.column("row").is_valid())
        size = np.where(several, _integers(table.column("size"), 0), to - at)
        divergence = np.asarray(table.column("divergence").to_numpy(), float)
        first = bits is None and "is_in" not in table.column_names
        had = np.zeros(len(rank), np.int64)
        if first:
            free, changed = free_bases(rank, np.ones(len(rank), bool), at, to), ~several
        else:
            was, now = (np.asarray(table.column(c)) for c in ("_was", "is_in")) if bits is None else (_has_bit(b, rank) for b in bits)
            asked = _meets(was != now, at, to) | several
            near = np.flatnonzero(_meets(asked, at, to))
            free = np.zeros(len(rank), np.int64)
            free[near] = free_bases(rank[near], now[near], at[near], to[near])
            had[near] = free_bases(rank[near], was[near], at[near], to[near]) if (was != now).any() else free[near]
            changed = asked & ~several & (free != had)
        some, ends = np.flatnonzero(changed), np.flatnonzero(several)
        saved, used = worth(free[some], size[some], divergence[some])
        if not first:
            before = worth(had[some], size[some], divergence[some])
            saved, used = saved - before[0], used - before[1]
        of, bases, saved, used = _by_rank(rank[some], free[some] - had[some], saved, used)
        n, zeros = len(of), np.zeros
        columns = [
            np.concatenate([of, rank[ends]]), pa.concat_arrays([pa.nulls(n, pa.int64()), table.column("row").combine_chunks().take(pa.array(ends))]),
            np.concatenate([np.rint(bases).astype(np.int64), free[ends]]), np.concatenate([zeros(n, np.int64), size[ends]]),
            pa.array(np.concatenate([zeros(n), divergence[ends]]), from_pandas=True), np.concatenate([saved, zeros(len(ends))]), np.concatenate([np.rint(used).astype(np.int64), zeros(len(ends), np.int64)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=schema)

    state, was = None, None
    whole = F.col("row").isNull()
    for _ in range(most):
        now = _bitmap(state) if state is not None and few else None
        shared = spark.sparkContext.broadcast((was, now)) if now is not None else None
        marked = stored if few else packed(stored if state is None else stored.join(state.select("rank", "is_in", "_was"), "rank"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # runs before the next round binds ``shared`` anew
            for b in batches:
                for packet in b.column(0):
                    found = look(pa.ipc.open_stream(packet.as_buffer()).read_all(), None if shared is None else shared.value)
                    if found.num_rows:
                        yield found

        found = marked.mapInArrow(run, "rank long, row long, free long, size long, divergence double, saved double, used long").withColumn("was", F.lit(None).cast("boolean"))
        if state is not None:
            found = found.unionByName(state.select(
                "rank", F.lit(None).cast("long").alias("row"), F.col("_bases").alias("free"), F.lit(0).cast("long").alias("size"),
                F.lit(0.0).alias("divergence"), F.col("_saved").alias("saved"), F.col("_used").alias("used"), F.col("is_in").alias("was"),
            ))
        # by rank once, which serves what is put together by instance and by family alike
        by_row = found.repartition("rank").groupBy("rank", "row").agg(
            *[F.sum(c).alias(c) for c in ("free", "saved", "used")], *[F.max(c).alias(c) for c in ("size", "divergence", "was")]
        )
        sums = by_row.groupBy("rank").agg(
            F.sum("free").alias("bases"), F.sum(F.when(whole, F.col("saved")).otherwise(parts[0])).alias("saved"), F.sum(F.when(whole, F.col("used")).otherwise(parts[1])).alias("used"),
            F.max("was").alias("_was"), *[F.sum(F.when(whole, F.col(c))).alias(f"_{n}") for n, c in (("bases", "free"), ("saved", "saved"), ("used", "used"))],
        )
        named = [f"{p}{c}" for p in ("", "_") for c in ("bases", "saved", "used")]
        joined = ranks.join(sums, "rank", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in named} | {"_was": F.coalesce("_was", F.lit(True))})
        # what is gained and lost leaves a trace of rounding in a sum of nothing
        after = cut(judge(joined.withColumn("saved", F.when(F.col("bases") > 0, F.col("saved")).otherwise(F.lit(0.0)))), "decided")
        if shared is not None:
            shared.unpersist()
        if not after.where("is_in <> _was").limit(1).count():
            stored.unpersist()
            return after.drop("_was", "_bases", "_saved", "_used")
        state, was = after, now
    raise RuntimeError(f"families were not decided within {most} rounds")


def _by_rank(rank: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct ranks and the sums of ``values`` for each."""
    ranks, number = np.unique(rank, return_inverse=True)
    return ranks, *(np.bincount(number, v, len(ranks)) for v in values)


def select_library(instances: DataFrame, families: DataFrame, mode: str = "exact", stretch: int = STRETCH) -> DataFrame:
    """One row per family: scores, state (exclusive, standalone, rejected), exclusive coverage, flags and tier.

    Families are taken by descending score (then id); an instance counts by the bases that no accepted family has
    claimed. A family is accepted if that score is positive, or on its own account if it has a positive score, 50 bases
    and 3 instances; accepted families claim their instances. Families without a positive score or with fewer than two
    instances are rejected before any interval is looked at and never claim.
    """
    scores = cut(family_scores(instances, families, mode), "scores")
    eligible = ranking(scores.where("score > 0 and n >= 2"), "score", weakest_first=False)
    own = numbered(instances, eligible, "divergence")
    totals = own.groupBy("rank").agg(F.sum("size").alias("total"))
    eligible = cut(eligible.join(totals, "rank"), "eligible")
    standing = (F.col("consensus_length") >= 50) & (F.col("n") >= 3)

    def worth(free: np.ndarray, size: np.ndarray, divergence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unknown = np.isnan(divergence)
        edits = np.where(unknown, free, np.floor(np.where(unknown, 0.0, divergence) * free + 0.5)).astype(np.int64)
        return np.where(free > 0, 2.0 * free - mdl.instance_costs(free, edits, mode), 0.0), (free > 0).astype(np.int64)

    cost = mdl.instance_cost("free", F.floor(F.col("divergence") * F.col("free") + 0.5), mode)
    parts = F.when(F.col("free") > 0, 2.0 * F.col("free") - cost).otherwise(F.lit(0.0)), (F.col("free") > 0).cast("long")

    def judge(found: DataFrame) -> DataFrame:
        judged = found.withColumn("own_score", F.col("saved") - F.col("model_cost"))
        exclusive = F.col("own_score") > 1e-9
        state = F.when(exclusive, F.lit("exclusive")).when(standing, F.lit("standalone")).otherwise(F.lit("rejected"))
        return judged.withColumns({"state": state, "is_in": exclusive | standing, "used": F.col("used").cast("int")}).select(
            "rank", "family_id", "saved", "own_score", "bases", "used", "total", "state", "is_in", "_was", "_bases", "_saved", "_used"
        )

    decided = decide_in_order(own, eligible, stretch, unclaimed, worth, parts, judge).drop("is_in", "rank")
    base = mdl.base_flags("consensus_length", "n", F.round("mean_divergence", 9))  # a mean at the limit reaches it in whatever order it is summed

    def bit(name: str, test) -> Column:
        return F.when(test, F.lit(mdl.BIT[name])).otherwise(F.lit(0))

    more = (
        bit("no_exclusive_bases", F.col("bases") == 0).bitwiseOR(bit("nonpositive_exclusive_mdl", F.col("state") != "exclusive"))
        .bitwiseOR(bit("low_exclusive_fraction", (F.col("bases") > 0) & (F.col("bases") * 4 < F.col("total")))).bitwiseOR(bit("standalone_fallback", F.col("state") == "standalone"))
    )
    joined = scores.join(decided.withColumnRenamed("state", "_state"), "family_id", "left").withColumn("state", F.coalesce("_state", F.lit("rejected")))
    judged = F.col("_state").isNotNull()
    tier = F.when(F.col("state") == "rejected", "reject").when((F.col("state") == "standalone") | (base != 0), "warn").otherwise("core")
    return joined.select(
        "family_id", "consensus_length", "n", "mean_divergence", "model_cost", "savings", "score", "state",
        F.coalesce("saved", F.lit(0.0)).alias("exclusive_savings"), F.coalesce("own_score", F.lit(0.0)).alias("exclusive_score"),
        F.coalesce("bases", F.lit(0)).alias("exclusive_bases"), F.coalesce("used", F.lit(0)).alias("exclusive_instances"),
        F.when(judged, base.bitwiseOR(more)).otherwise(base).cast("int").alias("quality_flags"), tier.alias("tier"),
    )


def library_summary(selected: DataFrame, instances: DataFrame, genome_length: int) -> DataFrame:
    """One row: accepted families, library and total bits, compression ratio within 0..1, bases covered."""
    ok = selected.where("state in ('exclusive', 'standalone')")
    sums = ok.agg(F.count(F.lit(1)).alias("accepted"), F.coalesce(F.sum("model_cost"), F.lit(0.0)).alias("models"), F.coalesce(F.sum(F.when(F.col("state") == "exclusive", F.col("exclusive_savings"))), F.lit(0.0)).alias("saved"))
    union = interval_union(instances.join(ok.select("family_id"), "family_id", "left_semi"), ["seq_index"])
    covered = union.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bases_covered"))
    library = mdl.universal_int(F.greatest("accepted", F.lit(1))) + F.col("models")
    total = F.greatest(F.lit(0.0), F.lit(2.0 * genome_length) - F.col("saved") + F.col("dl_library"))
    one = sums.withColumn("dl_library", library).withColumn("dl_total", total)
    return one.crossJoin(F.broadcast(covered)).select(  # one row each
        "accepted", "dl_library", "dl_total", (F.col("dl_total") / (2.0 * genome_length)).alias("ratio"), "bases_covered"
    )


def prune_redundant(selected: DataFrame, instances: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``selected`` with pruned families (state pruned, flag set): weakest first, a family goes if none of its instances
    has a quarter of its length outside the other accepted families that are still in."""
    ok = selected.where("state in ('exclusive', 'standalone')").select("family_id", "score")
    if ok.limit(2).count() < 2:
        return selected
    ok = ranking(ok, "score", weakest_first=True)
    own = numbered(instances, ok)
    # an instance of under four bases has a quarter, none, outside the others in any case
    tiny = own.groupBy("rank").agg(F.bool_or(F.col("size") < 4).alias("tiny"))
    held = cut(ok.join(tiny, "rank"), "accepted")

    def worth(free: np.ndarray, size: np.ndarray, divergence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(len(free)), (free >= size // 4).astype(np.int64)

    parts = F.lit(0.0), (F.col("free") >= F.floor(F.col("size") / 4)).cast("long")

    def judge(found: DataFrame) -> DataFrame:
        return found.withColumn("is_in", (F.col("used") > 0) | F.col("tiny")).select("rank", "family_id", "is_in", "_was", "_bases", "_saved", "_used")

    decided = decide_in_order(own, held, stretch, unshared, worth, parts, judge)
    gone = decided.where("not is_in").select("family_id", F.lit(True).alias("_gone"))
    # a family without an instance has none outside the others
    bare = ok.join(held, "family_id", "left_anti").select("family_id", F.lit(True).alias("_gone"))
    joined = selected.join(gone.unionByName(bare), "family_id", "left")
    flag = F.col("quality_flags").bitwiseOR(mdl.BIT["pruned_redundant"])
    return joined.withColumn("state", F.when(F.col("_gone"), F.lit("pruned")).otherwise(F.col("state"))).withColumn(
        "quality_flags", F.when(F.col("_gone"), flag).otherwise(F.col("quality_flags"))
    ).drop("_gone")


def coalesce_tandem(instances: DataFrame, families: DataFrame, factor: float = 20.0, floor: int = 50, slack: int = -10) -> DataFrame:
    """(family_id, seq_index, strand, start, end, num_edits, merged): neighbours of one family and strand joined where the
    gap from the active interval's end is ``slack`` .. max(floor, factor * consensus length).

    An ordered fold, because a larger overlap starts a new active interval: rows of a family and record are put in order
    of start, and a change of strand breaks the run. A merged neighbour that ends later extends the active one and adds
    its edits and the gap; one inside it is dropped. A task streams its sorted rows and holds one active interval.
    """
    limit = F.greatest(F.lit(floor), F.floor(F.lit(factor) * F.col("consensus_length"))).cast("long")
    rows = instances.join(families.select("family_id", "consensus_length"), "family_id").select(
        "family_id", "seq_index", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("strand").cast("int").alias("strand"),
        F.col("num_edits").cast("long").alias("num_edits"), limit.alias("limit"), "instance_idx",
    )
    keys = ["family_id", "seq_index"]
    kinds = dict(rows.dtypes)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "start", "end", "strand", "instance_idx", "num_edits").drop("instance_idx")
    names = [*keys, "strand", "start", "end", "num_edits", "merged"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active: list | None = None  # family, record, strand, start, end, edits, merged
        for b in batches:
            done: list[list] = []
            for fam, rec, start, end, strand, edits, most in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if active is not None and active[0] == fam and active[1] == rec and active[2] == strand and slack <= start - active[4] <= most:
                    if end > active[4]:
                        active[5] += edits + max(start - active[4], 0)
                        active[4] = end
                    active[6] += 1
                else:
                    if active is not None:
                        done.append(active)
                    active = [fam, rec, strand, start, end, edits, 1]
            if done:
                yield emit(done)
        if active is not None:
            yield emit([active])

    def emit(rows: list[list]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32() if kinds["seq_index"] == "int" else pa.int64(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = f"family_id long, seq_index {kinds['seq_index']}, strand int, start long, end long, num_edits long, merged long"
    return ordered.mapInArrow(run, schema).select(*keys, "start", "end", "strand", "num_edits", "merged")


def drop_chimeras(selected: DataFrame, least: int = 8000, divergence: float = 0.40) -> DataFrame:
    """Accepted families of ``least`` bases and a mean divergence over ``divergence`` become rejected."""
    bad = F.col("state").isin("exclusive", "standalone") & (F.col("consensus_length") >= least) & (F.col("mean_divergence") > divergence)
    return selected.withColumn("state", F.when(bad, F.lit("rejected")).otherwise(F.col("state")))


def compact(families: DataFrame, counts: DataFrame, k: int, good_length: int = 30) -> DataFrame:
    """Families with 2 instances and max(2k, good_length) bases, numbered densely from 0 in id order.

    The new number is an offset per id range plus the place in it, so the numbering isn't one task's sort.
    """
    kept = families.join(counts, "family_id").where((F.col("n") >= 2) & (F.col("consensus_length") >= max(2 * k, good_length)))
    return densely(kept, "family_id", "new_id")


def densely(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with their number from 0 in the order of the distinct integers of ``column`` as ``name``."""
    ranged = rows.withColumn("_r", F.floor(F.col(column) / 65_536))
    sizes = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_c"))
    offset = sizes.select("_r", F.coalesce(F.sum("_c").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    place = F.row_number().over(W.partitionBy("_r").orderBy(column)) - 1
    return ranged.withColumn("_p", place).join(offset, "_r").withColumn(name, (F.col("_p") + F.col("_o")).cast("long")).drop("_r", "_p", "_o")


def coverage_by_others(instances: DataFrame, width: int) -> DataFrame:
    """(family_id, instance_idx, others): how many instances of other families overlap each instance."""
    own = instances.select("family_id", "instance_idx", "seq_index", "start", "end")
    pairs = overlap_join(own, own, ["seq_index"], width).where("a_family_id <> b_family_id")
    return pairs.groupBy(F.col("a_family_id").alias("family_id"), F.col("a_instance_idx").alias("instance_idx")).agg(F.count(F.lit(1)).alias("others"))


def accepted(states: Iterable[str] = ("exclusive", "standalone")):
    return F.col("state").isin(*states)
