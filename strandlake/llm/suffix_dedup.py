"""Removal of passages that occur elsewhere: every byte under a string of ``length`` bytes that starts at two places.

Sample. Each place p (of a string p .. p + length) has an anchor: of the ``window`` grams from p on the one of least hash,
the rightmost of equals. It depends on the string's own bytes only, so equal strings have it at the same distance d <
``window``, and equal bytes from it on. Hence, for strings to be equal, ``length`` - ``window`` + 1 bytes from the anchor
(its core) must occur twice. Cores are counted as hashes; what passes is a superset, and decides nothing.

Contexts. All places of one anchor, with the bytes of their strings, are its context. A context that occurs twice is
settled: all its places are doubles. Contexts that occur once, and those that share a core with one, are compared: the
distinct texts behind their anchors are put in order by the difference-cover suffix sort (``suffix_array``), neighbours'
common prefixes give, for every L, the runs of texts that share L bytes, and a place at distance d equals another iff its d
bytes before the anchor and its run at ``length`` - d do: the remaining suffixes are matched by their bytes up to the next
sample and that sample's rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.arrow_batches import bounded, give_back, small_batches
from strandlake.llm.shingles import mix
from strandlake.llm.suffix_array import suffix_ranks
from strandlake.operators.sieve import BitSieve, sieve_bits
from strandlake.storage import cut, grown

_BASE = 0x9E3779B97F4A7C15
_BASE_2 = 0xC2B2AE3D27D4EB4F
_BLOCK = 1 << 20  # places that are looked at together; below the 21 bits that number them
_PLACE = np.uint64((1 << 21) - 1)
_SLICE = 1 << 18  # bytes of texts that are parsed together, unless one is longer
_PAGE = 32768


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64."""
    step = np.full(n, base, np.uint64)
    step[0] = 1
    return np.cumprod(step, dtype=np.uint64)


def anchors(data: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each run of ``window`` grams in ``data`` (under 2^21 bytes), the place of its least gram, rightmost of equals."""
    n = len(data) - gram + 1
    grams = np.ndarray((n,), f"<u{gram}", np.ascontiguousarray(data), strides=(1,))
    key = grams * np.uint64(_BASE)  # its high bits are the hash
    key ^= key >> np.uint64(32)
    key *= np.uint64(_BASE_2)
    key &= ~_PLACE
    key |= np.arange(int(_PLACE), int(_PLACE) - n, -1).astype(np.uint64)
    size = 1
    while 2 * size <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < window:
        key = np.minimum(key[: size - window], key[window - size :])
    return (_PLACE - (key & _PLACE)).astype(np.int64)


class Parse:
    """The anchors of texts that stand behind each other, block by block."""

    def __init__(self, length: int, window: int, gram: int):
        if gram not in (1, 2, 4, 8) or window < 1 or window + gram > length + 1:
            raise ValueError("gram must be 1, 2, 4 or 8, and a string must hold a window of grams")
        self.length, self.window, self.gram = length, window, gram
        self.core = length - window + 1

    @cached_property  # made where it is used: a task's closure doesn't carry it
    def up(self) -> np.ndarray:
        return _powers(_BASE, _BLOCK + self.length)

    @cached_property
    def down(self) -> np.ndarray:
        return _powers(pow(_BASE, -1, 1 << 64), _BLOCK + self.length)

    def blocks(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(base, bytes, first, last, anchor): the places that have one anchor, relative to the block's bytes. Text i is
        ``data[ends[i] : ends[i + 1]]``; strings lie within a text."""
        change = np.zeros(len(data) + 1, np.int8)
        fits = np.diff(ends) >= self.length
        change[ends[:-1][fits]] += 1
        change[ends[1:][fits] - self.length + 1] -= 1  # no other text begins there: strings have two bytes at least
        inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
        for base in range(0, len(data) - self.length + 1, _BLOCK):
            own = data[base : base + _BLOCK + self.length - 1]
            at = anchors(own, self.window, self.gram)[: len(own) - self.length + 1]
            valid = inside[base : base + len(at)]
            turns = np.ones(len(at) + 1, bool)
            turns[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
            first = np.flatnonzero(valid & turns[:-1])
            yield base, own, first, np.flatnonzero(valid & turns[1:]), at[first]

    def cores(self, data: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """A hash of the bytes that any string with this anchor holds from it on."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[: len(data)], out=sums[1:])
        return mix((sums[anchor + self.core] - sums[anchor]) * self.up[anchor]).view(np.int64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, without copies, and where each begins and ends."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held else np.empty(0, np.uint8), at - at[0]


class Bits:
    """A sieve of 64-bit hashes that Python tasks read: 2^27 bits (16 MB) at most, whatever their number. A hash has two bits,
    and some sixteen hashes' worth of room, so one in sixty others passes; more do past eight million hashes."""

    def __init__(self, hashes: DataFrame, column: str):
        self.bits = sieve_bits(2 * hashes.count())
        mask = (1 << self.bits) - 1
        low, high = F.col(column).bitwiseAND(mask), F.shiftrightunsigned(F.col(column), 32).bitwiseAND(mask)
        rows = hashes.select(F.explode(F.array(low, high)).alias("at"))
        pages = rows.groupBy((F.col("at") / _PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("at") % _PAGE).alias("bitmap"))
        held = np.zeros((1 << self.bits) // 8, np.uint8)
        for page, bitmap in pages.collect():  # 4,096 pages of 4 KB at most
            held[page * _PAGE // 8 : (page + 1) * _PAGE // 8] = np.frombuffer(bitmap, np.uint8)
        self.shared = hashes.sparkSession.sparkContext.broadcast(held.tobytes())

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        held, mask = np.frombuffer(self.shared.value, np.uint8), (1 << self.bits) - 1
        low, high = hashes & mask, (hashes.view(np.uint64) >> np.uint64(32)).astype(np.int64) & mask
        return (held[low >> 3] >> (low & 7).astype(np.uint8)) & (held[high >> 3] >> (high & 7).astype(np.uint8)) & 1 != 0


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings begin with alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
    return int(differ[0]) if len(differ) else n


def text_runs(rights: DataFrame, length: int, window: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``rights`` (rank, s, right, shared) in order of rank -> (s, part, top, upto, ids) and what each part carries on.

    The run of a text at L is named by the rank of its first text. ``ids`` holds the run for each L from ``length`` -
    ``window`` + 1 on, as steps: ids[j] up to upto[j]. 0 stands for a run that began before this part of the sort, which
    the second value resolves: one array a partition. Above ``top`` no other text shares L bytes. Neighbours are
    compared as they stream by; a task holds two texts.
    """
    least = length - window + 1
    kinds = {"s": pa.int64(), "part": pa.int32(), "top": pa.int32(), "upto": pa.list_(pa.int32()), "ids": pa.list_(pa.int64()), "first": pa.binary(), "last": pa.binary(), "rank": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run_of = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        held, before, first, first_rank = None, None, None, None
        for b in batches:
            out = []
            for rank, s, right, shared in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if before is None:
                    first, first_rank, ahead = right, rank, length
                else:
                    ahead = _common(before, right)
                    run_of[ahead + 1 :] = rank
                if held is not None:
                    held[2] = max(held[2], ahead)
                    out.append(held)
                runs = run_of[least : len(right) + 1]
                ends = np.flatnonzero(np.concatenate([runs[1:] != runs[:-1], [True]]))
                held = [s, part, len(right) if shared else ahead, (ends + least).tolist(), runs[ends].tolist(), None, None, None]
                before = right
            if out:
                yield emit(out)
        if held is not None:
            held[2] = length
            yield emit([held, [None, part, None, None, run_of.tolist(), first, before, first_rank]])

    def emit(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    ordered = rights.select("rank", "s", "right", "shared").orderBy("rank")
    both = cut(ordered.mapInArrow(run, "s long, part int, top int, upto array<int>, ids array<long>, first binary, last binary, rank long"), "suffix-runs")
    carried, last, runs = {}, None, None
    for r in both.where("s is null").orderBy("part").collect():  # a row per partition of the sort
        mine = np.full(length + 1, r.rank, np.int64)
        if last is not None:
            same = _common(bytes(last), bytes(r.first))
            mine[: same + 1] = runs[: same + 1]
        own = np.array(r.ids, np.int64)
        carried[r.part], last, runs = mine, r.last, np.where(own == 0, mine, own)
    return both.where("s is not null").select("s", "part", "top", "upto", "ids"), carried


def _places(carried, length: int, places: bool):
    """(ctx, left, least, most, part, top, upto, ids) -> a row per place: key, key2 (of the run and the bytes before the
    anchor) and, if ``places``, ctx and d."""
    names = ["key", "key2", "ctx", "d"][: 4 if places else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [_powers(b, length + 1) for b in (_BASE, _BASE_2)]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for ctx, left, least, most, part, top, upto, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = np.arange(max(least, length - top), most + 1)
                if not len(d):
                    continue
                runs = np.array(ids, np.int64)[np.searchsorted(upto, length - d)]
                runs = np.where(runs == 0, carried.value[part][length - d], runs).astype(np.uint64)
                back = np.frombuffer(left, np.uint8)[::-1].astype(np.uint64) + np.uint64(1)
                hashes = []
                for p in powers:
                    sums = np.zeros(len(back) + 1, np.uint64)
                    np.cumsum(back * p[: len(back)], out=sums[1:])
                    hashes.append(mix(mix(sums[d] + p[d]) ^ mix(runs * np.uint64(_BASE) + d.astype(np.uint64))).view(np.int64))
                for o, v in zip(out, (hashes[0], hashes[1] >> 32, np.full(len(d), ctx), d)):
                    o.append(v)
            if out[0]:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int16())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)).cast(t) for o, t in zip(out, kinds)], names=names)

    return run


def repeated_places(df: DataFrame, parse: Parse, block: int = 0) -> DataFrame:
    """``df`` (key binary, text string) -> (key, first, count, offsets): the places of a text whose strings occur elsewhere:
    all of first .. first + count - 1 where ``offsets`` is null, else first + each of them."""
    spark = df.sparkSession
    length, window = parse.length, parse.window
    block = block or -(-length // 4)

    def core_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 0, _SLICE):
            found = [parse.cores(data, anchor) for _, data, _, _, anchor in parse.blocks(*_bytes(b.column(0)))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["core"])
        give_back()

    cores = df.select("text").mapInArrow(core_rows, "core long").groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    twice = Bits(cut(cores, "repeat-cores"), "core")

    def contexts_of(texts: pa.Array, *sieves: Bits) -> Iterator[tuple]:
        """Of each block: text number, place in it, core, and within the block's bytes first, last, anchor, and the contexts."""
        data, ends = _bytes(texts)
        for base, own, first, last, anchor in parse.blocks(data, ends):
            core = parse.cores(own, anchor)
            some = np.flatnonzero(np.logical_and.reduce([sieve.holds(core) for sieve in sieves]))
            first, last, anchor = first[some], last[some], anchor[some]
            who = np.searchsorted(ends, first + base, side="right") - 1
            held = own.tobytes() if len(some) else b""
            spans = zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)
            contexts = [xxhash.xxh3_128_digest(held[lo : hi + length], seed=a - lo) for lo, hi, a in spans]
            yield who, first + base - ends[who], core[some], held, first, last, anchor, contexts

    def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1, _SLICE):
            for who, place, core, _, first, last, _, contexts in contexts_of(b.column(1), twice):
                columns = [b.column(0).take(pa.array(who)), pa.array(core), pa.array(contexts, pa.binary()), pa.array(place), pa.array((last - first + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "core", "context", "first", "count"])
        give_back()

    found = cut(df.select("key", "text").mapInArrow(context_rows, "key binary, core long, context binary, first long, count int"), "repeat-found")
    contexts = cut(found.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.first("core").alias("core")), "repeat-contexts")
    open_cores = contexts.groupBy("core").agg(F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("open")).where("all > 1 and open > 0")
    open_cores = cut(open_cores.select("core"), "repeat-open")
    wanted = contexts.join(grown(open_cores), "core", "left_semi").select("context", (F.col("n") == 1).alias("open"))
    wanted = cut(wanted.withColumn("number", F.monotonically_increasing_id()), "repeat-wanted")
    compared = Bits(open_cores, "core")

    def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # spares rows of contexts that this task has given; emptied when large
        for b in bounded(batches, 0, _SLICE):
            out: list[tuple] = []
            for *_, held, first, last, anchor, contexts in contexts_of(b.column(0), twice, compared):
                for context, lo, hi, a in zip(contexts, first.tolist(), last.tolist(), anchor.tolist(), strict=True):
                    if context not in seen:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen.add(context)
                        out.append((context, held[lo:a], held[a : hi + length], a - hi, a - lo))
            if out:
                kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(zip(*out), kinds, strict=True)], names=["context", "left", "right", "least", "most"])
        give_back()

    texts = df.select("text").mapInArrow(text_rows, "context binary, left binary, right binary, least int, most int")
    texts = cut(texts.withColumn("digest", F.unhex(F.md5("right"))), "repeat-texts")
    # one row per context (tasks may have given it more than once), one per distinct text behind an anchor
    sides = texts.groupBy("context").agg(*[F.first(c).alias(c) for c in ("digest", "left", "least", "most")])
    sides = cut(sides.join(grown(wanted.select("context", "open", "number")), "context"), "repeat-sides")
    uses = sides.groupBy("digest").agg((F.count(F.lit(1)) > 1).alias("shared"))
    rights = texts.groupBy("digest").agg(F.first("right").alias("right")).join(grown(uses), "digest")
    rights = cut(rights.withColumn("s", F.monotonically_increasing_id()), "repeat-rights")

    pieces = rights.select("s", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("right") - 1) / block).cast("int")), lambda i: F.substring("right", i * block + 1, F.lit(block)))).alias("i", "piece"))
    letters = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).orderBy("piece").withColumn("x", F.monotonically_increasing_id() + 1)
    strings = cut(pieces.join(grown(cut(letters, "repeat-letters")), "piece").select("s", "i", "x"), "repeat-strings")
    ranks = suffix_ranks(strings).where("i = 0").select("s", "rank")
    runs, carried = text_runs(rights.join(grown(ranks), "s"), length, window)
    shared = spark.sparkContext.broadcast(carried)

    placed = sides.join(grown(rights.select("digest", "s")), "digest").join(grown(runs), "s")
    placed = cut(placed.select("number", "open", "left", "least", "most", "part", "top", "upto", "ids"), "repeat-placed")
    kernel = ["number", "left", "least", "most", "part", "top", "upto", "ids"]
    each = placed.select(kernel).mapInArrow(_places(shared, length, False), "key long, key2 int")
    doubles = cut(each.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "key2"), "repeat-doubles")
    once = placed.where("open").select(kernel).mapInArrow(_places(shared, length, True), "key long, key2 int, ctx long, d short")
    maybe = BitSieve(doubles, ["key", "key2"], sieve_bits(doubles.count())).may_hold(once, [F.col("key"), F.col("key2")], "may")
    hits = maybe.where("may").join(grown(doubles), ["key", "key2"], "left_semi").groupBy(F.col("ctx").alias("number")).agg(F.collect_list(F.col("d").cast("int")).alias("ds"))
    partly = hits.join(grown(sides.select("number", "context", "most")), "number").select("context", F.expr("transform(ds, d -> most - d)").alias("offsets"))
    whole = contexts.where("n > 1").select("context", F.lit(None).cast("array<int>").alias("offsets"))
    return found.select("key", "context", "first", "count").join(grown(whole.unionByName(partly)), "context").select("key", "first", "count", "offsets")


def remove_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", window: int = 128, gram: int = 8, texts: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` also kept, binary): each text without the bytes that lie
    under a string of ``length`` bytes which also starts anywhere else, in the same text or another. All strings are judged
    on the input; removed runs may cut a code point, so what is kept is bytes.

    Cases: a null text is empty, and one shorter than ``length`` bytes loses nothing; a very long text is looked at in
    blocks of a million places; equal texts, rows that repeat an id or have none included, count as two places and lose all
    of it from ``length`` bytes on; an empty table gives an empty table; other columns are ignored, whatever their names.

    Only texts with something to remove are exchanged, each once. Texts behind anchors are a bounded string each, runs
    are compared in streams, and no group of copies meets in one task's memory.
    """
    small_batches(df.sparkSession)
    parse = Parse(length, window, gram)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"))
    docs = docs.withColumn("key", F.unhex(F.md5(F.concat_ws("|", F.md5("text"), F.col("id").cast("string")))))
    places = repeated_places(docs.where(F.octet_length("text") >= length), parse)
    by_text = places.groupBy("key").agg(F.collect_list(F.struct("first", "count", "offsets")).alias("places"))  # a text's own places
    by_text = cut(by_text, "repeat-places")
    sieve = BitSieve(by_text, ["key"], sieve_bits(by_text.count()))
    marked = sieve.may_hold(docs, [F.col("key")], "may")
    kept_names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
    plain = marked.where("not may").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"),
    ).select(kept_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1, _SLICE):
            data, ends = _bytes(b.column(1))
            lists = b.column(2)
            places = lists.flatten()
            base = np.repeat(ends[:-1], np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            offsets = places.field("offsets")
            first, whole = np.asarray(places.field("first")) + base, np.asarray(offsets.is_null())
            starts = np.zeros(len(data) + 1, np.int32)
            starts[first[whole]] += 1  # each place has one anchor, so no two begin or end at one
            starts[first[whole] + np.asarray(places.field("count"))[whole]] -= 1
            starts = np.cumsum(starts[:-1], dtype=np.int32)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(offsets), 0))
            starts[np.repeat(first, sizes) + np.asarray(offsets.flatten())] = 1
            so_far = np.concatenate([[0], np.cumsum(starts, dtype=np.int32)])
            out = []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                here = so_far[lo : hi + 1]
                gone = here[1:] > here[0]
                gone[length:] = here[length + 1 :] > here[1:-length]
                kept = data[lo:hi][~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(len(gone) and gone[0])
                out.append((hi - lo, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), *[kept] * texts))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array([o[i] for o in out], kinds[i]) for i in range(4 + texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=kept_names)
        give_back()

    maybe = marked.where("may").select("key", "id", "text").join(grown(by_text), "key", "left").select("id", "text", "places")
    kind = f"id {dict(docs.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return plain.unionByName(maybe.mapInArrow(run, kind)).withColumnRenamed("id", id_col)
