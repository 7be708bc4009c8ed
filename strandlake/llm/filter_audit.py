"""Audit of how quality filters interact: every order of the filters, what each step removes, what others would have removed.

Counts per document come from the Arrow buffer of a whole batch: byte classes as NumPy masks, their prefix sums read at
the documents' ends, and word hashes that are sorted per document and verified byte by byte.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.arrow_batches import bounded, give_back, small_batches
from strandlake.operators.hot_keys import split_hot
from strandlake.storage import cut

FILTERS = "ABCDE"
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20  # bytes that are hashed, or compared, at once

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, _PIECE + 1)
            step = np.full(n, _BASE, np.uint64)
            back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        return self.up, self.down


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums over pieces of consecutive words."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE, side="right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        up, down = powers.of(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * down[: hi - lo], out=sums[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = (sums[e] - sums[s]) * up[s]
        at = stop
    return out


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For pairs of words of equal size, given by their starts, whether their bytes differ."""
    out = np.zeros(len(a), bool)
    total = np.cumsum(sizes)
    at = 0
    while at < len(a):
        base = int(total[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + _PIECE, side="right")))
        n = sizes[at:stop]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        same = data[np.repeat(a[at:stop], n) + within] == data[np.repeat(b[at:stop], n) + within]
        out[at:stop] = ~np.logical_and.reduceat(same, first)
        at = stop
    return out


def text_counts(texts: pa.Array, powers: _Powers | None = None, hashes=word_hashes) -> dict[str, np.ndarray]:
    """words, distinct (words), capitals, symbols and points (code points) of each text; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.empty(0, np.uint8)
    at = offsets - offsets[0]

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a document's first byte, or the one behind its last
    edge[at] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    words = count(opens)
    who = np.repeat(np.arange(len(texts)), words)
    h = hashes(data, starts, ends, powers or _Powers())
    order = np.lexsort((h, who))
    first, second = order[:-1], order[1:]
    again = (who[first] == who[second]) & (h[first] == h[second])
    distinct = words - np.bincount(who[second[again]], minlength=len(texts))
    a, b = first[again], second[again]
    sizes = ends - starts
    wrong = sizes[a] != sizes[b]
    alike = np.flatnonzero(~wrong)
    wrong[alike] = _differ(data, starts[a[alike]], starts[b[alike]], sizes[a[alike]])
    for doc in np.unique(who[b[wrong]]):  # different words with one hash: count this document's words themselves
        mine = np.flatnonzero(who == doc)
        distinct[doc] = len({data[s:e].tobytes() for s, e in zip(starts[mine], ends[mine], strict=True)})
    return {"words": words, "distinct": distinct, "capitals": count(_CAPITAL[data]), "symbols": count(_SYMBOL[data]), "points": count(_FIRST[data])}


def failed_filters(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Bit i: filter i of A to D fails."""
    n = counts["words"]
    fails = (n < 200, 100 * counts["distinct"] < 50 * n, 100 * counts["capitals"] > 2 * counts["points"], counts["symbols"] > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: id, part, mask (bit i: the filter FILTERS[i] fails).

    A: under 200 words; B: fewer than half of them distinct; C: more than 2 % capitals; D: holds one of ``#$%&*|``; E: a
    smaller id has the identical text. Texts are read whole. Ids of equal texts meet by the text's SHA-256: least ids are
    combined map-side, digests of more than one row in 4096 are broadcast (fewer than 4096 rows), others exchanged.

    Cases: null texts are empty (A fails; they have no words, and B holds for none) and equal each other; a null part is
    the empty string; rows that repeat id and text don't make each other fail E; a null id is never a smaller id and has
    none; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in bounded(batches, 3):
            mask = failed_filters(text_counts(b.column(3), powers))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(mask, pa.int32())], names=["id", "part", "digest", "mask"])
        give_back()

    scanned = cut(rows.mapInArrow(run, "id long, part string, digest binary, mask int"), "filter-failures")
    same = scanned.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot, cold = split_hot(cut(same, "filter-copies"), "n", scanned.count())
    known = scanned.join(F.broadcast(hot.select("digest", F.col("least").alias("hot_least"))), "digest", "left")
    settled = known.where("hot_least is not null").withColumnRenamed("hot_least", "least")
    others = known.where("hot_least is null").drop("hot_least").join(cold.drop("n"), "digest", "left")
    both = settled.unionByName(others)
    repeated = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return both.select("id", "part", F.col("mask").bitwiseOR(F.when(repeated, 16).otherwise(0)).alias("mask"))


def audit(fails: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each part, each of the 120 orders of the five filters and each step of it: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Documents are counted per part and mask first (32 masks a part, map-side), and only these counts meet the 600 steps,
    so work on the orders doesn't grow with the documents. ``labels`` has (id, quality, toxic): of several rows for one
    id the larger labels count; null labels and ids are none. No rows in ``fails``: no rows.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("long").alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long").alias("bad")
    )
    counts = fails.join(known, "id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    steps = [
        (("".join(order)), i + 1, 1 << FILTERS.index(order[i]), sum(1 << FILTERS.index(f) for f in order[:i]))
        for order in itertools.permutations(FILTERS) for i in range(len(FILTERS))
    ]
    # one value, kept as text: 600 structs of literals would be a plan of thousands of nodes
    said = ";".join(f"{o},{s},{own},{before}" for o, s, own, before in steps)
    listed = counts.withColumn("_step", F.explode(F.split(F.lit(said), ";"))).withColumn("_step", F.split("_step", ","))
    each = listed.select(
        "part", "mask", "n", "good", "bad", F.col("_step")[0].alias("filter_order"), F.col("_step")[1].cast("int").alias("step"),
        F.col("_step")[2].cast("int").alias("own"), F.col("_step")[3].cast("int").alias("before"),
    )
    fails_now, failed = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(when, of: str = "n"):
        return F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0)).cast("long")

    share = F.col("n") * F.lit(120) / F.bit_count("mask")  # a document that fails m filters is removed by each in 120 / m orders
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails_now & ~failed).alias("kept"), total(fails_now & ~failed).alias("removed"), total(fails_now & failed).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails_now & ~failed, "good").alias("good_lost"), total(fails_now & ~failed, "bad").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails_now, share.cast("long"))), F.lit(0)).cast("long").alias("shapley"),
    )
