"""Document fingerprints by winnowing, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_POS_BITS = 30  # positions below 2^30
_POS_MASK = (1 << _POS_BITS) - 1
K, WINDOW = 16, 16


def guarantee(k: int = K, window: int = WINDOW) -> int:
    """Two texts that share so many characters in a row share a selected hash."""
    return k + window - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body's lambdas read it."""
    return F.transform(F.array(value), body)[0]


def _minima(g: Column, window: int) -> Column:
    """The least of each ``window`` (a power of two) consecutive values: of pairs, of pairs of pairs and so on."""

    def halved(d: int) -> Callable[[Column], Column]:
        return lambda a: F.transform(a, lambda x, i: F.least(x, F.get(a, i + d)))  # behind the end: null, left out

    m, d = g, 1
    while d < window:
        m, d = _let(m, halved(d)), 2 * d
    return F.slice(m, 1, F.size(g) - (window - 1))


def winnow(text: Column, start: Column | int = 0, k: int = K, window: int = WINDOW, piece: int = 1 << 18) -> Column:
    """array<long> of selected k-grams, in text order, each packed as 34 bits of hash over 2^30 - 1 - position.

    A k-gram is ``k`` consecutive characters (code points; none is folded or left out) and every position has one hash,
    built from the gram by one native call; a text of fewer characters has one k-gram, all of it. Of each ``window``
    consecutive hashes the least is selected, of equal ones the rightmost: the packing makes that one minimum. So two
    texts that share ``window + k - 1`` characters in a row share a selected hash, with or without spaces, and nothing
    shorter than ``k`` characters is ever matched. ``start`` is added to all positions.

    Null and empty texts have no k-gram. Very long texts are read in pieces of ``piece`` positions whose windows overlap,
    with the same result; what is held for a row is a piece's hashes and the selected ones.
    """
    pattern = F.lit(rf"(?s)(?=(.{{{k}}})).")

    def packed(value: Column, at: Column) -> Column:
        return F.xxhash64(value).bitwiseOR(F.lit(_POS_MASK)) - at

    def of_piece(t: Column, a: Column) -> Column:
        some = F.substring(t, a + 1, F.lit(piece + guarantee(k, window) - 1))
        grams = F.transform(F.regexp_extract_all(some, pattern, F.lit(1)), packed)
        return F.transform(F.array_distinct(_let(grams, lambda g: _minima(g, window))), lambda v: v - (a + start))

    def selected(t: Column) -> Column:
        n = F.char_length(t)
        windows = n - (k + window - 2)
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < k, F.array(packed(t, F.lit(0)) - start))
            .when(windows <= 1, F.array(F.array_min(F.transform(F.regexp_extract_all(t, pattern, F.lit(1)), packed)) - start))
            .when(windows <= piece, of_piece(t, F.lit(0)))
            .otherwise(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), windows - 1, F.lit(piece)), lambda a: of_piece(t, a)))))
        )

    return _let(F.coalesce(text, F.lit("")), selected)


def position(packed: Column) -> Column:
    return F.lit(_POS_MASK) - packed.bitwiseAND(_POS_MASK)


def winnow_edited(fingerprint: Column, edited: Column, same: Column, k: int = K, window: int = WINDOW) -> Column:
    """``winnow(edited)``, given the fingerprint of a text whose first ``same`` characters ``edited`` begins with.

    The last window that lies within those characters starts at ``same - (window + k - 1)``; ``edited`` is winnowed from
    there on. As selected positions never go back from one window to the next, what earlier windows select is what the
    given fingerprint holds up to the position that this window selects.
    """
    last = same - guarantee(k, window)
    rest = winnow(F.substring(edited, last + 1, F.char_length(edited)), last, k, window)
    joined = _let(rest, lambda r: F.array_distinct(F.concat(F.filter(fingerprint, lambda v: position(v) <= position(r[0])), r)))
    return F.when(last >= 0, joined).otherwise(winnow(edited, 0, k, window))


def hashes(packed: Column) -> Column:
    """Distinct hashes of a packed fingerprint."""
    return F.array_distinct(F.transform(packed, lambda p: F.shiftright(p, _POS_BITS)))


def entries(packed: Column) -> Column:
    """array<struct<hash: long, position: int>>: the fingerprint with the position of each selected k-gram."""
    return F.transform(
        packed, lambda p: F.struct(F.shiftright(p, _POS_BITS).alias("hash"), position(p).cast("int").alias("position"))
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike (1.0)."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / union)


def _range_of(value: Column, edges: list[int], low: int = 0, high: int | None = None) -> Column:
    """Number of the last edge at or below ``value`` (0 where it is below all), by binary search in generated code."""
    high = len(edges) if high is None else high
    if high - low <= 1:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value < edges[mid], _range_of(value, edges, low, mid)).otherwise(_range_of(value, edges, mid, high))


def with_next(
    df: DataFrame, id_col: str, text_col: str, derived: dict[str, Column], bucket_bytes: int = 1 << 20, max_buckets: int = 1_000_000
) -> DataFrame:
    """(id, text, derived..., next_text, next_<derived>...): each row beside the next one in ascending id order.

    Rows go to id ranges (quantiles of all ids, subdivided evenly) of some ``bucket_bytes`` of text; each range also gets
    the first row of the next one, and the last range the first row of all, so one exchange of the text is enough and
    no task sees the whole order. The exchange has as many partitions as the text fills at eight ranges each, whatever
    the session says. ``derived`` is computed after that exchange. What is broadcast is one (id, range) per range:
    ``max_buckets`` rows at most.

    Cases: null texts are empty; equal ids are ordered by their text, in one task; null ids come first; other columns,
    whatever their names, are ignored; one row is followed by itself; an empty table gives an empty table.
    """
    ident, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    coarse = 256
    lo, hi, size, splits = df.agg(
        F.min(ident), F.max(ident), F.sum(F.octet_length(text)), F.percentile_approx(ident, [i / coarse for i in range(1, coarse)], 10000)
    ).first()
    edges = sorted({int(x) for x in ([] if lo is None else [lo, *splits])})
    fine = max(1, min(-(-(size or 0) // (coarse * bucket_bytes)), max_buckets // coarse))
    partitions = max(8, min((size or 0) // (8 * bucket_bytes), 100_000))
    if edges:
        which = _range_of(ident, edges)
        starts = F.array(*[F.lit(x).cast("long") for x in edges])
        widths = F.array(*[F.lit(max(1, b - a)).cast("long") for a, b in zip(edges, [*edges[1:], int(hi) + 1], strict=True)])
        step = F.least(F.floor((ident - starts[which]).cast("double") * fine / widths[which]), F.lit(fine - 1))
        bucket = F.when(ident.isNull(), F.lit(-1)).otherwise(which.cast("long") * fine + step)
    else:
        bucket = F.lit(-1).cast("long")
    rows = df.select(ident.alias("id"), text.alias("text"), bucket.cast("long").alias("bucket"))
    firsts = rows.groupBy("bucket").agg(F.min("id").alias("first_id"))
    order = W.orderBy("bucket")
    firsts = firsts.select(
        F.col("bucket").alias("own"),
        "first_id",
        F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("before"),
        F.lag("bucket").over(order).isNull().alias("wraps"),
    )
    mine = F.array(F.struct(F.lit(False).alias("halo"), F.col("bucket").alias("at"), F.lit(False).alias("last")))
    halo = F.array(F.struct(F.lit(True).alias("halo"), F.col("before").alias("at"), F.col("wraps").alias("last")))
    placed = (
        rows.join(F.broadcast(firsts), (F.col("bucket") == F.col("own")) & F.col("id").eqNullSafe(F.col("first_id")), "left")
        .select("id", "text", F.inline(F.when(F.col("own").isNull(), mine).otherwise(F.concat(mine, halo))))
        .repartition(partitions, "at")
    )
    # a copied row counts as the next one only; where a range wraps to itself, it comes after all others
    full = placed.select("*", *[v.alias(k) for k, v in derived.items()])
    w = W.partitionBy("at").orderBy("last", "id", "text", "halo")
    lead = [F.lead(c).over(w).alias(f"next_{c}") for c in ("text", *derived)]
    return full.select("id", "text", "halo", *derived, *lead).where("not halo").drop("halo")
