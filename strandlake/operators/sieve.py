"""A fixed-size bit sieve: tells, without a shuffle of wide rows, which rows may have their key in a key table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAGE = 32768  # bits in one value of bitmap_construct_agg


def sieve_bits(keys: int, least: int = 15, most: int = 27) -> int:
    """Size (as a power of two) of a sieve with some eight bits a key, 16 MB at most: past 100 million keys more and more
    rows without a key pass it, which costs what they cause behind it but changes no result."""
    return min(most, max(least, (8 * max(keys, 1) - 1).bit_length()))


class BitSieve:
    """Bits of the hashed keys of ``keys``; ``may_hold`` marks rows of another table, with false positives only.

    The sieve is ``2**bits`` bits (1 MB at the default 23) in at most ``2**bits / 32768`` rows, whatever the number
    of keys: that bound is what makes its broadcast safe. A full sieve only lets more rows through, so an exact
    join must follow. Null keys hash like values.
    """

    def __init__(self, keys: DataFrame, columns: list[str], bits: int = 23):
        if not 15 <= bits <= 27:
            raise ValueError("bits must be 15..27 (16 MB at most)")
        self.bits = bits
        at = self._position([F.col(c) for c in columns])
        self.pages = (
            keys.select(at.alias("at"))
            .groupBy((F.col("at") / _PAGE).cast("int").alias("_page"))
            .agg(F.bitmap_construct_agg(F.col("at") % _PAGE).alias("_bitmap"))
        )

    def _position(self, columns: list[Column]) -> Column:
        return F.xxhash64(*columns).bitwiseAND((1 << self.bits) - 1)

    def may_hold(self, df: DataFrame, columns: list[Column], flag: str) -> DataFrame:
        """``df`` with a boolean column ``flag``; needs one broadcast join and no exchange of ``df``."""
        free = "_sieve"
        while any(c.startswith(free) for c in df.columns):  # names that ``df`` has stay as they are
            free += "_"
        at, page, bitmap = (free + x for x in ("at", "page", "bitmap"))
        with_page = df.withColumn(at, self._position(columns)).withColumn(page, (F.col(at) / _PAGE).cast("int"))
        joined = with_page.join(F.broadcast(self.pages.toDF(page, bitmap)), page, "left")
        bit = F.col(at) % _PAGE
        byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(byte, F.lit(0))
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))
        return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != flag], (hit.bitwiseAND(mask) != 0).alias(flag))
