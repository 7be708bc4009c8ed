"""Drop rows whose key is in a table of keys, exchanging only rows that may be dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.sieve import BitSieve, sieve_bits


def without_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``df`` without rows whose ``column`` equals one of ``keys``' (null keys drop nothing).

    A sieve of bounded size tells which rows may have such a key; the others, usually most, pass without an exchange.
    ``keys`` and ``df`` are read more than once, so they should be stored.
    """
    sieve = BitSieve(keys.select(column), [column], sieve_bits(keys.count()))
    flag = "_may"
    while flag in df.columns:
        flag += "_"
    marked = sieve.may_hold(df, [F.col(f"`{column}`")], flag)
    surely = marked.where(~F.col(flag)).drop(flag)
    maybe = marked.where(F.col(flag)).drop(flag).join(keys.select(column).distinct(), column, "left_anti")
    names = [F.col(f"`{c}`") for c in df.columns]
    return surely.select(names).unionAll(maybe.select(names))
