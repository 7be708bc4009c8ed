"""Column expressions of the two-part description length."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The universal code's constant, bits of a substituted base, flag bits and names in order.
UNIVERSAL = 1.5179605508986484
BITS_PER_SUBSTITUTION = math.log2(3.0)
FLAGS = (
    "short_consensus",
    "low_copy",
    "high_divergence",
    "standalone_fallback",
    "no_exclusive_bases",
    "low_exclusive_fraction",
    "nonpositive_exclusive_mdl",
    "pruned_redundant",
    "rescue_discovery",
)
BIT = {name: 1 << i for i, name in enumerate(FLAGS)}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def universal_int(n) -> Column:
    """Bits of the universal code of a positive integer: constant plus every positive iterated log2; else infinity."""
    start = F.struct(F.log2(_c(n).cast("double")).alias("x"), F.lit(0.0).alias("t"))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(6)),
        start,
        lambda acc, _: F.struct(
            F.when(acc["x"] > 0, F.log2(acc["x"])).otherwise(F.lit(0.0)).alias("x"),
            (acc["t"] + F.greatest(acc["x"], F.lit(0.0))).alias("t"),
        ),
        lambda acc: acc["t"] + UNIVERSAL,
    )
    return F.when(_c(n) >= 1, total).otherwise(F.lit(float("inf")))


def log2_choose(n, k) -> Column:
    """log2 of the binomial coefficient, summed over the smaller side."""
    side = F.least(_c(k), _c(n) - _c(k)).cast("int")
    terms = F.sequence(F.lit(1), side)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, i: acc + F.log2((_c(n) - side + i) / i))
    return F.when(side <= 0, F.lit(0.0)).otherwise(total)


def steady(mean) -> Column:
    """A mean to 12 places: whether it lies at half a unit of a place that it is rounded to next doesn't then hang on the
    order in which Spark summed it."""
    return F.round(_c(mean), 12)


def literal_cost(length) -> Column:
    return 2.0 * _c(length)


def instance_cost(length, edits, mode: str = "exact") -> Column:
    """Bits to encode one instance given its family: length, number of edits, edits, and by ``mode`` their places.

    Edits are limited to 0..length first; then a length below 1 counts as 1.
    """
    m = F.greatest(F.lit(0), F.least(_c(edits), _c(length))).cast("long")
    a = F.greatest(F.lit(1), _c(length)).cast("long")
    base = universal_int(a) + universal_int(m + 1) + m * BITS_PER_SUBSTITUTION
    if mode == "none":
        return base
    if mode == "upper":
        return base + m * F.log2(a.cast("double"))
    if mode == "exact":
        return base + log2_choose(a, m)
    raise ValueError(f"mode is none, exact or upper, not {mode!r}")


_LOG_FACTORIALS = np.zeros(1)


def _log_factorials(n: np.ndarray) -> np.ndarray:
    """Natural logarithms of the factorials; up to a million from a table."""
    global _LOG_FACTORIALS
    most = int(n.max(initial=0))
    if most >= 1 << 20:
        return np.fromiter(map(math.lgamma, (n + 1).tolist()), float, len(n))
    if most >= len(_LOG_FACTORIALS):
        _LOG_FACTORIALS = np.array([math.lgamma(i + 1) for i in range(1 << most.bit_length())])
    return _LOG_FACTORIALS[n]


_UNIVERSAL_INTS = np.zeros(0)


def universal_ints(n: np.ndarray) -> np.ndarray:
    """``universal_int`` of an array of positive integers; up to a million from a table."""
    global _UNIVERSAL_INTS
    most = int(n.max(initial=0))
    if most >= 1 << 20:
        return _iterated(n)
    if most >= len(_UNIVERSAL_INTS):
        _UNIVERSAL_INTS = _iterated(np.maximum(1, np.arange(1 << most.bit_length())))
    return _UNIVERSAL_INTS[n]


def _iterated(n: np.ndarray) -> np.ndarray:
    x, total = np.log2(n), np.full(len(n), UNIVERSAL)
    for _ in range(6):
        total += np.maximum(x, 0.0)
        x = np.log2(x, out=np.zeros(len(n)), where=x > 0)
    return total


def instance_costs(length: np.ndarray, edits: np.ndarray, mode: str = "exact") -> np.ndarray:
    """``instance_cost`` of arrays of integers, for kernels."""
    m, a = np.maximum(0, np.minimum(edits, length)), np.maximum(1, length)
    base = universal_ints(a) + universal_ints(m + 1) + m * BITS_PER_SUBSTITUTION
    if mode == "none":
        return base
    if mode == "upper":
        return base + m * np.log2(a)
    if mode == "exact":
        return base + (_log_factorials(a) - _log_factorials(m) - _log_factorials(a - m)) / math.log(2.0)
    raise ValueError(f"mode is none, exact or upper, not {mode!r}")


def model_cost(length) -> Column:
    """Bits of a consensus: its length and two bits a base; infinity without a base."""
    return F.when(_c(length) > 0, universal_int(length) + literal_cost(length)).otherwise(F.lit(float("inf")))


def known_edits(edits, divergence, length) -> Column:
    """Edits, or round(divergence * length) where they are negative (unknown)."""
    return F.when(_c(edits) >= 0, _c(edits)).otherwise(F.floor(_c(divergence) * _c(length) + 0.5).cast("int"))


def base_flags(length, instances, mean_divergence) -> Column:
    """Bits for a consensus under 80, under 3 instances, and a mean divergence of 0.25 or more."""

    def bit(name: str, test: Column) -> Column:
        return F.when(test, F.lit(BIT[name])).otherwise(F.lit(0))

    return (
        bit("short_consensus", _c(length) < 80)
        .bitwiseOR(bit("low_copy", _c(instances) < 3))
        .bitwiseOR(bit("high_divergence", _c(mean_divergence) >= 0.25))
    )


def flag_names(flags) -> Column:
    """Names of the set bits joined by |, or none."""
    names = F.concat_ws("|", *[F.when(_c(flags).bitwiseAND(bit) != 0, F.lit(name)) for name, bit in BIT.items()])
    return F.when(names == "", F.lit("none")).otherwise(names)


def quality_tier(state, flags) -> Column:
    """core, supported, warn or reject from the acceptance state and flags."""
    structural = _c(flags).bitwiseAND(BIT["short_consensus"] | BIT["low_copy"] | BIT["high_divergence"]) != 0
    evidence = _c(flags).bitwiseAND(BIT["no_exclusive_bases"] | BIT["nonpositive_exclusive_mdl"]) != 0
    return (
        F.when(_c(state) == "exclusive", F.when(structural, F.lit("warn")).otherwise(F.lit("core")))
        .when(_c(state) == "standalone", F.when(structural | evidence, F.lit("warn")).otherwise(F.lit("supported")))
        .otherwise(F.lit("reject"))
    )
