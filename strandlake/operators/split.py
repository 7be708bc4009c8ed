"""Bimodality of instance divergence and the decision to split a family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def otsu(values: DataFrame, key: str = "family_id", value: str = "divergence", bins: int = 100) -> DataFrame:
    """(key, n, threshold, bimodality, valley_pass): best two-class cut of each key's histogram.

    Bimodality is the largest between-class share of the variance, 0 where the range is under 0.01 or the variance
    under 1e-10. The threshold is the upper edge of the best bin, the first of equals. Where bimodality is 0.20 to
    0.40 the bin at the cut must be lower than half the lower of the two modes, else valley_pass is false.
    Only (key, bin) counts are shuffled to the window, never the values.
    """
    v = values.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    stats = v.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width))).otherwise(F.lit(0))
    hist = v.join(stats, "k").groupBy("k", "lo", "hi", "n", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * width
    run = W.partitionBy("k").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    full = W.partitionBy("k")
    cum = hist.withColumn("m", mid).select(
        "*", F.sum("c").over(run).alias("n0"), F.sum(F.col("c") * F.col("m")).over(run).alias("s0"),
        F.sum(F.col("c") * F.col("m")).over(full).alias("s"), F.sum(F.col("c") * F.col("m") * F.col("m")).over(full).alias("q"),
        F.max("c").over(run).alias("mode_lo"), F.max("c").over(W.partitionBy("k").orderBy("bin").rowsBetween(1, W.unboundedFollowing)).alias("mode_hi"),
    )
    n, n0 = F.col("n"), F.col("n0")
    total = F.col("q") / n - (F.col("s") / n) * (F.col("s") / n)
    apart = F.col("s0") / n0 - (F.col("s") - F.col("s0")) / (n - n0)
    between = F.when(n0 < n, (n0 / n) * ((n - n0) / n) * apart * apart).otherwise(F.lit(0.0))
    ok = (F.col("hi") - F.col("lo") >= 0.01) & (total >= 1e-10)
    scored = cum.select("k", "n", "bin", "c", "lo", width.alias("w"), "mode_lo", "mode_hi", F.when(ok, F.round(between / total, 9)).otherwise(F.lit(0.0)).alias("b"))
    best = scored.groupBy("k", "n").agg(F.min(F.struct((-F.col("b")).alias("nb"), "bin", "c", "lo", "w", "mode_lo", "mode_hi")).alias("x"))
    bim = -F.col("x.nb")
    valley = ~((bim >= 0.20) & (bim < 0.40) & (F.col("x.c") >= F.floor(F.least("x.mode_lo", F.coalesce("x.mode_hi", F.lit(0))) / 2)))
    return best.select(
        F.col("k").alias(key), "n", (F.col("x.lo") + (F.col("x.bin") + 1) * F.col("x.w")).alias("threshold"), F.abs(bim).alias("bimodality"), valley.alias("valley_pass")
    )


def split_decisions(values: DataFrame, cuts: DataFrame, key: str = "family_id", value: str = "divergence") -> DataFrame:
    """(key, decision, n_lo, n_hi, mean_lo, mean_hi): the first reason not to split, or ``candidate`` for the cost gate."""
    v = values.select(F.col(key), F.col(value).cast("double").alias("v")).join(cuts, key)
    low = F.col("v") <= F.col("threshold")
    sides = v.groupBy(key, "n", "bimodality", "valley_pass").agg(
        F.sum(F.when(low, 1).otherwise(0)).alias("n_lo"), F.sum(F.when(low, 0).otherwise(1)).alias("n_hi"),
        F.avg(F.when(low, F.col("v"))).alias("mean_lo"), F.avg(F.when(~low, F.col("v"))).alias("mean_hi"),
    )
    decision = (
        F.when(F.col("n") < 3, "skip_too_few_instances")
        .when(F.col("bimodality") < 0.20, "reject_bimodality")
        .when(~F.col("valley_pass"), "reject_valley")
        .when((F.col("n_lo") < 3) | (F.col("n_hi") < 3), "reject_cluster_size")
        .when(F.col("mean_hi") - F.col("mean_lo") < 0.03, "reject_div_gap")
        .otherwise("candidate")
    )
    return sides.select(key, decision.alias("decision"), "n_lo", "n_hi", "mean_lo", "mean_hi")


def gate_passes(original, low, high):
    """Cost gate: the halves' scores together reach 0 for a positive original, else original - 2 |original|."""
    o = F.col(original)
    return F.col(low) + F.col(high) >= F.when(o > 0, F.lit(0.0)).otherwise(o - 2 * F.abs(o))
