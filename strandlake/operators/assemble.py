"""Fragment assembly: families whose instances follow each other at a steady distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reach(families: DataFrame) -> DataFrame:
    """One row: 4 times the whole mean consensus length, within 500..30000."""
    mean = F.floor(F.avg("consensus_length"))
    return families.agg(F.greatest(F.lit(500), F.least(F.lit(30_000), 4 * mean)).cast("int").alias("reach"))


def thinned(instances: DataFrame, most: int = 10_000) -> DataFrame:
    """Every n-th instance of families with more than ``most``, n the whole quotient. Instances are numbered within
    stretches of a million bases and offset by the stretches' counts, so no family is ordered in one task."""
    cells = instances.withColumn("_cell", F.floor(F.col("start") / (1 << 20)))
    sizes = cells.groupBy("family_id", "seq_index", "_cell").agg(F.count(F.lit(1)).alias("_c"))
    whole = W.partitionBy("family_id")
    before = F.sum("_c").over(whole.orderBy("seq_index", "_cell").rowsBetween(W.unboundedPreceding, -1))
    step = F.greatest(F.lit(1), F.floor(F.sum("_c").over(whole) / most))
    placed = sizes.select("family_id", "seq_index", "_cell", F.coalesce(before, F.lit(0)).alias("_before"), step.alias("_step"))
    within = F.row_number().over(W.partitionBy("family_id", "seq_index", "_cell").orderBy("start", "instance_idx")) - 1
    numbered = cells.withColumn("_w", within).join(placed, ["family_id", "seq_index", "_cell"]).withColumn("_i", F.col("_before") + F.col("_w"))
    kept = numbered.where((F.col("_i") % F.col("_step") == 0) & (F.col("_i") / F.col("_step") < most))
    return kept.select(*instances.columns)


def neighbours(instances: DataFrame, distance: int) -> DataFrame:
    """Ordered pairs of instances of different families on one record, the second starting 0..``distance`` later.

    Starts are binned by ``distance``; an instance meets its own and the next bin only, so the range self-join is two
    equi-joins' worth of work however long a record is.
    """
    own = instances.select("family_id", "instance_idx", "seq_index", "start", "end", "strand").withColumn("bin", F.floor(F.col("start") / distance))
    a = own.select(*[F.col(c).alias(f"a_{c}") for c in own.columns], F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("_bin"))
    b = own.select(*[F.col(c).alias(f"b_{c}") for c in own.columns])
    later = (F.col("b_start") > F.col("a_start")) | ((F.col("b_start") == F.col("a_start")) & (F.col("b_instance_idx") > F.col("a_instance_idx")))
    near = F.col("b_start") - F.col("a_start") <= distance
    return a.join(
        b,
        (F.col("_bin") == F.col("b_bin")) & (F.col("a_seq_index") == F.col("b_seq_index"))
        & (F.col("a_family_id") != F.col("b_family_id")) & later & near,
    ).drop("_bin", "a_bin", "b_bin")


def comparisons(instances: DataFrame, distance: int) -> DataFrame:
    """(seq_index, instances, comparisons): how many pairs of instances of a record, one family or two, start at most
    ``distance`` apart: what a sweep would compare, known without a join.

    Each start asks how many starts lie up to ``distance`` behind it: the running count of starts at that place, less the
    asker's own rank (ranks add up to n (n + 1) / 2 however ties fall). Equal places are counted first, so a stretch of a
    million bases holds two rows a base at most, whatever piles up there.
    """
    point = lambda at, asks: F.struct(at.cast("long").alias("at"), F.lit(asks).alias("asks"))
    both = F.explode(F.array(point(F.col("start"), 0), point(F.col("start") + distance, 1))).alias("_p")
    points = instances.where("start is not null").select("seq_index", both).groupBy("seq_index", F.col("_p.at").alias("at"), F.col("_p.asks").alias("asks")).agg(F.count(F.lit(1)).alias("n"))
    points = points.withColumn("cell", F.floor(F.col("at") / (1 << 20)))
    starts = F.sum(F.when(F.col("asks") == 0, F.col("n")).otherwise(0))
    cells = points.groupBy("seq_index", "cell").agg(starts.alias("_c"))
    before = F.sum("_c").over(W.partitionBy("seq_index").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("seq_index", "cell", F.coalesce(before, F.lit(0)).alias("_before"))
    within = starts.over(W.partitionBy("seq_index", "cell").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0))
    placed = points.withColumn("_within", within).join(cells, ["seq_index", "cell"]).where("asks = 1")
    sums = placed.groupBy("seq_index").agg(F.sum("n").alias("instances"), F.sum(F.col("n") * (F.col("_before") + F.col("_within"))).alias("_seen"))
    return sums.select("seq_index", "instances", F.expr("_seen - instances * (instances + 1) div 2").alias("comparisons"))


def cooccurrences(instances: DataFrame, distance: int) -> DataFrame:
    """(a, b, total, same_direction, a_in_b, b_in_a) for family pairs a < b with neighbouring instances."""
    p = neighbours(instances, distance)
    swap = F.col("a_family_id") > F.col("b_family_id")
    lo_s, lo_e = F.when(swap, F.col("b_start")).otherwise(F.col("a_start")), F.when(swap, F.col("b_end")).otherwise(F.col("a_end"))
    hi_s, hi_e = F.when(swap, F.col("a_start")).otherwise(F.col("b_start")), F.when(swap, F.col("a_end")).otherwise(F.col("b_end"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return p.groupBy(F.least("a_family_id", "b_family_id").alias("a"), F.greatest("a_family_id", "b_family_id").alias("b")).agg(
        F.count(F.lit(1)).alias("total"),
        one(F.col("a_strand") == F.col("b_strand")).alias("same_direction"),
        one((lo_s >= hi_s) & (lo_e <= hi_e)).alias("a_in_b"),
        one((hi_s >= lo_s) & (hi_e <= lo_e)).alias("b_in_a"),
    )


def joinable(pairs: DataFrame, families: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs seen 3 times and in a fifth of the smaller family, mostly in one direction, neither inside the other and
    of lengths within a factor of ten."""
    f = families.select("family_id", "consensus_length").join(counts, "family_id")
    a = f.select(F.col("family_id").alias("a"), F.col("consensus_length").alias("la"), F.col("n").alias("na"))
    b = f.select(F.col("family_id").alias("b"), F.col("consensus_length").alias("lb"), F.col("n").alias("nb"))
    t = F.col("total")
    return pairs.join(a, "a").join(b, "b").where(
        (t >= 3) & (t >= 0.20 * F.least("na", "nb")) & (F.col("a_in_b") < 0.5 * t) & (F.col("b_in_a") < 0.5 * t)
        & (F.least("la", "lb") >= 0.10 * F.greatest("la", "lb")) & (F.col("same_direction") >= 0.80 * t)
    ).select("a", "b", "total", "same_direction", "a_in_b", "b_in_a")


def upper_median(counts: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, n, median): the upper of the middle values of ``counts`` (keys, value, its number of times)."""
    order = W.partitionBy(*keys).orderBy(value)
    up_to = F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, 0))
    n = F.sum(weight).over(W.partitionBy(*keys))
    reached = counts.select(*keys, value, n.alias("n"), up_to.alias("_up")).where(F.col("_up") > F.floor(F.col("n") / 2))
    return reached.groupBy(*keys, "n").agg(F.min(value).alias("median"))


def steps(instances: DataFrame, distance: int) -> DataFrame:
    """(a, b, gap, sign) of neighbours in one direction: the distance from the earlier end to the later start, and 1 if
    family a comes first as read in that direction, else -1."""
    p = neighbours(instances, distance).where("a_strand = b_strand")
    sign = F.when(F.col("a_strand") > 0, 1).otherwise(-1) * F.when(F.col("a_family_id") < F.col("b_family_id"), 1).otherwise(-1)
    return p.select(
        F.least("a_family_id", "b_family_id").alias("a"), F.greatest("a_family_id", "b_family_id").alias("b"), (F.col("b_start") - F.col("a_end")).alias("gap"), sign.alias("sign")
    )


def gap_statistics(instances: DataFrame, distance: int) -> DataFrame:
    """`steadiness` of the steps between all instances."""
    return steadiness(steps(instances, distance).withColumn("times", F.lit(1)), distance)


def steadiness(steps: DataFrame, distance: int) -> DataFrame:
    """(a, b, gaps, median_gap, mad, steady) of (a, b, gap, times): distances from the earlier end to the later start of
    neighbours in one direction, within -500..``distance``; at least 3; steady if the deviation is at most 100 and the
    median lies within -20..500 and no further than two deviations allow. Medians come from the numbers of each distance,
    ``distance`` + 501 rows a pair at most, however often a pair meets."""
    counts = steps.where((F.col("gap") >= -500) & (F.col("gap") <= distance)).groupBy("a", "b", "gap").agg(F.sum("times").alias("_c"))
    med = upper_median(counts, ["a", "b"], "gap", "_c").where("n >= 3").withColumnRenamed("median", "median_gap")
    off = counts.join(med, ["a", "b"]).groupBy("a", "b", F.abs(F.col("gap") - F.col("median_gap")).alias("off")).agg(F.sum("_c").alias("_c"))
    mad = upper_median(off, ["a", "b"], "off", "_c").select("a", "b", F.col("median").alias("mad"))
    both = med.join(mad, ["a", "b"])
    steady = (F.col("mad") <= 100) & (F.col("median_gap") >= -20) & (F.col("median_gap") <= F.least(F.col("median_gap") + 2 * F.col("mad"), F.lit(500)))
    return both.select("a", "b", F.col("n").cast("int").alias("gaps"), "median_gap", "mad", steady.alias("steady"))


def joined_consensus(first, second, gap):
    """Two consensi as one: the overlap trimmed off the second, or N for a positive gap."""
    f, s, g = F.col(first), F.col(second), F.col(gap).cast("int")
    return F.when(g >= 0, F.concat(f, F.repeat(F.lit("N"), g), s)).otherwise(F.concat(f, F.substring(s, 1 - g, F.length(s))))
