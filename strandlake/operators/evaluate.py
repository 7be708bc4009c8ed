"""Precision and recall of predicted intervals against a truth, per class and per base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.intervals import intersection_length, interval_union, overlap_join, overlap_length


def strands_agree(a: str = "a_strand", b: str = "b_strand") -> Column:
    """An unstranded interval ('.') meets either strand."""
    return (F.col(a) == F.col(b)) | (F.col(a) == ".") | (F.col(b) == ".")


def overlap_fraction(by: str = "min") -> Column:
    """Shared bases over the length of the prediction (a), the truth (b) or the shorter one."""
    a, b = F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")
    return overlap_length() / {"pred": a, "truth": b, "min": F.least(a, b)}[by]


def _matches(pred: DataFrame, truth: DataFrame, least: float, by: str, width: int) -> DataFrame:
    return overlap_join(pred, truth, ["chrom"], width).where(strands_agree() & (overlap_fraction(by) >= least))


def _ratios(df: DataFrame) -> DataFrame:
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    f = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f.otherwise(F.lit(0.0)))


def interval_metrics(pred: DataFrame, truth: DataFrame, least: float = 0.5, by: str = "min", width: int = 1000) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1); ``pred`` and ``truth`` have (id, chrom, start, end, name, strand).
    A prediction that matches is a true positive, a truth interval that nothing matches is a miss."""
    if not 0 < least <= 1:
        raise ValueError("the least overlap is above 0 and at most 1")
    m = _matches(pred, truth, least, by, width)
    hit, found = m.select(F.col("a_id").alias("id")).distinct(), m.select(F.col("b_id").alias("id")).distinct()
    p = pred.join(hit.withColumn("_h", F.lit(1)), "id", "left").agg(F.count("_h").alias("tp"), (F.count(F.lit(1)) - F.count("_h")).alias("fp"))
    t = truth.join(found, "id", "left_anti").agg(F.count(F.lit(1)).alias("fn"))
    return _ratios(p.crossJoin(F.broadcast(t)))  # one row each


def class_metrics(pred: DataFrame, truth: DataFrame, least: float = 0.5, by: str = "min", width: int = 1000) -> DataFrame:
    """Per truth name (tp, fp, fn, ...): a matching prediction counts for the name of its best match; predictions
    without one are false positives of ``__unmatched_pred__``."""
    m = _matches(pred, truth, least, by, width)
    best = m.groupBy("a_id").agg(F.min(F.struct((-overlap_length()).alias("o"), "b_name")).alias("s")).select(F.col("a_id").alias("id"), F.col("s.b_name").alias("name"))
    tp = best.groupBy("name").agg(F.count(F.lit(1)).alias("tp"))
    fn = truth.join(m.select(F.col("b_id").alias("id")).distinct(), "id", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("fn"))
    fp = pred.join(best, "id", "left_anti").agg(F.count(F.lit(1)).alias("fp")).where("fp > 0").select(F.lit("__unmatched_pred__").alias("name"), "fp")
    zero = F.lit(0).cast("long")
    rows = tp.select("name", "tp", zero.alias("fp"), zero.alias("fn")).unionAll(fn.select("name", zero, zero, "fn")).unionAll(fp.select("name", zero, "fp", zero))
    return _ratios(rows.groupBy("name").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def base_metrics(pred: DataFrame, truth: DataFrame, keys: list[str], width: int = 1000, merge_truth: bool = True) -> DataFrame:
    """One row (pred_bases, truth_bases, shared_bases, precision, recall, f1) over merged intervals per ``keys``.
    ``merge_truth=False`` sums the truth as it is, so overlapping truth intervals count twice."""
    p = interval_union(pred, keys)
    t = interval_union(truth, keys) if merge_truth else truth.select(*keys, "start", "end")
    span = F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))
    shared = intersection_length(p, t, keys, width).agg(F.coalesce(F.sum("bases"), F.lit(0)).alias("tp"))
    one = p.agg(span.alias("pred_bases")).crossJoin(F.broadcast(t.agg(span.alias("truth_bases")))).crossJoin(F.broadcast(shared))  # one row each
    full = one.withColumn("fp", F.col("pred_bases") - F.col("tp")).withColumn("fn", F.col("truth_bases") - F.col("tp"))
    return _ratios(full).select("pred_bases", "truth_bases", F.col("tp").alias("shared_bases"), "precision", "recall", "f1")
