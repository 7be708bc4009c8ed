"""Similarity of families: k-mer Jaccard, length guards, instance overlap, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import mdl
from strandlake.operators.intervals import overlap_join, overlap_length

#: Instances of one bin that a task compares with the bin's others: many families' copies may lie at one place.
PILE = 2_000


def profiles(seqs: DataFrame, k: int = 8) -> DataFrame:
    """(id, gram): distinct N-free k-mers of the forward strand."""
    grams = F.transform(F.sequence(F.lit(1), F.length("seq") - (k - 1)), lambda i: F.substring("seq", i, F.lit(k)))
    rows = seqs.where(F.length("seq") >= k).select("id", F.explode(F.array_distinct(grams)).alias("gram"))
    return rows.where(~F.col("gram").contains("N"))


def jaccard_pairs(seqs: DataFrame, k: int = 8, least: float = 0.15, ratio: float = 0.0) -> DataFrame:
    """(a, b, shared, jaccard) of pairs a < b that share a k-mer and reach ``least``, by an inverted index. Pairs whose
    profiles differ so much in size that they can't reach it, or whose lengths' ratio is below ``ratio``, are not formed.
    """
    sized = seqs.select("id", F.length("seq").alias("_l"))
    p = profiles(seqs, k)
    sizes = p.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(sized, "id")
    own = p.join(sizes, "id")
    x = own.select("gram", F.col("id").alias("a"), F.col("n").alias("na"), F.col("_l").alias("_la"))
    y = own.select("gram", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("_l").alias("_lb"))
    near = (F.least("na", "nb") >= least * F.greatest("na", "nb")) & (F.least("_la", "_lb") >= ratio * F.greatest("_la", "_lb"))
    both = x.join(y, "gram").where((F.col("a") < F.col("b")) & near).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return both.select("a", "b", "shared", j.alias("jaccard")).where(F.col("jaccard") >= least)


def length_guard(pairs: DataFrame, lengths: DataFrame, shortest: int = 80, ratio: float = 0.7) -> DataFrame:
    """Pairs whose shorter member has ``shortest`` bases and ``ratio`` of the longer one's."""
    la = lengths.select(F.col("id").alias("a"), F.col("length").alias("la"))
    lb = lengths.select(F.col("id").alias("b"), F.col("length").alias("lb"))
    lo, hi = F.least("la", "lb"), F.greatest("la", "lb")
    return pairs.join(la, "a").join(lb, "b").where((lo >= shortest) & (lo >= ratio * hi))


def instance_overlap(instances: DataFrame, width: int, share: float = 0.5, fraction: float = 0.5) -> DataFrame:
    """(a, b, hits, overlaps): for family pairs a < b, a's instances that some instance of b overlaps by ``share`` of
    the shorter one; ``overlaps`` if they reach ``fraction`` of the smaller family."""
    own = instances.select("family_id", "instance_idx", "seq_index", "start", "end")
    pairs = overlap_join(own, own, ["seq_index"], width, pile=PILE).where(F.col("a_family_id") < F.col("b_family_id"))
    shorter = F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))
    good = pairs.where(overlap_length() >= share * shorter)
    hits = good.groupBy(F.col("a_family_id").alias("a"), F.col("b_family_id").alias("b")).agg(F.countDistinct("a_instance_idx").alias("hits"))
    n = instances.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))
    na, nb = n.select(F.col("family_id").alias("a"), F.col("n").alias("na")), n.select(F.col("family_id").alias("b"), F.col("n").alias("nb"))
    return hits.join(na, "a").join(nb, "b").select("a", "b", "hits", (F.col("hits") >= fraction * F.least("na", "nb")).alias("overlaps"))


def representatives(components: DataFrame, counts: DataFrame) -> DataFrame:
    """(component, representative, members): the member with most instances, the least id of equals."""
    joined = components.join(counts, components["node"] == counts["family_id"], "left")
    best = F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("m"), F.col("node").alias("id")))
    return joined.groupBy("component").agg(best.alias("s"), F.count(F.lit(1)).alias("members")).select(
        "component", F.col("s.id").alias("representative"), "members"
    )


def nested_fraction(instances: DataFrame, width: int) -> DataFrame:
    """(inner, outer, contained, fraction): instances of one family that lie wholly inside one of another, by pair."""
    own = instances.select("family_id", "instance_idx", "seq_index", "start", "end")
    pairs = overlap_join(own, own, ["seq_index"], width, pile=PILE).where("a_family_id <> b_family_id and a_start >= b_start and a_end <= b_end")
    hits = pairs.groupBy(F.col("a_family_id").alias("inner"), F.col("b_family_id").alias("outer")).agg(F.countDistinct("a_instance_idx").alias("contained"))
    n = instances.groupBy(F.col("family_id").alias("inner")).agg(F.countDistinct("instance_idx").alias("_n"))
    return hits.join(n, "inner").select("inner", "outer", "contained", (F.col("contained") / F.col("_n")).alias("fraction"))


def merge_gate(pairs: DataFrame, instances: DataFrame, lengths: DataFrame, mode: str = "exact") -> DataFrame:
    """``pairs`` (a, b, identity) that still save bits as one family: every instance of both is encoded again, with
    (1 - identity) / 2 more divergence (0.5 at most), against one model of the longer consensus."""
    both = pairs.select("a", "b", "identity", F.explode(F.array("a", "b")).alias("family_id"))
    rows = both.join(instances.select("family_id", "aligned_length", "num_edits", "divergence"), "family_id")
    rate = F.least(F.lit(0.5), F.col("divergence") + (1 - F.col("identity")) / 2)
    edits = F.greatest(mdl.known_edits("num_edits", "divergence", "aligned_length"), F.floor(rate * F.col("aligned_length") + 0.5).cast("int"))
    saved = 2.0 * F.col("aligned_length") - mdl.instance_cost("aligned_length", edits, mode)
    sums = rows.select("a", "b", "identity", saved.alias("s")).groupBy("a", "b", "identity").agg(F.sum("s").alias("saved"))
    la = lengths.select(F.col("id").alias("a"), F.col("length").alias("la"))
    lb = lengths.select(F.col("id").alias("b"), F.col("length").alias("lb"))
    net = F.col("saved") - mdl.model_cost(F.greatest("la", "lb"))
    return sums.join(la, "a").join(lb, "b").withColumn("net", net).where("net > 0").select("a", "b", "identity", "net")
