"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.hot_keys import join_hot
from strandlake.storage import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable. Nodes are the edges' ends; any orderable type.

    Alternates large-star and small-star steps until the edge table is a set of stars. Each step keeps only a
    least neighbour per node (a map-side combined minimum) and one join on the node; edges of a hub (more than one in
    4096 of all, so there are few) stay where they are and meet a broadcast of the hubs' minima. Both steps of every
    round are written to the shared folder, which cuts the lineage. Null ends, self-loops and repeated edges are
    allowed; an edge with a null end joins nothing.
    """
    x, y = F.col(a), F.col(b)
    ends = edges.where(x.isNotNull() & y.isNotNull())
    lone = ends.where(x == y).select(x.alias("node")).distinct()
    e = cut(ends.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "cc")
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        count = F.count(F.lit(1)).alias("_n")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), count)
        met = join_hot(both, least, ["u"], "_n", 2 * e.count())
        large = cut(met.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "cc")
        # each hi keeps its least neighbour m; its other, larger low neighbours are hung on m instead
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"), count)
        joined = join_hot(large, small_least, ["hi"], "_n", large.count())
        moved = joined.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        nxt = cut(moved.unionAll(small_least.select("hi", F.col("m").alias("lo"))).distinct(), "cc")
        # a set of stars: nobody is both a leaf and a centre, and each leaf has one centre
        chained = nxt.join(nxt.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").limit(1).count()
        many = nxt.groupBy("hi").count().where("count > 1").limit(1).count() if not chained else 1
        e = nxt
        if not chained and not many:
            break
    else:
        raise RuntimeError(f"components did not converge within {max_rounds} rounds")
    stars = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    centres = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    found = stars.unionAll(centres)
    return found.unionAll(
        lone.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    )


def first_come(nodes: DataFrame, edges: DataFrame, barred: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, kept): nodes taken in ascending order, each kept unless barred or joined to a kept one before it.

    ``nodes`` and ``barred`` have (node), ``edges`` (node, before) with before < node; nodes with nulls, repeated rows and
    edges to nodes that aren't there count for nothing. In a round every open node without an open node before it is
    kept, and those joined to it go; the least open node is always decided, so the rounds end. There are as many as the
    longest chain of alternating decisions, a few where the order is not made to prevent it. Nothing is ordered or
    collected; open nodes and edges shrink from round to round and are written to the shared folder.
    """
    every = cut(nodes.where(F.col("node").isNotNull()).select("node").distinct(), "first-come")
    opened = cut(every.join(barred.select("node").distinct(), "node", "left_anti"), "first-come")
    e = edges.where("before < node").select("node", "before").distinct()
    e = cut(e.join(opened, "node", "left_semi").join(opened.select(F.col("node").alias("before")), "before", "left_semi"), "first-come")
    took = every.where("false")
    for i in range(max_rounds):
        leaders = cut(opened.join(e.select("node").distinct(), "node", "left_anti"), "first-come")
        took = took.unionAll(leaders) if (i + 1) % 20 else cut(took.unionAll(leaders), "first-come")
        fallen = cut(e.join(leaders.select(F.col("node").alias("before")), "before", "left_semi").select("node").distinct(), "first-come")
        opened = cut(opened.join(leaders.unionAll(fallen), "node", "left_anti"), "first-come")
        if opened.isEmpty():
            break
        e = cut(e.join(fallen, "node", "left_anti").join(fallen.select(F.col("node").alias("before")), "before", "left_anti"), "first-come")
    else:
        raise RuntimeError(f"nodes were not decided within {max_rounds} rounds")
    return every.join(took.withColumn("_in", F.lit(True)), "node", "left").select("node", F.coalesce("_in", F.lit(False)).alias("kept"))
