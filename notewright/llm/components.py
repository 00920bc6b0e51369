"""Connected components of an edge table by repeated contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.lineage import cut, cut_and_count


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): each node that has an edge, with the smallest node it reaches.

    Each round hooks every node on its smallest neighbour, shortens the pointers to roots by doubling, and joins
    the roots' edges in the next, smaller round. The labels follow every round's pointers at the end, in one job.
    All state stays in tables; the driver is told numbers of rows only, by the jobs that write them.
    """
    rounds = []
    edges, many = cut_and_count(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while many:
        both = edges.union(edges.select("b", "a"))
        up = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        moved = True
        while moved:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            longer, moved = cut_and_count(up.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), F.col("moved"))
            up = longer.select("node", "up")
        a, b = (up.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab")
        edges, many = cut_and_count(edges.join(a, "a").join(b, "b").where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
        rounds.append(up)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels, *later = rounds
    labels = labels.withColumnRenamed("up", "component")
    for up in later:
        step = up.select(F.col("node").alias("component"), "up")
        labels = labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return cut(labels) if later else labels
