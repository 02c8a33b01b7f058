"""Connected components of a table of links, by alternating stars.

Each round joins every node's neighbours to the smallest of them, first the larger ones (large star), then the smaller
ones (small star), until every node has one neighbour or is the smallest of its component. Links stay a table, every round is
written to the shared folder in place of the one before, and a node with very many neighbours is met by a map-side minimum and a
join that can be split.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.llm.common import discard, landed


def _star(links: DataFrame, large: bool) -> DataFrame:
    if large:
        sides = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    else:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("least"))
    met = sides.join(least, "a")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()
    return met.select("b", "least").union(met.select("a", "least")).toDF("a", "b").where("a != b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether no node has two smaller ones or lies between a smaller and a larger one: another round would change nothing."""
    sides = links.select(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).union(
        links.select("b", F.lit(0), F.lit(1)))
    return sides.groupBy("node").agg(F.sum("smaller").alias("n"), F.max("larger").alias("larger")).where("n + larger > 1 and n > 0").isEmpty()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """`links` (a, b) -> (node, component): the smallest node that each can reach; nodes without links are not listed. The landed
    table that the result reads is its `landed_path`."""
    now = landed(links.select("a", "b").where("a != b").distinct())
    for _ in range(most):
        before, now = now, landed(_star(_star(now, True), False))
        discard(before)
        if _settled(now):
            smallest = now.select(F.col("b").alias("node")).distinct()
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                smallest.select("node", F.col("node").alias("component")))
            out.landed_path = now.landed_path
            return out
    raise RuntimeError("components did not settle")
