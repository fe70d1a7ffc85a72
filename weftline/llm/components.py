"""Connected components by alternating large-star and small-star steps over joins and aggregates.

No node's neighbours are ever collected: a step needs only the least neighbour of each node, which is aggregated
before the shuffle, and a join, which can be split where one node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stage, unstage


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    r = edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(h, 20)), F.count_if(F.col("a") == F.col("b"))).first()
    return r[0], r[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges has a > b. Large: each node's larger neighbours move to its least neighbour; small: its smaller ones.
    The least neighbours are staged, so that the join has two plain exchanges and a node with very many edges splits."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")))
        moved = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = stage(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        moved = edges.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    after = stage(moved.where("a <> b").distinct())
    unstage(least)
    return after


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(pairs)
    state = _state(now)
    while state[0]:
        between = _star(now, True)
        after = _star(between, False)
        new = _state(after)
        unstage(now, between)
        now, same = after, new == state
        state = new
        if same:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
