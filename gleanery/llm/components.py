"""Distributed union-find: connected components of an edge table, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node that edges reach) of every node of ``edges``; of any order and repetition.

    Each round hooks every root to the smallest root next to it and then halves the paths; edges inside a tree are
    dropped. A star of any size is one round, and a path of n nodes takes about log n. Aggregations combine on the
    map side, so a node with very many edges costs a task no more than its own share of them. Null ends are ignored.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    trees = checkpointed(nodes.select("node", F.col("node").alias("root")))
    left = left.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = checkpointed(left)
    while not left.isEmpty():
        hook = checkpointed(left.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("from"), "to"))
        while True:  # roots that hook to roots that hook: halve until every path has one step
            ahead = hook.select(F.col("from").alias("f2"), F.col("to").alias("t2"))
            nxt = hook.select("from", "to").join(ahead, F.col("to") == F.col("f2"), "left")
            nxt = checkpointed(nxt.select("from", F.coalesce("t2", "to").alias("to"), F.col("t2").isNotNull().alias("moved")))
            released(hook)
            hook = nxt
            if nxt.where("moved").isEmpty():
                break
        step = hook.select("from", "to")
        grown = checkpointed(trees.join(step, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root")))
        end = lambda name: step.select(F.col("from").alias(f"{name}_from"), F.col("to").alias(f"{name}_to"))  # noqa: B023, E731
        rest = left.join(end("a"), F.col("a") == F.col("a_from"), "left").join(end("b"), F.col("b") == F.col("b_from"), "left")
        rest = rest.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b")
        rest = checkpointed(rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        released(hook, trees, left)
        trees, left = grown, rest
    released(left)
    return trees
