"""Connected components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolytics.llm.common import discard, saved


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of an edge, ``component`` being its smallest node.

    Every node holds a parent, at first itself.  In a round the smallest
    grandparent among the neighbours is offered to the node and to its parent,
    and each node moves to its own grandparent; it ends when no parent changes,
    after about as many rounds as the logarithm of the longest path.  Each round
    is joins and minima that Spark combines before the shuffle, and is written to
    the shared folder.  Loops and repeated edges change nothing; null ends are
    dropped; no edges give no rows.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = saved(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    nodes = saved(both.select(F.col("a").alias("node")).distinct().withColumn("parent", F.col("node")), "components")
    for _ in range(most_rounds):
        up = nodes.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        held = saved(nodes.join(up, "parent"), "grandparents")
        offers = both.join(held.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("offer"))
        offers = offers.withColumnRenamed("a", "node").join(held.select("node", "parent"), "node")
        moves = (
            held.select("node", F.least("parent", "grand").alias("to"), F.col("parent").alias("old"))
            .unionByName(offers.select("node", F.col("offer").alias("to"), F.lit(None).cast("long").alias("old")))
            .unionByName(offers.select(F.col("parent").alias("node"), F.col("offer").alias("to"), F.lit(None).cast("long").alias("old")))
        )
        moved = saved(moves.groupBy("node").agg(F.min("to").alias("parent"), F.max("old").alias("old")), "components")
        discard(nodes, held)
        nodes = moved.select("node", "parent")
        if not moved.filter(F.col("parent") != F.col("old")).limit(1).count():
            discard(both)
            return nodes.select("node", F.col("parent").alias("component"))
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
