"""Connected components of an undirected link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` with the smallest node it can reach.

    Returns ``(node, component)``. Each round takes the least label among a
    node and its neighbours and then follows the label once (pointer jumping),
    so a chain of length n needs about log2(n) rounds. Rounds are cut by
    checkpoints. Null end points and self links add nothing; an empty link
    table gives an empty result. Raises if ``max_rounds`` do not suffice.
    """
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    for _ in range(max_rounds):
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("near_node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, F.col("node") == F.col("near_node")).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("root_component"))
        nxt = cut(
            step.join(roots, F.col("component") == F.col("root")).select(
                "node", F.least("component", "root_component").alias("component"), "old"
            )
        )
        changed = nxt.where("component <> old").limit(1).count()
        labels = nxt.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
