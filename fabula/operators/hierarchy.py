"""Transitive closure over child-parent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import cut


def ancestors(edges: DataFrame, max_depth: int = 100) -> DataFrame:
    """(child, ancestor, depth) of all chains in (child, parent) (HIER1, LEX7,
    LEX10). Several parents are allowed; a pair met again at the same depth is
    one row. Raises on a chain longer than ``max_depth``, as a cycle makes."""
    step = edges.select("child", F.col("parent").alias("ancestor")).where("child is not null and ancestor is not null").distinct()
    up = cut(step.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next")))
    level = cut(step.withColumn("depth", F.lit(1)))
    out = level
    for depth in range(2, max_depth + 2):
        level = cut(level.join(up, "ancestor").select("child", F.col("next").alias("ancestor")).distinct().withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError(f"a chain is longer than {max_depth}")
