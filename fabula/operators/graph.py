"""Interaction graphs and story segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interaction_edges(acts: DataFrame, by: list[str], source: str, target: str, verb: str) -> DataFrame:
    """Edges with their number of acts and distinct verbs (GRF1, GRF4)."""
    return acts.groupBy(*by, F.coalesce(F.col(source), F.lit("-1")).alias("src"), F.coalesce(F.col(target), F.lit("-1")).alias("dst")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(verb).alias("verbs")
    )


def adjacency(edges: DataFrame, values: list[str]) -> DataFrame:
    """Matrix of edge counts (GRF2, SNK15); columns are given, not collected."""
    return edges.groupBy("src").pivot("dst", values).agg(F.sum("n"))


def phases(steps: DataFrame, story: str, order: str, trigger) -> DataFrame:
    """Phase of each step (WIN16): ``trigger`` maps a step to the phase it
    opens (0: none); a phase never goes back."""
    w = Window.partitionBy(story).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("phase", F.max(trigger).over(w))
