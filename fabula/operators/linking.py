"""Links between mentions of a document, their merging and closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.operators.components import connected_components


def pairs(mentions: DataFrame, doc: str, mention: str, condition: Column | None = None) -> DataFrame:
    """Pairs i < j of one document (JN4): an equi-join with a residual."""
    left = mentions.select([F.col(c).alias(f"{c}_i") if c != doc else F.col(c) for c in mentions.columns])
    right = mentions.select([F.col(c).alias(f"{c}_j") if c != doc else F.col(c) for c in mentions.columns])
    p = left.join(right, doc).where(F.col(f"{mention}_i") < F.col(f"{mention}_j"))
    return p if condition is None else p.where(condition)


def shared_key_links(mentions: DataFrame, doc: str, mention: str, key: str, weight: float = 1.0) -> DataFrame:
    """Links of mentions that share a key (COR2): each mention links with the
    first of its key, which closes to the same groups as all pairs do."""
    first = mentions.groupBy(doc, key).agg(F.min(mention).alias("i"))
    return mentions.join(first, [doc, key]).where(F.col("i") < F.col(mention)).select(doc, "i", F.col(mention).alias("j"), F.lit(weight).alias("w")).distinct()


def merge_links(weighted: list[tuple[DataFrame, float]], doc: str) -> DataFrame:
    """Sum of weighted link tables (COR6, COR8)."""
    out = None
    for links, w in weighted:
        part = links.select(doc, "i", "j", (F.col("w") * w).alias("w"))
        out = part if out is None else out.union(part)
    return out.groupBy(doc, "i", "j").agg(F.sum("w").alias("w"))


def link_groups(links: DataFrame, mentions: DataFrame, doc: str, mention: str, threshold: float = 0.1) -> DataFrame:
    """Groups of mentions that links above the threshold connect (COR7): every
    mention with its group, the smallest member. Node names hold the document,
    so one closure serves all documents."""
    node = lambda c: F.struct(F.col(doc), F.col(c))
    strong = links.where(F.col("w") > threshold).select(node("i").alias("src"), node("j").alias("dst"))
    named = strong.select(F.struct(F.col(f"src.{doc}").alias("d"), F.col("src.i").alias("m")).alias("src"), F.struct(F.col(f"dst.{doc}").alias("d"), F.col("dst.j").alias("m")).alias("dst"))
    parts = connected_components(named).select(F.col("node.d").alias(doc), F.col("node.m").alias(mention), F.col("component.m").alias("grp"))
    return mentions.select(doc, mention).join(parts, [doc, mention], "left").withColumn("grp", F.coalesce("grp", mention))
