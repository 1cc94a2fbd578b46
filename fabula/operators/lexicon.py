"""Lexicons and taxonomies given as tables. Edges are (child, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.operators.hierarchy import ancestors


def with_depth(edges: DataFrame) -> DataFrame:
    """All nodes with their depth; a root has 1 (LEX4)."""
    up = ancestors(edges).groupBy(F.col("child").alias("node")).agg((F.max("depth") + 1).alias("depth"))
    roots = edges.select(F.col("parent").alias("node")).distinct().join(up, "node", "left_anti").withColumn("depth", F.lit(1))
    return up.unionByName(roots)


def self_and_ancestors(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    return ancestors(edges).select(F.col("child").alias("node"), "ancestor").distinct().union(nodes.select("node", F.col("node").alias("ancestor")))


def common_ancestors(pairs: DataFrame, edges: DataFrame, lowest: bool = True) -> DataFrame:
    """(a, b, ancestor, depth) shared by the nodes of each pair (LEX3)."""
    up, depth = self_and_ancestors(edges), with_depth(edges)
    both = (
        pairs.join(up.select(F.col("node").alias("a"), "ancestor"), "a")
        .join(up.select(F.col("node").alias("b"), "ancestor"), ["b", "ancestor"])
        .join(depth.withColumnRenamed("node", "ancestor"), "ancestor")
    )
    if not lowest:
        return both.select("a", "b", "ancestor", "depth")
    return both.groupBy("a", "b").agg(F.max("depth").alias("depth"), F.min_by("ancestor", F.struct(-F.col("depth"), F.col("ancestor"))).alias("ancestor"))


def wu_palmer(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """2 * depth(lowest common) / (depth(a) + depth(b)); 0 without one (LEX4)."""
    depth = with_depth(edges)
    low = common_ancestors(pairs, edges).select("a", "b", F.col("depth").alias("d"))
    da, db = depth.select(F.col("node").alias("a"), F.col("depth").alias("da")), depth.select(F.col("node").alias("b"), F.col("depth").alias("db"))
    j = pairs.join(low, ["a", "b"], "left").join(da, "a", "left").join(db, "b", "left")
    return j.select("a", "b", F.coalesce(2 * F.col("d") / (F.col("da") + F.col("db")), F.lit(0.0)).alias("similarity"))


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything below the seed nodes (LEX7)."""
    return ancestors(edges).join(seeds.select(F.col("node").alias("ancestor")), "ancestor").select(F.col("ancestor").alias("seed"), F.col("child").alias("node"), "depth")


def mapped(words: DataFrame, classes: DataFrame, word: str = "word") -> DataFrame:
    """Class of each word, the word itself where none is listed (JN8). A word
    in several classes takes the smallest class, then its name (LEX5, LEX6)."""
    size = classes.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    first = classes.join(size, "class").groupBy(F.col("word").alias(word)).agg(F.min_by("class", F.struct("size", "class")).alias("class"))
    return words.join(first, word, "left").withColumn("class", F.coalesce("class", F.col(word)))


def expand(words: DataFrame, synsets: DataFrame, relations: DataFrame, kind: str) -> DataFrame:
    """Related words over one relation (LEX2, LEX12): synsets (word, synset),
    relations (synset, kind, other)."""
    s = words.join(synsets, "word")
    r = s.join(relations.where(F.col("kind") == kind).drop("kind"), "synset")
    names = synsets.select(F.col("synset").alias("other"), F.col("word").alias("related"))
    return r.join(names, "other").select("word", "related").distinct()


def polarity(words: DataFrame, scores: DataFrame) -> DataFrame:
    """Sum of positive minus sum of negative scores of a word (LEX8)."""
    return words.join(scores, "word").groupBy("word").agg((F.sum("positive") - F.sum("negative")).alias("polarity"))


def information_content(counts: DataFrame) -> DataFrame:
    """Frequency divided by the largest frequency (LEX9)."""
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("word", (F.col("n") / F.col("top")).alias("ic"))  # one row


def flags(tokens: DataFrame, lists: DataFrame, by: list[str], names: list[str], word: str = "token") -> DataFrame:
    """1.0 for each named word list that a group's tokens touch (FEA2, FEA4,
    AGG41, AGG42). lists: word, list."""
    hit = tokens.join(lists.select(F.col("word").alias("_w"), F.col("list").alias("_list")), F.lower(word) == F.col("_w"), "left")
    # One aggregate over the tokens: groups that touch no list come from the left join.
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("_list") == n, 1.0).otherwise(0.0)).alias(n) for n in names])


def assemble(features: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Long features (name, value) to an ordered dense vector (FEA8)."""
    wide = features.groupBy(*by).pivot("name", names).agg(F.max("value")).na.fill(0.0, names)
    return wide.select(*by, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("features"))


def mapped_ids(df: DataFrame, mapping: DataFrame, column: str = "synset") -> DataFrame:
    """Ids of another version (LEX13): mapping (old, new); null where none is
    listed, the least where several are."""
    one = mapping.groupBy(F.col("old").alias(column)).agg(F.min("new").alias(f"{column}_new"))
    return df.join(one, column, "left")


def taxonomy(synsets: DataFrame, relations: DataFrame, kind: str = "hypernym") -> DataFrame:
    """Edges (child, parent) of a lexicon (LEX14): words below their synsets,
    synsets below their hypernyms."""
    words = synsets.select(F.col("word").alias("child"), F.col("synset").alias("parent"))
    return words.union(relations.where(F.col("kind") == kind).select("synset", "other")).distinct()
