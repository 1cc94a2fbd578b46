"""Features of words from concept graphs: flags of rules, likeness to clouds.

Neither meets words with words. For flags, bit sets of the rules' concepts are
pushed down the ``isa`` edges until nothing changes, and a word looks its
neighbours up. For clouds, each cloud is reduced to its best entry below every
ancestor, and a word meets the ancestors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.operators.lexicon import self_and_ancestors, with_depth
from fabula.session import cut, written

MOST_GROUPS = 63


def concept_bits(edges: DataFrame, targets: DataFrame, pushed: str = "isa") -> DataFrame:
    """(node, bits): the bits of ``targets`` (concept, bits) that a node is, or
    reaches over ``pushed`` edges (word, relation, concept) upwards. Cycles are
    allowed; rounds are the longest way to a target."""
    up = written(edges.where(F.col("relation") == pushed).where("word is not null and concept is not null").select("word", "concept").distinct(), "edges")
    bits = cut(targets.groupBy(F.col("concept").alias("node")).agg(F.bit_or("bits").alias("bits")))
    while True:
        came = up.join(bits, F.col("concept") == F.col("node")).select(F.col("word").alias("node"), "bits", F.lit(0).cast("long").alias("old"))
        both = came.union(bits.select("node", "bits", F.col("bits").alias("old")))
        nxt = cut(both.groupBy("node").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old")))
        if nxt.where("bits <> old").isEmpty():
            return nxt.select("node", "bits")
        bits = nxt.select("node", "bits")


def concept_flags(words: DataFrame, edges: DataFrame, rules: list[tuple[str, list[str], list[str]]], pushed: str = "isa") -> DataFrame:
    """Flags of words (JN13, FEA5): word and a column of 1.0 or 0.0 for each
    rule's name. A rule (name, relations, concepts) holds for a word with an
    edge of one of the relations to a concept that is one of the rule's or
    reaches one over ``pushed`` edges. ``words`` (word) are given once each;
    null ones have no flag. Name and relation make a group; 63 are allowed."""
    groups = list(dict.fromkeys((name, r) for name, rs, _ in rules for r in rs))
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} pairs of a flag and a relation")
    at = {g: 1 << k for k, g in enumerate(groups)}
    names = list(dict.fromkeys(name for name, _, _ in rules))
    targets = words.sparkSession.createDataFrame([(c, at[name, r]) for name, rs, cs in rules for r in rs for c in cs], "concept string, bits long")
    bits = concept_bits(edges, targets, pushed)
    of_relation = F.lit(0).cast("long")
    for r in dict.fromkeys(r for _, r in groups):
        of_relation = F.when(F.col("relation") == r, F.lit(sum(b for (_, x), b in at.items() if x == r))).otherwise(of_relation)
    met = edges.join(bits, F.col("concept") == F.col("node")).select("word", F.col("bits").bitwiseAND(of_relation).alias("bits"))
    own = met.groupBy("word").agg(F.bit_or("bits").alias("_bits"))
    one = words.select("word").distinct().join(own, "word", "left")
    held = lambda n: F.when(F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(F.lit(sum(b for (x, _), b in at.items() if x == n))) != 0, 1.0).otherwise(0.0)
    return one.select("word", *[held(n).alias(n) for n in names])


def cloud_similarity(senses: DataFrame, clouds: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, cloud, similarity): the best Wu-Palmer similarity of a word's
    senses (word, sense) to a cloud's (cloud, sense) in a graph whose nodes may
    have several parents (LEX3, LEX4). Depth is the longest way from a root; the
    common ancestor counts that gives most. Pairs without one are left out, as
    are senses that the graph does not know."""
    depth = written(with_depth(edges), "depths")
    up = written(self_and_ancestors(edges).join(depth.select("node", F.col("depth").alias("own")), "node").join(depth.select(F.col("node").alias("ancestor"), F.col("depth").alias("high")), "ancestor"), "ancestors")
    # Below an ancestor the cloud's shallowest sense is the nearest.
    best = clouds.distinct().join(up, F.col("sense") == F.col("node")).groupBy("cloud", "ancestor", "high").agg(F.min("own").alias("low"))
    words = senses.distinct().join(up.select("node", F.col("ancestor").alias("a"), "own"), F.col("sense") == F.col("node")).groupBy("word", "a").agg(F.min("own").alias("own"))
    j = words.join(best, F.col("a") == F.col("ancestor"))
    return j.groupBy("word", "cloud").agg(F.max(2 * F.col("high") / (F.col("own") + F.col("low"))).alias("similarity"))


def cloud_features(tokens: DataFrame, similarity: DataFrame, by: list[str], clouds: list[str], least: float = 0.1) -> DataFrame:
    """``by`` and a column for each cloud (FEA3): the mean similarity of the
    tokens (column word) that are more than ``least`` like it, else 0."""
    j = tokens.join(similarity.where(F.col("similarity") > least), "word", "left")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("cloud") == c, F.col("similarity"))), F.lit(0.0)), 9).alias(c)
    return j.groupBy(*by).agg(*[mean(c) for c in clouds])
