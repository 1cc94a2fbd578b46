"""A decision tree over presence tests in one order, as a table (CLS9).

Features are ranked once, by gain ratio. A node is a prefix of the row's bits
(feature present or not, best feature first); the table is grown level by level
with one grouped count a level. A child exists only if some of its rows are not
of its parent's majority class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.session import written


def entropy(*parts: Column) -> Column:
    total = sum(parts[1:], parts[0])
    out = F.lit(0.0)
    for p in parts:
        out = out - F.when(p > 0, p / total * F.log2(p / total)).otherwise(0.0)
    return out


def ranked_features(rows: DataFrame, label: str, features: str, least: int, most: int) -> list[str]:
    """The ``most`` features with the best gain ratio about the label, of those
    that at least ``least`` rows have and at least ``least`` lack; ties by name.
    ``features``: an array of distinct names. Counts are grouped by feature and
    label; absences come from totals."""
    totals = rows.groupBy(F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("all"))
    seen = rows.select(F.col(label).alias("_y"), F.explode(features).alias("feature")).groupBy("feature", "_y").agg(F.count(F.lit(1)).alias("n"))
    size = rows.count()
    if not size:
        return []
    # H(Y | X) by x log x sums over the classes: n of a feature's rows, all - n of the others.
    plogp = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)
    j = seen.join(totals, "_y")
    per = j.groupBy("feature").agg(
        F.sum("n").alias("df"), F.sum(plogp(F.col("n"))).alias("inside"), F.sum(plogp(F.col("all") - F.col("n"))).alias("outside"), F.sum(plogp(F.col("all"))).alias("met")
    ).where((F.col("df") >= least) & (F.lit(size) - F.col("df") >= least))
    whole = totals.agg(F.sum(plogp(F.col("all")))).first()[0] or 0.0
    rest = F.lit(size) - F.col("df")
    # Classes that the feature never meets are wholly outside.
    outside = F.col("outside") + F.lit(whole) - F.col("met")
    given = (plogp(F.col("df")) - F.col("inside") + plogp(rest) - outside) / size
    gain = (plogp(F.lit(size)) - F.lit(whole)) / size - given
    split = entropy(F.col("df").cast("double"), rest.cast("double"))
    ratio = F.round(F.when(split > 0, gain / split).otherwise(0.0), 9)
    return [r["feature"] for r in per.select("feature", ratio.alias("ratio")).orderBy(F.desc("ratio"), "feature").limit(most).collect()]  # ``most`` names


def bits(features: str, ranked: list[str]) -> Column:
    return F.concat(*[F.when(F.array_contains(features, f), "1").otherwise("0") for f in ranked]) if ranked else F.lit("")


def grown(rows: DataFrame, label: str, path: str, depth: int) -> DataFrame:
    """Nodes (node, class, n) of the tree; the root is ''. Majority ties go to
    the least class. At most ``depth`` tests are made, fewer where all rows
    have stopped."""
    counted = written(rows.groupBy(F.col(path).alias("path"), F.col(label).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n")), "paths")
    live, nodes = counted, None
    for k in range(depth + 1):
        at = F.substring("path", 1, k) if k else F.lit("")
        per = live.groupBy(at.alias("node"), "y").agg(F.sum("n").alias("n"))
        node = per.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "y"))["y"].alias("class"), F.sum("n").alias("n"))
        node = written(node, "nodes")
        nodes = node if nodes is None else nodes.union(node)
        if k == depth:
            break
        child = F.substring("path", 1, k + 1)
        mixed = live.withColumn("node", at).join(node.select("node", "class"), "node").where("y <> class").select(child.alias("_child")).distinct()
        live = written(live.join(mixed, child == F.col("_child"), "left_semi"), "paths")
        if live.isEmpty():
            break
    return nodes


def classified(rows: DataFrame, nodes: DataFrame, path: str, depth: int) -> DataFrame:
    """``rows`` with ``predicted``: the class of the deepest node on the path."""
    keyed = rows.withColumn("_rid", F.monotonically_increasing_id())
    keyed = written(keyed, "rows")
    prefixes = keyed.select("_rid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.substr(F.col(path), F.lit(1), k))).alias("node")).distinct()
    best = prefixes.join(nodes.select("node", "class"), "node").groupBy("_rid").agg(F.max_by("class", F.length("node")).alias("predicted"))
    return keyed.join(best, "_rid", "left").drop("_rid")


def gain_tree(train: DataFrame, rows: DataFrame, label: str, features: str, *, least: int = 5, depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes, rows with predicted). Rows without a label do not train; null
    feature lists are empty; without training rows nothing is predicted."""
    clean = lambda df: df.withColumn("_f", F.coalesce(F.array_distinct(features), F.array().cast("array<string>")))
    known = clean(train.where(F.col(label).isNotNull()))
    ranked = ranked_features(known, label, "_f", least, depth)
    # The last feature is not tested: nothing is left to tell its children apart.
    tests = max(len(ranked) - 1, 0)
    nodes = grown(known.withColumn("_bits", bits("_f", ranked)), label, "_bits", tests)
    return nodes, classified(clean(rows).withColumn("_bits", bits("_f", ranked)), nodes, "_bits", tests).drop("_f", "_bits")
