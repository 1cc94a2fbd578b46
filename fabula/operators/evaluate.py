"""Scores of predicted labels, rankings, links and annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, with 1 for a zero denominator."""
    return a / F.when(b == 0, 1).otherwise(b)


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    return ratio((1 + beta * beta) * p * r, beta * beta * p + r)


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts of each pair of labels (SNK10 in long form)."""
    return df.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))


def one_vs_all(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """TP, FP, FN, TN and scores of each label (AGG14, AGG26-28)."""
    n = confusion(df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()), gold, predicted)
    g = n.select(F.col(gold).alias("label"), "n", (F.col(gold) == F.col(predicted)).alias("hit"), F.lit(True).alias("as_gold"))
    p = n.select(F.col(predicted).alias("label"), "n", (F.col(gold) == F.col(predicted)).alias("hit"), F.lit(False).alias("as_gold"))
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t = g.union(p).groupBy("label").agg(
        add(F.col("as_gold") & F.col("hit")).alias("tp"), add(~F.col("as_gold") & ~F.col("hit")).alias("fp"), add(F.col("as_gold") & ~F.col("hit")).alias("fn")
    )
    t = t.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total"))))  # one row
    t = t.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    t = t.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return t.withColumns({"f1": f_beta(F.col("precision"), F.col("recall")), "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp"))})


def weighted_scores(scores: DataFrame) -> DataFrame:
    """Support-weighted and macro averages, and accuracy."""
    s = F.col("tp") + F.col("fn")
    mean = lambda c: (F.sum(F.col(c) * s) / F.sum(s)).alias(f"weighted_{c}")
    return scores.agg(*[mean(c) for c in ("precision", "recall", "f1")], F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.max("total")).alias("accuracy"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by trapezoids (AGG29). Ties share a point, so
    the window runs over distinct scores."""
    n = df.groupBy(score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q"))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = n.select("p", "q", F.sum("p").over(w).alias("tp"))
    return run.agg((F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def fleiss_kappa(votes: DataFrame, subject: str, category: str) -> DataFrame:
    """Agreement of votes (AGG30): every subject's own number of votes counts."""
    n = votes.groupBy(subject, category).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(subject).agg(F.sum("n").alias("k"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree")).where("k > 1")
    observed = per.agg(F.avg(F.col("agree") / (F.col("k") * (F.col("k") - 1))).alias("observed"))
    share = n.join(per.select(subject), subject, "left_semi").groupBy(category).agg(F.sum("n").alias("n"))
    total = share.agg(F.sum("n").alias("total"))
    chance = share.crossJoin(F.broadcast(total)).agg(F.sum((F.col("n") / F.col("total")) ** 2).alias("chance"))  # one row
    return observed.crossJoin(chance).withColumn("kappa", ratio(F.col("observed") - F.col("chance"), 1 - F.col("chance")))


def purity(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Share of members in the largest gold part of their predicted group, the
    same the other way, and the mean numbers of parts (AGG10, AGG11)."""
    n = df.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))
    by_p = n.groupBy(predicted).agg(F.max("n").alias("best"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"))
    by_g = n.groupBy(gold).agg(F.max("n").alias("best"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"))
    score = lambda t, a, b: t.agg((F.sum("best") / F.sum("size")).alias(a), F.avg("parts").alias(b))
    return score(by_p, "precision", "gold_per_group").crossJoin(score(by_g, "recall", "groups_per_gold"))


def pair_counts(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Linked pairs in both, either and each grouping (AGG12), from group
    sizes, so no pair is made; pairs are ordered and the diagonal negative."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1))
    n = df.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))
    both = n.agg(two("n").alias("both"), F.sum("n").alias("members"))
    p = n.groupBy(predicted).agg(F.sum("n").alias("k")).agg(two("k").alias("predicted_pairs"))
    g = n.groupBy(gold).agg(F.sum("n").alias("k")).agg(two("k").alias("gold_pairs"))
    t = both.crossJoin(p).crossJoin(g)
    t = t.withColumns({"precision": ratio(F.col("both"), F.col("predicted_pairs")), "recall": ratio(F.col("both"), F.col("gold_pairs"))})
    return t.withColumn("f1", f_beta(F.col("precision"), F.col("recall")))


def vote_by_group(df: DataFrame, group: str, label: str) -> DataFrame:
    """Most frequent label of each group, the smallest of equals (AGG4, AGG5).
    Counts come before the ranking, so a large group is a few rows."""
    n = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("votes"))
    first = Window.partitionBy(group).orderBy(F.desc("votes"), label)
    return n.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
