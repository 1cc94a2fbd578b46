"""Descriptive statistics and tests as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import probability


def boxplot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Minimum, quartiles (linear interpolation) and maximum (AGG33). Equal
    values are counted first, so that one task reads each distinct value of a
    group once, not once from every task that saw it."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_often"))
    at = [F.percentile(value, p, F.col("_often")).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return counted.groupBy(*by).agg(F.min(value).alias("low"), *at, F.max(value).alias("high"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bins equal bins of width (max - min) / bins + 1e-6 (AGG34)."""
    ends = df.agg(F.min(value).alias("lo"), ((F.max(value) - F.min(value)) / bins + 1e-6).alias("width"))
    return (
        df.crossJoin(F.broadcast(ends))  # one row
        .groupBy(F.floor((F.col(value) - F.col("lo")) / F.col("width")).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    )


def centred_average(df: DataFrame, by: str, order: list[str], value: str, k: int) -> DataFrame:
    """Mean of up to 2k+1 neighbours (WIN6)."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-k, k)
    return df.withColumn("average", F.avg(value).over(w))


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Population mean, variance, skewness and excess kurtosis (AGG31, AGG32)."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis")
    )


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, deviation, range, upper median and smallest mode (AGG25)."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    upper = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col(value)))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("low"), F.max(value).alias("high"),
        upper.alias("upper_median"), F.expr(f"mode({value}, true)").alias("mode"),
    )


def expected_table(df: DataFrame, row: str, col: str) -> DataFrame:
    """Observed and expected counts of a contingency table (AGG36). Cells with
    no row are there too. The three small tables come from one count."""
    seen = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    rows = seen.groupBy(row).agg(F.sum("n").alias("row_total"))
    cols = seen.groupBy(col).agg(F.sum("n").alias("col_total"))
    grid = rows.crossJoin(cols).join(seen, [row, col], "left").withColumn("observed", F.coalesce("n", F.lit(0)))
    total = rows.agg(F.sum("row_total").alias("total"))
    return grid.crossJoin(F.broadcast(total)).withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("total"))  # one row


def chi_squared(df: DataFrame, row: str, col: str) -> DataFrame:
    """Pearson's x2, the likelihood ratio g and the degrees of freedom."""
    t = expected_table(df, row, col)
    o, e = F.col("observed"), F.col("expected")
    return t.agg(
        F.sum((o - e) ** 2 / e).alias("x2"),
        (2 * F.sum(F.when(o > 0, o * F.log(o / e)).otherwise(0.0))).alias("g"),
        ((F.countDistinct(row) - 1) * (F.countDistinct(col) - 1)).alias("df"),
    )


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-tailed p of a 2x2 table: tables as likely or less, margins fixed."""
    return probability.p_value(probability.fisher_p, a, b, c, d)


def ks_distance(df: DataFrame, side: str, value: str, first, second) -> DataFrame:
    """Largest gap of two samples' distribution functions (AGG38). Values are
    counted before the window, so it runs over distinct values."""
    counts = df.where(F.col(side).isin(first, second)).groupBy(value).agg(
        F.sum((F.col(side) == first).cast("int")).alias("a"), F.sum((F.col(side) == second).cast("int")).alias("b")
    )
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    run = counts.select(value, F.sum("a").over(w).alias("ca"), F.sum("b").over(w).alias("cb")).crossJoin(F.broadcast(totals))  # one row
    return run.agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("distance"), F.max("na").alias("n1"), F.max("nb").alias("n2"))


def welch(df: DataFrame, side: str, value: str, first, second) -> DataFrame:
    """Welch's t and its degrees of freedom (AGG39), one pass over the rows."""
    pick = lambda s: F.when(F.col(side) == s, F.col(value))
    one = df.agg(*[f(pick(s)).alias(f"{n}{k}") for k, s in ((1, first), (2, second)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return one.select(
        ((F.col("m1") - F.col("m2")) / F.sqrt(a + b)).alias("t"), ((a + b) ** 2 / (a**2 / (F.col("n1") - 1) + b**2 / (F.col("n2") - 1))).alias("df")
    )


def entropy(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Base-2 entropy of the values of each group (AGG43)."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"))
    return n.join(total, by).groupBy(*by).agg((-F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("total")))).alias("entropy"))
