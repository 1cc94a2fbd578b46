"""Clusters, latent semantics and frequent sets by Spark's own learners."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, column: str) -> DataFrame:
    ok = F.col(column).isNotNull() & (F.size(column) > 0) & F.exists(column, lambda x: x != 0)
    return df.where(ok).withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def k_means(df: DataFrame, column: str, k: int, seed: int = 1, measure: str = "cosine") -> DataFrame:
    """Lloyd's algorithm with k-means|| starts (CLU1): a column cluster."""
    model = KMeans(k=k, seed=seed, distanceMeasure=measure, predictionCol="cluster").fit(vectors(df, column))
    return model.transform(vectors(df, column)).drop("features")


def hierarchical(df: DataFrame, column: str, k: int, seed: int = 1) -> DataFrame:
    """Top-down hierarchy cut at k leaves (CLU2 for large inputs)."""
    model = BisectingKMeans(k=k, seed=seed, predictionCol="cluster").fit(vectors(df, column))
    return model.transform(vectors(df, column)).drop("features")


def latent(df: DataFrame, column: str, k: int) -> DataFrame:
    """Projection on the k main directions (CLU3); signs are free."""
    model = PCA(k=k, inputCol="features", outputCol="latent").fit(vectors(df, column))
    return model.transform(vectors(df, column)).withColumn("latent", vector_to_array("latent")).drop("features")


def frequent_sets(baskets: DataFrame, items: str, support: float) -> DataFrame:
    """Frequent item sets (CLU4) by FP-growth: items, freq."""
    from pyspark.ml.fpm import FPGrowth

    return FPGrowth(itemsCol=items, minSupport=support).fit(baskets).freqItemsets


def linear_svm(df: DataFrame, column: str, label: str, seed_iterations: int = 20):
    """Linear support vector machine, one against the rest (CLS11). Several
    labels' machines are fitted at a time: each is a row of short jobs that
    leave most cores idle."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    train = vectors(df, column).where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    return OneVsRest(classifier=LinearSVC(maxIter=seed_iterations), parallelism=8, labelCol=label, featuresCol="features", predictionCol="predicted").fit(train)


def decision_tree(df: DataFrame, column: str, label: str, depth: int = 6):
    """Presence tests in order of gain (CLS9) as Spark's decision tree."""
    from pyspark.ml.classification import DecisionTreeClassifier

    train = vectors(df, column).where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    return DecisionTreeClassifier(maxDepth=depth, labelCol=label, featuresCol="features", predictionCol="predicted", impurity="entropy").fit(train)
