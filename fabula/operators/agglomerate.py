"""Agglomerative clustering in rounds of reciprocal nearest neighbours (CLU2).

Clusters are a table of centroids and sizes. The cost of a merge is Ward's, the
growth of the sum of squares, n*m/(n+m) * |a - b|**2. Merging two clusters never
brings a third nearer to them than it was to the nearer one, so all pairs that
are each other's nearest can be merged in one round, and the tree is that of
merging the cheapest pair again and again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import written

#: Rows of a tile; a task compares two tiles.
TILE = 2048
#: Costs are compared by so many digits, so that ties are ties everywhere.
DIGITS = 9


def nearest(clusters: DataFrame, tiles: int) -> DataFrame:
    """id, other, cost: the nearest other cluster of each, ties to the least
    id. Each tile of clusters meets each tile once; a row per cluster and tile
    is left for the last reduction."""
    schema = "id long, cost double, other long"

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[pdf["side"] == 0].sort_values("id")
        b = pdf[pdf["side"] == 1].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "cost": [], "other": []})
        x, y = np.stack(a["centroid"].to_numpy()), np.stack(b["centroid"].to_numpy())
        n, m = a["n"].to_numpy(np.float64), b["n"].to_numpy(np.float64)
        other = b["id"].to_numpy()
        out_cost, out_other = [], []
        for k in range(len(x)):
            cost = np.round(n[k] * m / (n[k] + m) * np.square(x[k] - y).sum(1), DIGITS)
            cost[other == a["id"].iloc[k]] = np.inf
            j = int(cost.argmin())
            out_cost.append(cost[j])
            out_other.append(other[j])
        found = pd.DataFrame({"id": a["id"].to_numpy(), "cost": out_cost, "other": out_other})
        return found[np.isfinite(found["cost"])]

    tile = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    t = clusters.withColumn("tile", tile)
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = t.withColumn("to", every).select(F.col("tile").alias("x"), F.col("to").alias("y"), F.lit(0).alias("side"), "id", "n", "centroid")
    right = t.withColumn("to", every).select(F.col("to").alias("x"), F.col("tile").alias("y"), F.lit(1).alias("side"), "id", "n", "centroid")
    best = left.union(right).groupBy("x", "y").applyInPandas(compare, schema)
    return best.groupBy("id").agg(F.min(F.struct("cost", "other")).alias("b")).select("id", "b.other", "b.cost")


def merge_tree(vectors: DataFrame, key: str, vector: str, *, to: int = 1) -> DataFrame:
    """The merges: left, right (the smaller id first), merged, cost, n and
    round. A cluster's id is the least key in it, so ``merged`` is ``left``. Rows
    with a null key, vector or component, or another width than the first row's
    by key, take no part; of rows with one key the one with the least vector
    does. Stops at ``to`` clusters: a merge costs at least what the merges below
    it did, so these are the clusters that the cheapest merges leave."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("centroid")).where("id is not null and centroid is not null and size(centroid) > 0 and forall(centroid, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    width = rows.agg(F.min(F.struct("id", F.size("centroid").alias("w")))["w"]).first()[0]
    clusters = rows.where(F.size("centroid") == F.lit(width)).groupBy("id").agg(F.min("centroid").alias("centroid")).withColumn("n", F.lit(1).cast("long"))
    clusters = written(clusters.select("id", "n", "centroid"), "clusters")
    out, turn, left = None, 0, clusters.count()
    start = left
    while left > 1:
        near = written(nearest(clusters, max(1, -(-left // TILE))), "nearest")
        back = near.select(F.col("id").alias("other"), F.col("other").alias("back"))
        pairs = near.join(back, "other").where("back = id and id < other").select(F.col("id").alias("left"), F.col("other").alias("right"), "cost")
        turn += 1
        # The cheapest pair of all is each other's nearest, so every round merges.
        pairs = written(pairs, "pairs")
        sized = clusters.select(F.col("id").alias("right"), F.col("n").alias("m"), F.col("centroid").alias("other"))
        joined = clusters.join(pairs.select(F.col("left").alias("id"), "right"), "id", "left").join(sized, "right", "left")
        # In a step of its own: beside a new n, the lambda would read that one.
        whole = F.col("n") + F.coalesce("m", F.lit(0))
        joined = joined.withColumn("mean", F.zip_with("centroid", "other", lambda x, y: (F.col("n") * x + F.col("m") * y) / (F.col("n") + F.col("m"))))
        grown = joined.select("id", whole.alias("n"), F.coalesce("mean", "centroid").alias("centroid"))
        gone = pairs.select(F.col("right").alias("id"))
        clusters = written(grown.join(gone, "id", "left_anti"), "clusters")
        step = written(pairs.join(clusters.select(F.col("id").alias("left"), "n"), "left").select("left", "right", "cost", "n", F.lit(turn).alias("round")), "merges")
        out = step if out is None else out.union(step)
        left = clusters.count()
    if out is None:
        return clusters.select(F.col("id").alias("left"), F.col("id").alias("right"), F.lit(0.0).alias("cost"), "n", F.lit(0).alias("round")).where("false")
    return out if to <= 1 else out.orderBy("cost", "round", "left").limit(max(start - to, 0))


def members(vectors: DataFrame, key: str, merges: DataFrame) -> DataFrame:
    """key and cluster (the least key of it) after the merges. A merge's right
    cluster is gone after it, so following the merges is a component search."""
    from fabula.operators.components import connected_components

    parts = connected_components(merges, "left", "right")
    keys = vectors.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    return keys.join(parts, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("cluster"))
