"""Rounds of reciprocal nearest neighbours give the tree of single merges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import fabula.operators.agglomerate as A


def plain(points, to=1):
    """The cheapest pair is merged, again and again."""
    clusters = {k: (1, np.array(v, float)) for k, v in points.items()}
    out = set()
    while len(clusters) > to:
        ids = sorted(clusters)
        best = min(((round(float(clusters[a][0] * clusters[b][0] / (clusters[a][0] + clusters[b][0]) * np.square(clusters[a][1] - clusters[b][1]).sum()), 9), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]))
        cost, a, b = best
        (n, x), (m, y) = clusters[a], clusters.pop(b)
        clusters[a] = (n + m, (n * x + m * y) / (n + m))
        out.add((a, b, round(cost, 6), n + m))
    return out


def tree(df):
    return {(r.left, r.right, round(r.cost, 6), r.n) for r in df.collect()}


@pytest.mark.parametrize("tile", [2048, 7])
def test_same_tree(spark, monkeypatch, tile):
    monkeypatch.setattr(A, "TILE", tile)
    r = np.random.default_rng(tile)
    points = {3 * k + 1: [float(x) for x in r.normal(size=4)] for k in range(24)}
    df = spark.createDataFrame(list(points.items()), "k long, v array<double>").repartition(3)
    merges = A.merge_tree(df, "k", "v")
    assert tree(merges) == plain(points)
    assert merges.agg(F.max("round")).first()[0] < 20


def test_given_vectors(spark):
    """The tree of the embeddings whose id is divisible by 20."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id % 20 = 0")
    points = {r.vec_id: r.embedding for r in e.collect()}
    assert tree(A.merge_tree(e, "vec_id", "embedding")) == plain(points)


def test_stops_at_a_number_of_clusters(spark):
    points = {k: [float(k // 4 * 10 + k % 4)] for k in range(12)}
    df = spark.createDataFrame(list(points.items()), "k int, v array<double>")
    got = {r.k: r.cluster for r in A.members(df, "k", A.merge_tree(df, "k", "v", to=3)).collect()}
    assert got == {k: k // 4 * 4 for k in range(12)}


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (1, [5.0, 5.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, []), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    merges = A.merge_tree(df, "k", "v")
    assert tree(merges) == {(1, 2, 0.0, 2)}
    assert {r.k: r.cluster for r in A.members(df, "k", merges).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    assert A.merge_tree(df.limit(0), "k", "v").count() == 0
    assert A.members(df.where("k = 3"), "k", A.merge_tree(df.where("k = 3"), "k", "v")).count() == 1
