"""Latent vectors against a dense decomposition."""

import numpy as np
import pytest

from fabula.operators import semantics as S


def cells(spark, x):
    rows = [(f"d{i}", f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "doc string, term string, w double").repartition(3)


def topics(seed, docs=24, terms=30, k=3):
    r = np.random.default_rng(seed)
    x = r.poisson(0.2, (docs, terms)).astype(float)
    for i in range(docs):
        x[i, (i % k) * 10 : (i % k) * 10 + 10] += r.poisson(3.0 + i % k, 10)
    return x


def cosines(m):
    n = np.sqrt(np.square(m).sum(1))
    return m @ m.T / n[:, None] / n[None, :]


@pytest.mark.parametrize("k", [1, 3])
def test_equals_dense_decomposition(spark, k):
    x = topics(k)
    docs, terms, sigma = S.latent(cells(spark, x), k)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(sigma, s[:k], rtol=1e-6)
    got = {r.doc: r.latent for r in docs.collect()}
    m = np.array([got[f"d{i}"] for i in range(len(x))])
    assert np.allclose(cosines(m), cosines(u[:, :k] * s[:k]), atol=1e-6)
    t = {r.term: r.latent for r in terms.collect()}
    v = np.array([t[f"t{j}"] for j in range(x.shape[1])])
    assert np.allclose(v @ v.T, vt[:k].T @ vt[:k], atol=1e-6)
    new = S.folded_in(cells(spark, x[:4]), terms)
    assert np.allclose(np.array([r.latent for r in new.orderBy("doc").collect()]), m[:4], atol=1e-6)


def test_odd_rows(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "x", None), (None, "x", 1.0), ("c", None, 1.0), ("d", "y", float("nan")), ("e", "z", 0.0), ("f", "y", 2.0)], "doc string, term string, w double")
    docs, terms, sigma = S.latent(df, 5)
    assert np.allclose(sigma, [3, 2]) and {r.doc for r in docs.collect()} == {"a", "f"} and terms.count() == 2
    docs, terms, sigma = S.latent(df.limit(0), 3)
    assert docs.count() == terms.count() == 0 and sigma == []
