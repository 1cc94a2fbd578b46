"""Latent semantics of a sparse table of documents and terms (CLU3).

Block power iteration: a small block of term vectors is multiplied by the table
and by its transpose, two joins with partial sums a round, and made orthonormal
by its Gram matrix, which is all that leaves Spark. A last small eigenproblem
turns the block into singular vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.session import written

#: Directions of which the Gram matrix has less than that share are dropped.
TINY = 1e-12


def columns(b: int, name: str = "q") -> list[str]:
    return [f"{name}{j}" for j in range(b)]


def times(cells: DataFrame, block: DataFrame, over: str, to: str, b: int) -> DataFrame:
    """The table times a block of vectors: rows of ``to``."""
    j = cells.join(block, over)
    return j.groupBy(to).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns(b)])


def gram(block: DataFrame, b: int) -> np.ndarray:
    """b by b numbers: inner products of the block's columns."""
    names = columns(b)
    row = block.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i in range(b) for j in range(i, b)]).first()
    g = np.zeros((b, b))
    for i in range(b):
        for j in range(i, b):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g


def turned(block: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """The block's columns combined by the matrix ``m``."""
    old = columns(m.shape[0])
    mixed = [sum((F.col(c) * F.lit(float(m[i, j])) for i, c in enumerate(old)), F.lit(0.0)).alias(n) for j, n in enumerate(columns(m.shape[1]))]
    return block.select(key, *mixed)


def orthonormal(block: DataFrame, key: str, b: int) -> tuple[DataFrame, int]:
    """The block by an orthonormal one of the same span, and its width. The
    product is made once; what turns it is a projection on that table."""
    block = written(block, "block")
    values, vectors = np.linalg.eigh(gram(block, b))
    keep = values > max(values.max(initial=0.0), 0.0) * TINY
    m = vectors[:, keep] / np.sqrt(values[keep])
    return turned(block, key, m), int(keep.sum())


def array_of(b: int, k: int) -> Column:
    return F.array(*[F.col(c) for c in columns(b)[:k]])


def latent(cells: DataFrame, k: int, *, doc: str = "doc", term: str = "term", weight: str = "w", more: int = 6, rounds: int = 12, tolerance: float = 1e-10, seed: int = 1) -> tuple[DataFrame, DataFrame, list[float]]:
    """(doc, latent), (term, latent) and the singular values, best first.

    Documents are U times S, terms V; their signs are free, products and
    cosines of documents are not. ``more`` directions than ``k`` are carried so
    that the wanted ones settle; iteration ends when the singular values change
    by less than ``tolerance`` of the first, or after ``rounds``. Cells of one
    document and term are added up; null keys and weights, NaN and zero ones are
    left out; a rank below k gives fewer directions. An empty table gives empty
    results."""
    clean = cells.select(F.col(doc).alias("doc"), F.col(term).alias("term"), F.col(weight).cast("double").alias("w")).where("doc is not null and term is not null and w is not null and not isnan(w)")
    # Dealt by document, so that a document's products are summed where they are made.
    a = written(clean.repartition("doc").groupBy("doc", "term").agg(F.sum("w").alias("w")).where("w <> 0"), "cells")
    b = k + more
    start = a.select("term").distinct().select("term", *[(F.xxhash64("term", F.lit(seed), F.lit(j)) / F.lit(2.0**63)).alias(c) for j, c in enumerate(columns(b))])
    block, b = orthonormal(start, "term", b)
    before = np.zeros(0)
    for _ in range(rounds if b else 0):
        onto = written(times(a, block, "term", "doc", b), "block")
        now = np.sqrt(np.maximum(np.linalg.eigvalsh(gram(onto, b))[::-1][:k], 0))
        block, b = orthonormal(times(a, onto, "doc", "term", b), "term", b)
        if len(now) == len(before) and np.abs(now - before).max() <= tolerance * now[0]:
            break
        before = now
    docs = written(times(a, block, "term", "doc", b), "block") if b else a.select("doc").where("false")
    if not b:
        none = F.array().cast("array<double>").alias("latent")
        return docs.select("doc", none), a.select("term", none).where("false"), []
    values, vectors = np.linalg.eigh(gram(docs, b))
    order = [j for j in np.argsort(-values)[:k] if values[j] > max(values.max(), 0) * TINY]
    m = vectors[:, order]
    out = [turned(x, key, m).select(F.col(key), array_of(len(order), len(order)).alias("latent")) for x, key in ((docs, "doc"), (block, "term"))]
    return out[0], out[1], [float(np.sqrt(values[j])) for j in order]


def folded_in(cells: DataFrame, terms: DataFrame, *, doc: str = "doc", term: str = "term", weight: str = "w") -> DataFrame:
    """Documents that were not learnt from, in the same space (doc, latent);
    terms that are not known add nothing."""
    c = cells.select(F.col(doc).alias("doc"), F.col(term).alias("term"), F.col(weight).cast("double").alias("w")).where("w is not null and not isnan(w)")
    each = c.join(terms, "term").select("doc", "w", F.posexplode("latent").alias("j", "x"))
    per = each.groupBy("doc", "j").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return per.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("latent"))  # a number per direction


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two latent vectors; null where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
