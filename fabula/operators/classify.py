"""Classifiers over sparse terms and dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.operators import tiles as tiling
from fabula.session import written

QUERY_BLOCK = 4096
#: Queries that a task compares with a batch of rows at a time.
FEW = 256
#: Rows that they are compared with at a time, so that sums stay in the cache.
TILE = 128
#: Rows of a tile where all meet all, least and most; larger tiles before there are more than MANY.
ROWS, MOST_ROWS, MANY = 1024, 65_536, 16
#: Candidates that wait before all but the best are dropped.
HELD = 1024


def weighted_jaccard(a: Column, b: Column, w: Column | None = None) -> Column:
    """1 - sum(w * min) / sum(w * max) of two arrays; 0.5 if all is zero (CLS1)."""
    pair = F.zip_with(a, b, lambda x, y: F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")))
    if w is not None:
        pair = F.zip_with(pair, w, lambda p, k: F.struct((p["lo"] * k).alias("lo"), (p["hi"] * k).alias("hi")))
    lo = F.aggregate(pair, F.lit(0.0), lambda s, p: s + p["lo"])
    hi = F.aggregate(pair, F.lit(0.0), lambda s, p: s + p["hi"])
    return F.when(hi == 0, 0.5).otherwise(1 - lo / hi)


def distance(a: Column, b: Column, method: str | None = "cosine", custom=None) -> Column:
    """Distances of two arrays (CLS4, CLS5): cosine, squared euclidean,
    manhattan, chebyshev, hamming, mean_square, neg_weighted_overlap."""
    if custom is not None:
        return custom(a, b)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    size = F.greatest(F.size(a), F.size(b))
    square = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    if method == "cosine":
        norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
        return 1 - F.coalesce(F.try_divide(total(F.zip_with(a, b, lambda x, y: x * y)), norm(a) * norm(b)), F.lit(0.0))
    if method == "euclidean":
        return total(square)
    if method == "mean_square":
        return F.sqrt(total(square) / size)
    if method == "manhattan":
        return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if method == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if method == "hamming":
        return total(F.zip_with(a, b, lambda x, y: F.when(x == y, 0.0).otherwise(1.0))) / size
    if method == "neg_weighted_overlap":
        return -total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / size
    raise ValueError(f"no such distance: {method}")


def similarities(q: np.ndarray, v: np.ndarray, weights: list[float] | None = None) -> np.ndarray:
    """Of all vectors of q with all of v: cosine, or weighted Jaccard."""
    if weights is None:
        unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        return unit(q) @ unit(v).T
    # Weighted once; the larger ones' sum is both sums less the smaller ones'.
    q, v = np.ascontiguousarray((q * weights).T), np.ascontiguousarray((v * weights).T)
    whole = [np.add.accumulate(x)[-1] if len(x) else np.zeros(x.shape[1]) for x in (q, v)]
    lo = np.zeros((q.shape[1], v.shape[1]))
    for a in range(0, v.shape[1], TILE):
        tile = np.zeros((q.shape[1], min(TILE, v.shape[1] - a)))
        least = np.empty_like(tile)
        for i, w in enumerate(weights):
            (np.minimum if w >= 0 else np.maximum)(q[i, :, None], v[i, None, a : a + TILE], out=least)
            tile += least
        lo[:, a : a + TILE] = tile
    hi = whole[0][:, None] + whole[1][None, :] - lo
    return np.where(hi == 0, 0.5, lo / np.where(hi == 0, 1, hi))


def leaders(sim: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest entries of each row, equal ones by
    ``own``. Only entries not below the k-th are sorted."""
    if sim.shape[1] > k:
        at = sim.shape[1] - k
        row, column = np.nonzero(sim >= np.partition(sim, at, axis=1)[:, at, None])
    else:
        row, column = np.nonzero(np.ones(sim.shape, bool))
    order = np.lexsort((own[column], -sim[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(sim)))[row] < k
    return row[keep], column[keep]


def gain_weights(rows: DataFrame, *, vector: str = "embedding", label: str = "label", threshold: float = 0.5) -> list[float]:
    """Information gain about the label of each entry being above the threshold
    (AGG44). One number for each entry of a vector reaches the driver."""
    n = rows.where(F.col(label).isNotNull()).select(F.posexplode(vector).alias("i", "x"), label).groupBy("i", (F.col("x") > threshold).alias("bit"), label).agg(F.count(F.lit(1)).alias("n"))
    entropy = lambda by: F.sum(-F.col("n") / F.col("all") * F.log2(F.col("n") / F.col("all"))).over(Window.partitionBy(*by))
    whole = n.groupBy("i", label).agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("i"))).withColumn("h", entropy(["i"]))
    whole = whole.groupBy("i").agg(F.first("h").alias("h"), F.first("all").alias("total"))
    split = n.withColumn("all", F.sum("n").over(Window.partitionBy("i", "bit"))).withColumn("h", entropy(["i", "bit"])).groupBy("i", "bit").agg(F.first("h").alias("hb"), F.first("all").alias("all"))
    gain = split.join(whole, "i").groupBy("i").agg((F.first("h") - F.sum(F.col("all") / F.col("total") * F.col("hb"))).alias("gain"))
    return [r["gain"] for r in gain.orderBy("i").toLocalIterator()]


def nearest(rows: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", other: list[str] | None = None, block: int = QUERY_BLOCK, digits: int = 6, story: str | None = None, weights: list[float] | None = None) -> DataFrame:
    """The k rows most like each query by cosine, itself left out (TOP1-3), with
    ``weights`` by 1 less the weighted Jaccard distance of vectors that are not
    negative (CLS1). With ``story`` rows of the query's story are left out too.

    Queries are taken in blocks of ``block``, all rows once for each block. A
    batch of rows keeps its own k best per query, so k rows per batch and query
    are shuffled. Similarities that agree to ``digits`` go by the key.
    """
    other = other or []
    schema = f"query long, {key} long, similarity double" + "".join(f", {c} {dict(rows.dtypes)[c]}" for c in other)
    out = None
    tale = story or key
    pending = queries.select(key, vector, F.col(tale).alias("_story")).where(F.col(vector).isNotNull()).orderBy(key).toLocalIterator()
    while chunk := [r for _, r in zip(range(block), pending)]:
        ids, tales = np.array([r[0] for r in chunk]), np.array([r[2] for r in chunk])
        q = np.array([r[1] for r in chunk], np.float64)

        def best(batches: Iterator[pd.DataFrame], ids=ids, tales=tales, q=q) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                own, v = pdf[key].to_numpy(), np.array(pdf[vector].tolist(), np.float64)
                for a in range(0, len(ids), FEW):
                    part = slice(a, a + FEW)
                    sim = np.round(similarities(q[part], v, weights), digits)
                    sim[(ids[part, None] == own[None, :]) | (tales[part, None] == pdf["_story"].to_numpy()[None, :])] = -2
                    sim[np.isnan(sim)] = -2
                    at = leaders(sim, own, k)
                    keep = sim[at] > -2
                    yield pd.DataFrame({"query": ids[part][at[0]], key: own[at[1]], "similarity": sim[at]} | {c: pdf[c].to_numpy()[at[1]] for c in other})[keep]

        part = rows.select(key, vector, F.col(tale).alias("_story"), *other).where(F.col(vector).isNotNull()).mapInPandas(best, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Leaders:
    """The k best of each of n rows so far: larger similarities first, equal
    ones by the other row's key. ``least``: what a candidate must reach."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.kept, self.more, self.waiting = k, np.full(n, -1.0), None, [], 0

    def take(self, row: np.ndarray, key: np.ndarray, sim: np.ndarray, at: np.ndarray) -> None:
        up = sim >= self.least[row]
        self.more.append((row[up], key[up], sim[up], at[up]))
        self.waiting += int(up.sum())
        if self.waiting > HELD:
            self.settle()

    def settle(self) -> None:
        row, key, sim, at = (np.concatenate(x) for x in zip(*([self.kept] if self.kept else []), *self.more))
        order = np.lexsort((key, -sim, row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        last, order = order[rank == self.k - 1], order[rank < self.k]
        self.least[row[last]] = np.maximum(self.least[row[last]], sim[last])
        self.kept, self.more, self.waiting = (row[order], key[order], sim[order], at[order]), [], 0


def nearest_of_all(rows: DataFrame, k: int, weights: list[float], *, key: str = "vec_id", vector: str = "embedding", other: list[str] | None = None, digits: int = 6, story: str | None = None) -> DataFrame:
    """What ``nearest`` with ``weights`` gives if every row is a query. Keys are
    whole numbers; rows without a key or a story have no part.

    All pairs, tile against tile (``tiles``), and a pair is compared once for
    both of its rows. A tile's weighted vectors are also kept as whole numbers,
    rounded down, and the sum of the smaller ones is first taken of these: it is
    too small by less than a vector's length. Only pairs that can be among a
    row's k best by that sum are compared in double precision. k rows for each
    row and tile are shuffled.
    """
    other, tale, w = other or [], story or key, np.array(weights, np.float64)
    kinds = dict(rows.dtypes)
    known = rows.where(F.col(key).isNotNull() & F.col(tale).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    known = written(known.select(F.col(key).cast("long").alias("_key"), F.col(vector).cast("array<double>").alias("_v"), F.col(tale).alias("_story"), *other), "vectors")
    tiles = tiling.tiles_for(known.count(), ROWS, MANY, MOST_ROWS)
    # One row: the largest weighted sum of a vector, which is that of 65,535 whole ones.
    total = F.aggregate(F.zip_with("_v", F.array(*[F.lit(max(float(x), 0.0)) for x in w]), lambda x, y: F.abs(x) * y), F.lit(0.0), lambda s, x: s + x)
    largest = known.select(total.alias("s")).where(F.col("s") < float("inf")).agg(F.max("s")).first()[0]
    scale = 65_535 * (1 - 1e-9) / largest if largest else 0.0

    def prepared(t: pa.Table) -> dict:
        v = t["_v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        u = v * w
        fast = scale > 0 and np.isfinite(u).all() and (v >= 0).all()
        whole = np.ascontiguousarray(np.floor(np.maximum(u, 0) * scale).astype(np.uint16).T) if fast else None
        # A gain below 0 (by rounding only) takes so much off a sum at most.
        off = scale * -np.minimum(u, 0).sum(1).min() if fast else 0.0
        return {"u": u, "sum": u.sum(1), "whole": whole, "off": off, "key": t["_key"].to_numpy(), "story": t["_story"].to_numpy(), "rest": [t[c].combine_chunks() for c in other]}

    def exact(a: dict, b: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p, q = a["u"][x], b["u"][y]
        lo = np.where(w >= 0, np.minimum(p, q), np.maximum(p, q)).sum(1)
        hi = a["sum"][x] + b["sum"][y] - lo
        return np.round(np.where(hi == 0, 0.5, lo / np.where(hi == 0, 1, hi)), digits)

    def share(least: np.ndarray) -> np.ndarray:
        """For that similarity, the smaller ones' whole sum as a share of both sums."""
        s = np.maximum(least - 10.0**-digits, 0)
        return (scale * s / (1 + s)).astype(np.float32)

    def likely(a: dict, b: dict, part: slice, beside: slice, apart: np.ndarray, leaders: list[tuple[Leaders, int]]) -> np.ndarray:
        """Which pairs can be among the best, by whole numbers."""
        q, v = a["whole"][:, part], b["whole"][:, beside]
        shared, smaller = np.zeros(apart.shape, np.uint16), np.empty(apart.shape, np.uint16)
        for i in range(len(q)):
            np.minimum(q[i, :, None], v[i, None], out=smaller)
            shared += smaller
        both = (a["sum"][part, None] + b["sum"][None, beside]).astype(np.float32)
        off = a["off"] + b["off"]
        for best, axis in leaders:
            if (best.least < 0).any() and shared.shape[axis] > k:
                # The k-th best is as good as the k-th of these by what they share at least.
                certain = np.maximum(shared.astype(np.float32) - np.float32(1 + off), 0)
                sure = np.where(apart, certain / np.maximum(np.float32(scale) * both - certain, 1e-30), -1)
                kth = np.take(np.partition(sure, shared.shape[axis] - k, axis), shared.shape[axis] - k, axis)
                best.least = np.where((best.least < 0) & (kth >= 0), np.maximum(kth * (1 - 1e-5) - 10.0**-digits, 0), best.least)
        need = np.minimum(share(leaders[0][0].least)[:, None], share(leaders[1][0].least)[None, :]) * both
        return apart & (shared >= need - np.float32(len(w) + 2 + off))

    def meet(a: dict, b: dict | None) -> Iterator[pd.DataFrame]:
        same, b = b is None, b or a
        columns = [slice(g, min(g + TILE, len(b["key"]))) for g in range(0, len(b["key"]), TILE)]
        theirs = [Leaders(c.stop - c.start, k) for c in columns]
        ended = lambda best, own, far, first: found(best, own, far, first) if best.kept or best.more else ()
        for f in range(0, len(a["key"]), FEW):
            part = slice(f, min(f + FEW, len(a["key"])))
            mine = Leaders(part.stop - f, k)
            for beside, best in zip(columns, theirs):
                if same and beside.stop <= f:
                    continue  # met from the other side
                apart = (a["key"][part, None] != b["key"][None, beside]) & (a["story"][part, None] != b["story"][None, beside])
                if same:
                    apart &= np.arange(part.start, part.stop)[:, None] < np.arange(beside.start, beside.stop)[None, :]
                if a["whole"] is not None and b["whole"] is not None:
                    apart = likely(a, b, part, beside, apart, [(mine, 1), (best, 0)])
                x, y = np.nonzero(apart)
                sim = exact(a, b, x + f, y + beside.start)
                good = ~np.isnan(sim)
                if good.any():
                    x, y, sim = x[good], y[good], sim[good]
                    mine.take(x, b["key"][y + beside.start], sim, y + beside.start)
                    best.take(y, a["key"][x + f], sim, x + f)
            yield from ended(mine, a, b, f)
        for beside, best in zip(columns, theirs):
            yield from ended(best, b, a, beside.start)

    def found(best: Leaders, own: dict, far: dict, first: int) -> Iterator[pd.DataFrame]:
        best.settle()
        row, ids, sim, at = best.kept
        yield pd.DataFrame({"query": own["key"][row + first], key: ids, "similarity": sim} | {c: r.take(pa.array(at)).to_pandas() for c, r in zip(other, far["rest"])})

    schema = f"query long, {key} long, similarity double" + "".join(f", {c} {kinds[c]}" for c in other)
    path = tiling.in_tiles(known, F.pmod(F.xxhash64("_key"), F.lit(tiles)).cast("int"), tiles)
    out = tiling.each_pair(known, path, tiles, ["_key", "_v", "_story", *other], prepared, meet, schema)
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn_label(neighbours: DataFrame, label: str = "label") -> DataFrame:
    """Label of most similarity among the neighbours (CLS8), smallest of equals."""
    s = neighbours.where("similarity > 0").groupBy("query", label).agg(F.round(F.sum("similarity"), 9).alias("weight"))
    w = Window.partitionBy("query").orderBy(F.desc("weight"), label)
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def vote_distribution(neighbours: DataFrame, labels: DataFrame, beta: float = 0.1, label: str = "label") -> DataFrame:
    """Share of each label among a query's neighbours, smoothed by ``beta``
    (CLS3): (query, label, p) for every label of ``labels`` (one column)."""
    n = neighbours.groupBy("query", label).agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy("query").agg(F.sum("n").alias("all"))
    names = labels.select(label).where(F.col(label).isNotNull()).distinct()
    kinds = names.agg(F.count(F.lit(1)).alias("kinds"))
    grid = size.crossJoin(F.broadcast(names)).crossJoin(F.broadcast(kinds))  # a row per label, one row
    p = (F.coalesce("n", F.lit(0)) + beta) / (F.col("all") + beta * F.col("kinds"))
    return grid.join(n, ["query", label], "left").select("query", label, p.alias("p"))


def likeliest(distribution: DataFrame, label: str = "label", digits: int = 9) -> DataFrame:
    """The label of the largest share, the first of equals (TOP12, SEQ23)."""
    w = Window.partitionBy("query").orderBy(F.round("p", digits).desc(), label)
    return distribution.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def naive_bayes(terms: DataFrame, labels: DataFrame, docs: DataFrame, *, key: str = "doc_id", label: str = "label", alpha: float = 0.0001) -> DataFrame:
    """log score of every class for the documents of ``docs`` (terms of them),
    trained on ``terms`` joined with ``labels`` (CLS7). Only a term that the
    class has not seen is smoothed, with alpha; so a document's score is that
    of all terms unseen plus a correction for each seen one: one equi-join."""
    train = terms.join(labels, key)
    counts = train.groupBy(label, "term").agg(F.sum("n").alias("c"))
    prior = labels.groupBy(label).agg(F.count(F.lit(1)).alias("docs"))
    classes = counts.groupBy(label).agg(F.sum("c").alias("total")).join(prior, label)
    all_docs = prior.agg(F.sum("docs").alias("all"))
    classes = classes.crossJoin(F.broadcast(all_docs)).select(label, "total", F.log(F.col("docs") / F.col("all")).alias("log_prior"))  # a row per class
    size = docs.groupBy(key).agg(F.sum("n").alias("size"))
    gain = docs.join(counts, "term").groupBy(key, label).agg(F.sum(F.col("n") * (F.log("c") - F.log(F.lit(alpha)))).alias("gain"))
    grid = size.crossJoin(F.broadcast(classes))  # a row per class
    score = F.col("log_prior") + F.col("size") * (F.log(F.lit(alpha)) - F.log("total")) + F.coalesce("gain", F.lit(0.0))
    return grid.join(gain, [key, label], "left").select(key, label, score.alias("score"))


def best_class(scores: DataFrame, key: str = "doc_id", label: str = "label", digits: int = 6) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.round("score", digits).desc(), label)
    return scores.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """A fold 0..k-1 of each row by hash of its key (WIN18, FLT17)."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))


def cross_validate(terms: DataFrame, labels: DataFrame, k: int = 5, *, key: str = "doc_id", label: str = "label", alpha: float = 0.0001) -> DataFrame:
    """Accuracy of naive Bayes in each fold (CLS13). What a fold learns from is
    all counts less its own, so the terms are counted once for all folds, and
    each document is scored once, by its fold's counts."""
    spark = terms.sparkSession
    parted = folds(labels, key, k)
    cells = written(terms.join(parted.select(key, "fold").distinct(), key).select(key, "fold", "term", "n"), "cells")
    known = cells.join(parted.where(F.col(label).isNotNull()).select(key, label), key)
    others = [F.sum(F.when(F.col("fold") != f, F.col("n")).otherwise(0)).alias(f"_{f}") for f in range(k)]
    counts = written(known.groupBy("term", label).agg(*others).select("term", label, F.array(*[F.col(f"_{f}") for f in range(k)]).alias("c")), "counts")
    # A row per fold and class.
    whole = counts.select(label, F.posexplode("c").alias("fold", "c")).groupBy("fold", label).agg(F.sum("c").alias("total")).where("total > 0")
    each = spark.range(k).select(F.col("id").cast("int").alias("fold"))
    rest = each.join(parted.groupBy(F.col("fold").alias("_fold"), label).agg(F.count(F.lit(1)).alias("docs")), F.col("fold") != F.col("_fold"))
    prior = rest.groupBy("fold", label).agg(F.sum("docs").alias("docs")).join(rest.groupBy("fold").agg(F.sum("docs").alias("all")), "fold")
    classes = whole.join(prior, ["fold", label]).select("fold", label, "total", F.log(F.col("docs") / F.col("all")).alias("log_prior"))
    c = F.get("c", F.col("fold"))
    gain = cells.join(counts, "term").where(c > 0).groupBy(key, label).agg(F.sum(F.col("n") * (F.log(c) - F.log(F.lit(alpha)))).alias("gain"))
    grid = cells.groupBy(key, "fold").agg(F.sum("n").alias("size")).join(F.broadcast(classes), "fold")
    score = F.col("log_prior") + F.col("size") * (F.log(F.lit(alpha)) - F.log("total")) + F.coalesce("gain", F.lit(0.0))
    guess = best_class(grid.join(gain, [key, label], "left").select(key, label, score.alias("score")), key, label).select(key, F.col(label).alias("guess"))
    right = guess.join(parted, key).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("guess") == F.col(label)).cast("double")).alias("accuracy"))
    return each.join(right, "fold", "left").select("fold", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def condensed(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 2048) -> DataFrame:
    """Prototypes by whose nearest one (cosine) every labelled row gets its
    label (CLS15). Starts with a row of each label; each round adds all rows
    that are still misread, until none is left but rows whose equal has another
    label. Rows carry the best prototype so far in a written table and meet the
    new ones only, in blocks of ``block`` that are broadcast one at a time."""
    spark = rows.sparkSession
    seen = f"{key} long, {label} {dict(rows.dtypes)[label]}, v array<double>, best double, found {dict(rows.dtypes)[label]}, chosen boolean"
    base = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).cast("long").alias(key), label, F.col(vector).cast("array<double>").alias("v")
    )
    firsts = base.groupBy(label).agg(F.min(key).alias("_first"))
    start = base.join(firsts, label).withColumn("chosen", F.col(key) == F.col("_first"))
    state = written(start.select(key, label, "v", F.lit(-2.0).alias("best"), F.col(label).alias("found"), "chosen"), "condensed")
    fresh = state.where("chosen")

    def meet(p: np.ndarray, names: np.ndarray):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    x = np.array(pdf["v"].tolist(), np.float64)
                    score = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300) @ p.T
                    at = score.argmax(1)
                    top = score[np.arange(len(x)), at]
                    nearer = top > pdf["best"].to_numpy()
                    yield pdf.assign(best=np.where(nearer, top, pdf["best"]), found=np.where(nearer, names[at], pdf["found"]))

        return run

    while True:
        held, after = [], state
        for r in fresh.orderBy(key).select("v", label).toLocalIterator():  # a block at a time on the driver
            held.append((r[0], r[1]))
            if len(held) == block:
                after, held = written(after.mapInPandas(meet(*prototypes(held)), seen), "condensed"), []
        if held:
            after = written(after.mapInPandas(meet(*prototypes(held)), seen), "condensed")
        wrong = ~F.col("chosen") & (F.col("found") != F.col(label))
        state = written(after.withColumn("_new", wrong).withColumn("chosen", F.col("chosen") | F.col("_new")), "condensed")
        fresh = state.where("_new")
        if fresh.isEmpty():
            chosen = state.where("chosen").select(F.col(key).alias("_key"))
            return rows.join(chosen, F.col(key) == F.col("_key"), "left_semi")
        state = state.drop("_new")


def prototypes(held: list) -> tuple[np.ndarray, np.ndarray]:
    p = np.array([v for v, _ in held], np.float64)
    return p / np.maximum(np.sqrt((p * p).sum(1, keepdims=True)), 1e-300), np.array([y for _, y in held])


def perceptron(rows: DataFrame, *, vector: str = "embedding", label: str = "label", epochs: int = 3) -> tuple[list, np.ndarray]:
    """Averaged multi-class perceptron (CLS10), trained on each partition and
    averaged; differs from the strict order of one machine. Returns the labels
    and the weights of each (last entry: bias)."""
    names = [r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]  # a row per label

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [(np.array(p[vector].tolist(), np.float64), p[label].to_numpy()) for p in batches if len(p)]
        if not seen:
            return
        w = total = None
        steps = 0
        for _ in range(epochs):
            for x, y in seen:
                x = np.hstack([x, np.ones((len(x), 1))])
                w = np.zeros((len(names), x.shape[1])) if w is None else w
                total = np.zeros_like(w) if total is None else total
                for v, gold in zip(x, np.searchsorted(names, y)):
                    guess = int((w @ v).argmax())
                    if guess != gold:
                        w[gold] += v
                        w[guess] -= v
                    total += w
                    steps += 1
        yield pd.DataFrame({"w": [(total / max(steps, 1)).reshape(-1).tolist()]})

    parts = rows.where(F.col(label).isNotNull()).select(vector, label).mapInPandas(train, "w array<double>")
    mean = parts.select(F.posexplode("w").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()  # labels by dimensions
    return names, np.array([r["x"] for r in mean]).reshape(len(names), -1)
