"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors of one label are dealt into cells around shared pivots, cells into
tiles. By the triangle inequality for angles a vector is sent only to cells
that may hold a vector within the threshold's angle. For two tiles the int8
product and a rigorous bound on its error decide which pairs can reach the
threshold; only these are computed again in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.simhash import spanning
from fabula.operators.components import connected_components
from fabula.session import written

TILE = 2048
MAX_PIVOTS = 64
ROWS = 512
#: Slack for rounding in double precision.
SLACK = 1e-9


def usable(vector: str, label: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(
        F.col(label).isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False)
    )


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest entry, so that the
    squares neither overflow nor vanish."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, scale, length of the error, length of the
    coded vector. |u.v - s_u s_v q_u.q_v| <= err_u * len_v + err_v, because
    u.v = (u - e_u).(v - e_v) + e_u.(v - e_v) + u.e_v."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt(((u - back) ** 2).sum(1)), np.sqrt((back**2).sum(1))


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with a cosine of at least ``threshold``; same: a is b, i < j."""
    ua, ub = unit(a), unit(b)
    qa, sa, ea, _ = quantise(ua)
    qb, sb, eb, lb = quantise(ub)
    # Sums of int8 products are exact in float32 up to 2**24.
    exact = np.float32 if a.shape[1] <= 1024 else np.float64
    right = qb.astype(exact).T
    for k in range(0, len(a), ROWS):
        rows = slice(k, k + ROWS)
        about = (qa[rows].astype(exact) @ right).astype(np.float64) * sa[rows, None] * sb[None, :]
        bound = ea[rows, None] * lb[None, :] + eb[None, :] + SLACK
        i, j = np.nonzero(about + bound >= threshold)
        i = i + k
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for m in range(0, len(i), 1 << 16):
            x, y = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
            near = cosine(a[x], b[y]) >= threshold
            if near.any():
                yield x[near], y[near]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest entry near one,
    which changes no cosine and keeps squares from overflowing or vanishing."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = scaled(x), scaled(y)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def dedup(vectors: DataFrame, *, vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two rows link if their labels are equal and their cosine is at least the
    threshold. Rows without a label or id and vectors that are null, empty,
    zero or hold null or non-finite entries link with nothing, nor do vectors
    of different length. Every other row counts, so a repeated row is a copy
    that links with the first. Equal vectors are compared once and counted by
    their number; rows that share an id are rows of their own. component_id is
    null, and kept false, for a null id. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = usable("v", "label")
    # A class of equal vectors has a number of its own, as ids may be repeated.
    # Vectors travel as bytes, in single precision where they came in it.
    single = dict(vectors.dtypes)[vector] == "array<float>"
    width = np.dtype("<f4" if single else "<f8")

    @F.pandas_udf("binary")
    def as_bytes(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, width).tobytes() for x in v], dtype=object)

    def matrix(blobs) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), width).reshape(len(blobs), -1)

    alike = rows.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    stored = written(alike.select("label", F.col("v").alias("_v"), "least", "n", F.size("v").alias("dim"), as_bytes("v").alias("v"), F.monotonically_increasing_id().alias("id")), "vectors")
    classes = stored.drop("_v", "least")
    pivots = [r["v"] for r in stored.orderBy(F.xxhash64("least"), "least", "_v").select("v").limit(MAX_PIVOTS).collect()]
    # Small tables are written before they are joined: both sides then are plain
    # shuffles, and Spark splits the rows of a label that holds most of them.
    sizes = written(classes.groupBy("label", "dim").agg(F.least(F.ceil(F.count(F.lit(1)) / TILE), F.lit(MAX_PIVOTS)).cast("int").alias("k")), "sizes")
    reach = math.acos(min(1.0, threshold)) + 1e-6

    def angles(dim: int, k: int, x: np.ndarray) -> np.ndarray:
        chosen = [p for p in pivots if len(p) == dim * width.itemsize][: max(k, 1)]
        if k <= 1 or not chosen:
            return np.zeros((len(x), 1))
        return np.arccos(np.clip(unit(x) @ unit(matrix(chosen)).T, -1, 1))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (dim, k), g in pdf.groupby(["dim", "k"]):
                ang = angles(dim, k, matrix(g["v"].tolist()))
                cell = ang.argmin(1)
                yield g.assign(cell=cell.astype(np.int32), angle=ang[np.arange(len(g)), cell])

    placed = written(
        classes.join(sizes, ["label", "dim"]).mapInPandas(
            place, "label int, dim int, v binary, id long, n long, k int, cell int, angle double"
        )
        if dict(classes.dtypes)["label"] == "int"
        else classes.withColumn("label", F.col("label").cast("string"))
        .join(sizes.withColumn("label", F.col("label").cast("string")), ["label", "dim"])
        .mapInPandas(place, "label string, dim int, v binary, id long, n long, k int, cell int, angle double"),
        "placed",
    )
    cells = written(
        placed.groupBy("label", "dim", "cell")
        .agg(F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
        .groupBy("label", "dim")
        .agg(F.array_sort(F.collect_list(F.struct("cell", "radius", "tiles"))).alias("cells")),  # MAX_PIVOTS at most
        "cells",
    )

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (_, dim, k), g in pdf.groupby(["label", "dim", "k"]):
                info = [(int(c["cell"]), float(c["radius"]), int(c["tiles"])) for c in g["cells"].iloc[0]]
                ang = angles(dim, k, matrix(g["v"].tolist()))
                tiles = {c: t for c, _, t in info}
                own = np.array([h % tiles[c] for h, c in zip(g["h"], g["cell"])])
                mine = g["cell"].to_numpy().astype(np.int64) << 32 | own
                for c, radius, many in info:
                    may = np.flatnonzero((ang[:, c] <= radius + reach) | (g["cell"].to_numpy() == c))
                    for t in range(many):
                        other = np.int64(c) << 32 | t
                        if len(may):
                            part = g.iloc[may]
                            yield pd.DataFrame(
                                {
                                    "label": part["label"], "dim": part["dim"], "lo": np.minimum(mine[may], other), "hi": np.maximum(mine[may], other),
                                    "own": mine[may], "id": part["id"], "n": part["n"], "v": part["v"],
                                }
                            )

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        same = key[2] == key[3]
        left = pdf if same else pdf[pdf["own"] == key[2]]
        right = left if same else pdf[pdf["own"] == key[3]]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        a, b = matrix(left["v"].tolist()), matrix(right["v"].tolist())
        ids = left["id"].to_numpy() if same else np.concatenate([left["id"], right["id"]])
        copies = left["n"].to_numpy() if same else np.concatenate([left["n"], right["n"]])
        links = np.zeros(len(ids), np.int64)
        shift = 0 if same else len(a)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in tile_links(a, b, threshold, same):
                np.add.at(links, i, copies[j + shift])
                np.add.at(links, j + shift, copies[i])
                yield i, j + shift

        root = spanning(len(ids), pairs())
        at = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[at], "links": links[at], "root": ids[root[at]]})

    kind = dict(placed.dtypes)["label"]
    found = written(
        placed.join(cells, ["label", "dim"])
        .withColumn("h", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)))
        .select("label", "dim", "k", "v", "id", "n", "cell", "h", "cells")
        .mapInPandas(deal, f"label {kind}, dim int, lo long, hi long, own long, id long, n long, v binary")
        .groupBy("label", "dim", "lo", "hi")
        .applyInPandas(compare, "id long, links long, root long"),
        "links",
    )
    parts = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = written(stored.join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id")), "classes")
    heads = linked.groupBy("part").agg(F.min("least").alias("_component"))
    of_class = written(
        linked.join(heads, "part").select(
            F.col("label").alias("_label"), "_v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), "_component"
        ),
        "components",
    )
    keyed = rows.withColumn("_good", good)
    return keyed.join(of_class, F.col("_good") & (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left").select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("_component", "vec_id"), F.lit(False)).alias("kept"),
    )
