"""Hard negatives for anchors, by candidate lists that a cluster shares.

Anchors are clustered by direction. For a cluster, every candidate has one
upper bound that holds for all members: the angle between member and candidate
is at least the candidate's angle to the centre less the cluster's radius. A
list of candidates is sorted by that bound once, and each member walks it until
its bound, times the member's length, is below what the member still needs.

Candidates lie in cells around the same centres, large cells in tiles; a pack
of anchors meets a tile only if a cluster of the pack can need something of it.
Each search has two turns: the tiles at home, whose finds say how much an
anchor needs, and all other tiles that can hold as much.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from fabula.session import written

UNIT = 256
#: Rows of a tile, and anchors of a pack, on average at most.
TILE = 8192
PACK = 4096
#: Bounds of the clustering: anchors that it sees, and clusters.
SAMPLE = 4096
MAX_CLUSTERS = 256
ROUNDS = 6
#: Rows first walked; each further stretch is twice as long.
STRETCH = 256
#: Slack for the rounding of angles.
SLACK = 1e-6
#: Squared length from which a vector takes no part: a hundred times an inner
#: product must fit a long.
TOO_LONG = 2.0**55


def usable(key: str, vector: str, label: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))


@F.pandas_udf(BinaryType())
def as_integers(vectors: pd.Series) -> pd.Series:
    """floor(UNIT * x) of each component as int32; null for vectors that are TOO_LONG."""
    out = []
    for v in vectors:
        q = np.floor(np.asarray(v, np.float64) * UNIT)
        out.append(q.astype("<i4").tobytes() if float(np.square(q).sum()) < TOO_LONG else None)
    return pd.Series(out, dtype=object)


def matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), dim).astype(np.float64)


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of each row to each centre; that of a zero vector is 0."""
    length = np.sqrt(np.square(x).sum(1, keepdims=True))
    return np.arccos(np.clip(np.divide(x @ centres.T, length, out=np.ones((len(x), len(centres))), where=length > 0), -1, 1))


def clusters(x: np.ndarray, k: int, seed: int = 13) -> np.ndarray:
    """Unit vectors: centres of spherical k-means over the rows of ``x``."""
    x = x[np.abs(x).max(axis=1, initial=0) > 0]
    if not len(x):
        return np.zeros((0, x.shape[1]))
    u = x / np.sqrt(np.square(x).sum(1, keepdims=True))
    centres = u[np.random.default_rng(seed).permutation(len(u))[:k]]
    for _ in range(ROUNDS):
        own = (u @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, u)
        length = np.sqrt(np.square(sums).sum(1))
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centres)
    return centres


class Best:
    """The k best (score, smaller id first) of each anchor and slot so far."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.score = np.full((anchors, slots, k), -np.inf)
        self.id = np.zeros((anchors, slots, k), np.int64)

    def take(self, rows: np.ndarray, slot: int, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[2]
        least = self.score[rows, slot, -1]
        hit = fits & (scores >= least[:, None])
        for n in np.flatnonzero(hit.any(1)).tolist():
            r, at = rows[n], np.flatnonzero(hit[n])
            s = np.concatenate((self.score[r, slot], scores[n, at]))
            i = np.concatenate((self.id[r, slot], ids[at]))
            best = np.lexsort((i, -s))[:k]
            self.score[r, slot], self.id[r, slot] = s[best], i[best]


def walk(q: pd.DataFrame, c: pd.DataFrame, centre: np.ndarray, k: int, same: bool) -> pd.DataFrame:
    """Finds of one cluster's anchors ``q`` in one tile ``c``: for each slot of
    an anchor the k best candidates with low <= score <= high, of the anchor's
    label or (not same) of another one, that are at least its ``need``."""
    dim = len(centre)
    x, y = matrix(q["v"], dim), matrix(c["v"], dim)
    length_q, length_c = np.sqrt(np.square(x).sum(1)), np.sqrt(np.square(y).sum(1))
    away = np.maximum(angles(y, centre[None, :])[:, 0] - q["angle"].max(), 0)
    bound = length_c * (np.cos(away) + SLACK) + SLACK
    order = np.lexsort((c["id"].to_numpy(), -bound))
    y, bound, ids, labels = y[order], bound[order], c["id"].to_numpy()[order], c["label"].to_numpy()[order]
    wide = length_q.max() * length_c.max(initial=0) >= 2.0**53
    if wide:
        x, y = x.astype(np.int64), y.astype(np.int64)
    own_id, own_label = q["id"].to_numpy(), q["label"].to_numpy()
    low, high, need = (np.array(q[n].tolist(), np.float64 if n == "need" else np.int64).reshape(len(q), -1) for n in ("low", "high", "need"))
    best = Best(len(q), low.shape[1], k)
    at, step = 0, STRETCH
    walking = np.arange(len(q))
    while at < len(y):
        wants = np.maximum(need[walking], best.score[walking, :, -1]).min(1)
        walking = walking[length_q[walking] * bound[at] >= wants]
        if not len(walking):
            break
        part = slice(at, at + step)
        scores = x[walking] @ y[part].T
        fits = (own_label[walking, None] == labels[None, part]) == same
        fits &= own_id[walking, None] != ids[None, part]
        for s in range(low.shape[1]):
            inside = fits & (scores >= low[walking, s, None]) & (scores <= high[walking, s, None]) & (scores >= need[walking, s, None])
            best.take(walking, s, scores, inside, ids[part])
        at, step = at + step, step * 2
    row, slot, place = np.nonzero(best.score > -np.inf)
    return pd.DataFrame({"rid": q["rid"].to_numpy()[row], "slot": slot.astype(np.int32), "id": best.id[row, slot, place], "score": best.score[row, slot, place].astype(np.int64)})


class Space:
    """Stored anchors and candidates, and what holds for their cells."""

    def __init__(self, rows: DataFrame, anchor: Column, copies: int):
        """rows: id, label, v (bytes), dim; all distinct. Of the candidates
        that are equal in label and vector the ``copies`` with the least ids
        are kept: no search returns more than that of one anchor's score."""
        spark = rows.sparkSession
        rows = written(rows, "rows")
        # Spark cuts the ranks of a class in each task before it deals out rows.
        least = rows.withColumn("copy", F.row_number().over(Window.partitionBy("dim", "label", "v").orderBy("id"))).where(F.col("copy") <= copies)
        both = least.drop("copy").withColumn("is_anchor", F.lit(False)).union(rows.where(anchor).withColumn("is_anchor", F.lit(True)))
        stored = written(both.withColumn("rid", F.monotonically_increasing_id()), "vectors")
        anchors = stored.where("is_anchor")
        seen = anchors.orderBy(F.xxhash64("id", F.lit(5)), "id", "rid").select("v", "dim").limit(SAMPLE).toPandas()
        total = anchors.count()
        k = max(1, min(MAX_CLUSTERS, math.isqrt(total)))
        centres = {int(d): clusters(matrix(g["v"], int(d)), k) for d, g in seen.groupby("dim")}

        def of(dim: int) -> np.ndarray:
            found = centres.get(dim)
            return found if found is not None and len(found) else np.eye(1, max(dim, 1))[:, :dim]

        self.of, self.spark = of, spark

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dim, g in pdf.groupby("dim"):
                    x = matrix(g["v"], int(dim))
                    ang = angles(x, of(int(dim)))
                    cell = ang.argmin(1)
                    yield g.assign(cell=cell.astype(np.int32), angle=ang[np.arange(len(g)), cell], length=np.sqrt(np.square(x).sum(1)))

        columns = "rid long, id long, label long, dim int, v binary, is_anchor boolean"
        self.placed = written(stored.select(*[c.split()[0] for c in columns.split(", ")]).mapInPandas(place, f"{columns}, cell int, angle double, length double"), "placed")
        #: A row for each width and cluster at most, whatever the number of rows.
        stats = self.placed.groupBy("dim", "cell").agg(
            F.count(F.when(~F.col("is_anchor"), 1)).alias("n"), F.count(F.when(F.col("is_anchor"), 1)).alias("anchors"),
            F.max("angle").alias("radius"), F.max("length").alias("length"),
        ).orderBy("dim", "cell").collect()
        self.cells: dict[int, list[tuple[int, int, float, float]]] = {}
        packs, many, pack, room, last = {}, {}, -1, 0, None
        for r in stats:
            key = (r["dim"], r["cell"])
            if r["n"]:
                self.cells.setdefault(r["dim"], []).append((r["cell"], -(-r["n"] // TILE), r["radius"], r["length"]))
            if not r["anchors"]:
                continue
            if r["anchors"] > room or r["dim"] != last:
                pack, room, last = pack + 1, PACK, r["dim"]
            packs[key], many[key] = pack, -(-r["anchors"] // PACK)
            room -= r["anchors"]
            pack += many[key] - 1
        where = spark.createDataFrame([(*k, p, many[k]) for k, p in packs.items()], "dim int, cell int, pack int, packs int")
        tiles = spark.createDataFrame([(d, c, t) for d, cs in self.cells.items() for c, t, _, _ in cs], "dim int, cell int, tiles int")
        spread = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30))
        # Both small tables have a row for each cell: MAX_CLUSTERS for a width.
        self.anchors = self.placed.where("is_anchor").join(F.broadcast(where), ["dim", "cell"]).select(
            "rid", "id", "label", "dim", "v", "angle", "length", F.col("cell").alias("home"), (F.col("pack") + spread % F.col("packs")).cast("int").alias("pack")
        )
        self.candidates = self.placed.where("not is_anchor").join(F.broadcast(tiles), ["dim", "cell"]).select(
            "dim", "cell", (spread % F.col("tiles")).cast("int").alias("tile"), "id", "label", "v"
        )

    def meet(self, anchors: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
        """Finds of all anchors in the tiles that ``pairs`` (dim, pack, cell,
        tile) gives their pack."""
        of = self.of

        def run(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            found = [walk(part, c, of(int(key[0]))[int(home)], k, same) for home, part in q.groupby("home")] if len(c) else []
            return pd.concat(found) if found else pd.DataFrame({"rid": [], "slot": [], "id": [], "score": []}, dtype=np.int64)

        by = ["dim", "pack", "cell", "tile"]
        left = anchors.join(pairs, ["dim", "pack"]).groupBy(*by)
        right = self.candidates.join(pairs, ["dim", "cell", "tile"]).groupBy(*by)
        return left.cogroup(right).applyInPandas(run, "rid long, slot int, id long, score long")

    def in_reach(self, anchors: DataFrame) -> DataFrame:
        """The tiles of which a cluster of a pack can need something: its bound
        for the whole cell is at least the least need of a member."""
        needs = F.array_min("need")
        ratio = F.when(F.col("length") > 0, needs / F.col("length")).otherwise(F.when(needs <= 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        groups = anchors.groupBy("dim", "pack", "home").agg(F.max("angle").alias("radius"), F.min(ratio).alias("ratio"))
        of, cells = self.of, self.cells

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for g in pdf.itertuples(index=False):
                    there = cells.get(g.dim, [])
                    centre = of(g.dim)
                    apart = np.arccos(np.clip(centre @ centre[g.home], -1, 1))
                    found = [
                        (g.dim, g.pack, c, t)
                        for c, tiles, radius, length in there
                        if length * (math.cos(max(apart[c] - g.radius - radius - SLACK, 0.0)) + 2 * SLACK) + SLACK >= g.ratio
                        for t in range(tiles)
                    ]
                    yield pd.DataFrame(found, columns=["dim", "pack", "cell", "tile"])

        return groups.mapInPandas(run, "dim int, pack int, cell int, tile int").distinct()

    def search(self, wanted: DataFrame, k: int, same: bool) -> DataFrame:
        """rid, slot, id, score and rank of the k best candidates of each slot.
        ``wanted``: rid and the arrays low and high, a slot for each entry."""
        asked = written(self.anchors.join(wanted, "rid"), "asked")
        floor = lambda s: F.when(F.get("low", s) > F.get("high", s), F.lit(float("inf"))).otherwise(F.get("low", s).cast("double"))
        low = asked.withColumn("need", F.transform("low", lambda x, s: floor(s)))
        home = written(low.select("dim", "pack", F.col("home").alias("cell"), F.lit(0).alias("tile")).distinct(), "pairs")
        near = written(self.meet(low, home, k, same), "near")
        best = Window.partitionBy("rid", "slot").orderBy(F.desc("score"), "id")
        # The k-th find at home is the least that a slot can still use.
        kth = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
        needs = written(
            asked.join(kth, "rid", "left").withColumn(
                "need", F.transform("low", lambda x, s: F.coalesce(F.try_element_at("kth", s).cast("double"), floor(s)))
            ).drop("kth"),
            "needs",
        )
        rest = written(self.in_reach(needs).join(home, ["dim", "pack", "cell", "tile"], "left_anti"), "pairs")
        far = written(self.meet(needs, rest, k, same), "far")
        return near.union(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the vectors' integers, floor(256 * x). An
    anchor is a row for which ``anchor`` (an expression over ``key``) holds; its
    positives are the best other rows of its label, and for each positive the
    negatives are the best rows of other labels whose score lies between low
    and high percent of the positive's. Ties go to the smaller id.

    Rows with a null key, label, vector or component, with a component that is
    not finite, or with a squared length of 2**55 or more (scores could leave
    the range of a long) take no part. Vectors of different width have no
    score. Rows equal in key, label and vector count once; rows that share
    only the key are rows of their own, but never positives or negatives of an
    anchor of that key. An empty table, or one without anchors, gives an empty
    result; other columns are not read.
    """
    rows = (
        vectors.where(usable(key, vector, label))
        .select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.size(vector).cast("int").alias("dim"), as_integers(F.col(vector).cast("array<double>")).alias("v"))
        .where("v is not null")
        .distinct()
    )
    space = Space(rows, anchor, max(positives + 1, negatives + 1))
    most = 1 << 62
    everyone = space.anchors.select("rid", F.array(F.lit(-most)).alias("low"), F.array(F.lit(most)).alias("high"))
    found = written(space.search(everyone, positives, True).select("rid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot")), "positives")
    # Whole percents of longs, rounded inwards; a slot that nothing fits has low > high.
    bounds = F.struct("slot", F.expr(f"-(({-low} * positive_score - pmod({-low} * positive_score, 100)) div 100)").alias("low"), F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100").alias("high"))
    slots = found.groupBy("rid").agg(F.sort_array(F.collect_list(bounds)).alias("slots"))  # ``positives`` at most
    places = F.sequence(F.lit(0), F.lit(positives - 1))

    def padded(name: str, none: int) -> Column:
        return F.transform(places, lambda k: F.coalesce(F.get("slots", k)[name], F.lit(none).cast("long"))).alias(name)

    wanted = slots.select("rid", padded("low", 1), padded("high", 0))
    worse = space.search(wanted, negatives, False).select("rid", "slot", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = space.anchors.select("rid", F.col("id").alias("anchor_id"))
    return worse.join(found, ["rid", "slot"]).join(names, "rid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def digest(vectors: DataFrame) -> DataFrame:
    """The registered query: every 50th vector is an anchor, every 7th has the
    next label."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", turned.alias("label")), F.col("id") % 50 == 0)


SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
