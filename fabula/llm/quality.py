"""Quality classifier: Bradley-Terry ranking learnt from preference pairs.

A document of label 1 is preferred to one of label 0. The score is linear in
features of the whole text; its weights minimise the logistic loss on the
feature differences of all pairs of training documents. The cut is a quantile of
the training scores: the share of label 0 among the training labels.

A pair's probability is a smooth function of two scores, so the sums over all
pairs follow from sums over rows at the points of a grid (each row is shared out
to the four points around its score, which is cubic interpolation, right to
2e-6). So work grows with the rows, not with the pairs, and what leaves a task
with the range of the scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.session import written

L2 = 1e-4
STEPS = 50
#: Step of the grid of scores; of the coarser one, for second derivatives; the
#: distance at which a preference is certain; the longest step of the weights.
STEP, COARSE, CERTAIN, LONGEST = 1 / 8, 1.0, 40, 10.0
#: Tasks of the fit, each of which sends its sums to the driver.
TASKS = 32
#: Parts of a range of scores, and scores that reach the driver, in search of the cut.
SCORES = 4096

LETTER_LOW = np.zeros(256, bool)
LETTER_LOW[97:123] = True
LETTER_UP = np.zeros(256, bool)
LETTER_UP[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
HIGH = np.zeros(256, bool)
HIGH[128:] = True
MARK = ~(LETTER_LOW | LETTER_UP | DIGIT | SPACE | HIGH)
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:?'\"-()"]] = True
BLOCK = 1 << 20

FEATURES = (
    "upper", "digit", "space", "high", "stop", "odd_mark", "doubled_mark", "lone_mark", "caps_pair", "mark_end",
    "word_length", "long_word", "log_bytes", "log_words", "log_lines", "line_words", "repeat_words", "short", "empty",
    "any_odd", "any_doubled", "any_caps", "any_lone", "repeat_lines",
)


def counts(b: np.ndarray, before: int) -> np.ndarray:
    """Countable features of a stretch of bytes; ``before`` is the byte in front."""
    prev = np.concatenate(([before], b[:-1])).astype(np.uint8)
    mark, pmark = MARK[b], MARK[prev]
    space, pspace = SPACE[b], SPACE[prev]
    return np.array(
        [
            LETTER_UP[b].sum(), DIGIT[b].sum(), space.sum(), HIGH[b].sum(), STOP[b].sum(), (mark & ~STOP[b]).sum(),
            (mark & (b == prev)).sum(), (mark & pspace).sum(), (LETTER_UP[b] & LETTER_UP[prev]).sum(), (space & pmark).sum(),
            (~space & pspace).sum(), (b == 10).sum(),
        ],
        np.float64,
    )


def features(text: str | None) -> np.ndarray:
    """The feature vector of a whole text; null is the empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    total = np.zeros(12)
    for k in range(0, len(b), BLOCK):
        total += counts(b[k : k + BLOCK], b[k - 1] if k else 32)
    n = max(len(b), 1)
    up, dig, sp, hi, stop, odd, dbl, lone, caps, end, nw, nl = total
    words = max(nw, 1)
    split = raw.split()
    distinct = len(set(split))
    long_words = sum(len(w) > 20 for w in split)
    lines = raw.split(b"\n")
    return np.array(
        [
            up / n, dig / n, sp / n, hi / n, stop / n, odd / n, dbl / n, lone / words, caps / n, end / words,
            np.log1p((n - sp) / words), long_words / words, np.log1p(len(b)), np.log1p(nw), np.log1p(nl), np.log1p(nw / (nl + 1)), 1 - distinct / words,
            float(nw < 8), float(nw == 0), np.log1p(odd), np.log1p(dbl), np.log1p(caps), np.log1p(lone), 1 - len(set(lines)) / len(lines),
        ]
    )


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the cut maps to one half."""
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.spread, -50, 50)))


def at_points(z: np.ndarray, score: np.ndarray) -> tuple[int, np.ndarray]:
    """The first point of the grid and, for it and those after it, how many rows
    are there, and their sums."""
    at = np.floor(score / STEP)
    t = score / STEP - at
    shares = (-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6)
    first = int(at.min()) - 1
    at = (at - 1 - first).astype(int)
    out = np.zeros((int(at.max()) + 4, 1 + z.shape[1]))
    for k, share in enumerate(shares):
        for c in range(out.shape[1]):
            out[:, c] += np.bincount(at + k, share * z[:, c - 1] if c else share, len(out))
    return first, out


def squares(z: np.ndarray, score: np.ndarray) -> tuple[int, np.ndarray]:
    """The same of the rows' products with themselves, on the coarser grid."""
    at = np.floor(score / COARSE)
    t, first = score / COARSE - at, int(at.min())
    order = np.argsort(at, kind="stable")
    z, t, at = z[order], t[order], at[order].astype(int) - first
    out = np.zeros((int(at[-1]) + 2, z.shape[1], z.shape[1]))
    for k in np.unique(at):
        part = slice(*np.searchsorted(at, (k, k + 1)))
        near = z[part].T @ (z[part] * t[part, None])
        out[k + 1] += near
        out[k] += z[part].T @ z[part] - near
    return first, out


Sums = dict[tuple[int, int], tuple[int, np.ndarray]]


def sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> Sums:
    """By label and kind (0: ``at_points``, 1: ``squares``)."""
    out = {}
    for label in (0, 1):
        part = z[y == label]
        if len(part):
            out[label, 0], out[label, 1] = at_points(part, part @ w), squares(part, part @ w)
    return out


def added(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    first = min(f for f, _ in parts)
    out = np.zeros((max(f + len(v) for f, v in parts) - first, *parts[0][1].shape[1:]))
    for f, v in parts:
        out[f - first : f - first + len(v)] += v
    return first, out


def met(of: np.ndarray, step: float, first: int, points: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray], beyond: bool) -> np.ndarray:
    """At each of the points ``of`` of the grid the sum of ``kernel(other - own)``
    over what is at ``points`` (numbered from ``first``); far above, that is 1
    if ``beyond``, else 0."""
    far = int(CERTAIN / step)
    k = kernel(np.arange(-far, far + 1) * step)
    size = max(int(of.max()) + far, first + len(points)) + 1
    start = min(int(of.min()) - far, first)
    line = np.zeros((size - start + 1, points.shape[1]))
    line[first - start : first - start + len(points)] = points
    out = np.stack([np.correlate(c, k, "valid") for c in line.T], axis=1)[of - far - start]
    if beyond:
        after = line.sum(0) - line.cumsum(0)
        out = out + after[of + far - start]
    return out


def preference_weights(sums_of: Callable[[np.ndarray], Sums], n: int, good: int, bad: int) -> np.ndarray:
    """Weights of the least loss over all pairs, by Newton's method. ``sums_of``
    gives the sums of all rows for weights."""
    likely = lambda d: 1 / (1 + np.exp(-np.clip(d, -50, 50)))
    slope = lambda d: likely(d) * likely(-d)

    def derivatives(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = sums_of(w)
        (f0, low), (f1, high) = s[0, 0], s[1, 0]
        at0, at1 = f0 + np.arange(len(low)), f1 + np.arange(len(high))
        # How much the pairs of a row are misjudged in sum: by the others above, and by those below.
        over = met(at1, STEP, f0, low[:, :1], likely, True)
        under = met(-at0[::-1], STEP, -f1 - len(high) + 1, high[::-1, :1], likely, True)[::-1]
        grad = (low[:, 1:].T @ under[:, 0] - high[:, 1:].T @ over[:, 0]) / good / bad + L2 * w
        cross = high[:, 1:].T @ met(at1, STEP, f0, low[:, 1:], slope, False)
        hess = -cross - cross.T
        for label, (f, mine) in ((0, (f1, high)), (1, (f0, low))):
            first, own = s[label, 1]
            points = np.arange(first, first + len(own))
            steps = round(COARSE / STEP)
            hess += np.tensordot(met(points * steps, STEP, f, mine[:, :1], slope, False)[:, 0], own, 1)
        return grad, hess / good / bad + L2 * np.eye(n)

    w = np.zeros(n)
    grad, hess = derivatives(w)
    for _ in range(STEPS):
        step = np.linalg.solve(hess, grad)
        step *= min(1, LONGEST / max(np.linalg.norm(step), 1e-300))
        before = grad @ step
        while True:
            grad, hess = derivatives(w - step)
            if grad @ step >= -0.5 * before or np.abs(step).max() < 1e-6:
                break
            step, before = step / 2, before / 2  # it went too far
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, share_of_zero: float) -> Ranker:
    """Bradley-Terry on all pairs of rows in memory, as ``train`` does it on a
    table. With one label only, no pair exists and every score is one half."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    if not good or not bad:
        return Ranker(mean, scale, np.zeros(len(FEATURES)), 0.0, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    w = preference_weights(lambda w: sums(z, y, w), z.shape[1], good, bad)
    raw = z @ w
    values, place = np.unique(raw, return_inverse=True)
    held = np.stack([np.bincount(place, y == q, len(values)) for q in (0, 1)], axis=1)
    at, inside = crossing(held, np.array([share_of_zero / bad, (1 - share_of_zero) / good]), share_of_zero)
    after = values[at + 1] if at + 1 < len(values) else None
    return Ranker(mean, scale, w, middle(values[max(at - 1, 0)], values[at], after, inside or after is None and held[at].sum() > 1), float(raw.std() + 1e-9))


def crossing(held: np.ndarray, weight: np.ndarray, share: float, below: float = 0.0) -> tuple[int, bool]:
    """Where the mass of rows (counts of each label at rising scores) reaches
    ``share``, and whether it does so before the last row there."""
    mass = held @ weight
    at = min(int(np.searchsorted(below + mass.cumsum(), share - 1e-12)), len(held) - 1)
    return at, bool(below + mass[: at + 1].sum() - weight[held[at] > 0].min(initial=np.inf) >= share - 1e-12)


def middle(before: float, here: float, after: float | None, inside: bool) -> float:
    """The cut: halfway to the next row's score; of the last, if it is the last."""
    if after is None:
        return float(here if inside else (before + here) / 2)
    return float(here if inside else (here + after) / 2)


def features_column(text: str) -> Column:
    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return vector(F.col(text))


def score_column(ranker: Ranker, x: str | Column) -> Column:
    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(np.stack(rows)) if len(rows) else [], dtype="float64")

    return score(x)


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 3, is 1. A null key counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def scores_cut(raw: DataFrame, good: int, bad: int, share: float) -> float:
    """The quantile of the rows' scores (columns _quality, raw), as ``fit`` has
    it. Scores are counted in parts of a range, and then in those of the part that
    holds the cut, until few are left."""
    weight, below = np.array([share / bad, (1 - share) / good]), 0.0
    kinds = [F.count_if(F.col("_quality") == q).cast("double") for q in (0, 1)]
    lo, hi = raw.agg(F.min("raw"), F.max("raw")).first()
    while True:
        here = raw.where(F.col("raw").between(lo, hi))
        few = here.count() <= SCORES or lo == hi
        part = F.col("raw") if few else F.floor((F.col("raw") - lo) / (hi - lo) * SCORES).cast("double")
        held = sorted(tuple(r) for r in here.groupBy(part.alias("part")).agg(F.min("raw"), F.max("raw"), *kinds).collect())  # SCORES rows at most
        counts = np.array([r[3:] for r in held])
        at, inside = crossing(counts, weight, share, below)
        if few or held[at][1] == held[at][2]:
            value = held[at][1]
            after = raw.where(F.col("raw") > value).agg(F.min("raw")).first()[0]
            before = raw.where(F.col("raw") < value).agg(F.max("raw")).first()[0]
            return middle(value if before is None else before, value, after, inside or after is None and counts[at].sum() > 1)
        below += float((counts[:at] @ weight).sum())
        lo, hi = held[at][1], held[at][2]


def vectors(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", features_column("text").alias("x"))


def train(found: DataFrame, labels: DataFrame) -> Ranker:
    """Fits on all training rows of ``found`` (``vectors``) that have a label.
    Labels other than 0 and 1 are not used; of rows that share an id the one
    with the least features counts."""
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"))
        .where("_id is not null and _quality in (0, 1)")
        .where(~held_out("_id"))
        .distinct()
    )
    share = known.agg(F.avg((F.col("_quality") == 0).cast("int"))).first()[0]
    rows = found.join(known, F.col("doc_id") == F.col("_id")).groupBy("_id", "_quality").agg(F.min("x").alias("x"))
    rows = written(rows.select(F.col("_quality").cast("int").alias("_quality"), "x"), "training")
    n = len(FEATURES)
    figures = rows.agg(*[F.count_if(F.col("_quality") == q) for q in (0, 1)], *[f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(n)]).first()
    bad, good = figures[:2]
    if not good + bad:
        return Ranker(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 1.0)
    mean, scale = np.array(figures[2 : 2 + n]), np.array(figures[2 + n :]) + 1e-9
    if not good or not bad:
        return Ranker(mean, scale, np.zeros(n), 0.0, 1.0)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            if b.num_rows:
                x = b["x"].flatten().to_numpy().reshape(-1, n)
                yield np.clip((x - mean) / scale, -8, 8), b["_quality"].to_numpy()

    def sums_of(w: np.ndarray) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Sums = {}
            for z, y in batches_of(batches):
                for k, v in sums(z, y, w).items():
                    total[k] = added([total[k], v]) if k in total else v
            columns = zip(*[(k[0], k[1], f, v.tobytes()) for k, (f, v) in total.items()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["label", "kind", "first", "sums"]) if total else pa.RecordBatch.from_pylist([], schema=pa.schema([("label", pa.int32()), ("kind", pa.int32()), ("first", pa.int64()), ("sums", pa.binary())]))

        shape = {0: (-1, 1 + n), 1: (-1, n, n)}
        parts: dict = {}
        for r in rows.coalesce(TASKS).mapInArrow(run, "label int, kind int, first long, sums binary").collect():  # four rows a task
            parts.setdefault((r["label"], r["kind"]), []).append((r["first"], np.frombuffer(r["sums"]).reshape(shape[r["kind"]])))
        return {k: added(v) for k, v in parts.items()}

    w = preference_weights(sums_of, n, good, bad)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z, y in batches_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(z @ w)], ["_quality", "raw"])

    raw = written(rows.mapInArrow(scored, "_quality int, raw double"), "scores")
    return Ranker(mean, scale, w, scores_cut(raw, good, bad, float(share)), raw.agg(F.stddev_pop("raw")).first()[0] + 1e-9)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts
    and null ids are scored too. Without labels of both kinds the score is one
    half. Repeated rows give repeated results, an empty table an empty one. A
    text of any length counts whole; other columns are not read."""
    found = written(vectors(docs), "features")
    ranker = train(found, labels)
    return found.select("doc_id", held_out().alias("held_out"), score_column(ranker, "x").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is at least one half, columns as they were,
    whatever their names. Null texts count as empty ones."""
    ranker = train(vectors(docs.where(~held_out())), labels)
    return docs.where(score_column(ranker, features_column("text")) >= 0.5)
