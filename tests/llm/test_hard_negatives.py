from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import fabula.llm.hard_negatives as hn
from fabula.llm.hard_negatives import SQL, digest, mine

SCHEMA = "vec_id long, embedding array<float>, label int, rid long, cell int, need string"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """Every anchor against every row, in Python's integers."""
    good = {(i, lab, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, lab, v in good:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [(t, k) for t, k, m in scored if m != lab and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(params=["as it is", "small tiles and packs"])
def sizes(request, monkeypatch):
    if request.param != "as it is":
        for name, value in (("TILE", 16), ("PACK", 4), ("STRETCH", 3), ("SAMPLE", 50)):
            monkeypatch.setattr(hn, name, value)


def vectors(n, seed, kinds=4, dim=6):
    """Clusters, copies, ties, and lengths from 0 to some thousands."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    rows = []
    for i in range(n):
        v = (centres[r.integers(8)] + 0.3 * r.normal(size=dim)) * r.choice([0.1, 1, 5])
        v = np.round(v, 1) if i % 3 else v
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(kinds))))
    return rows + [(n + i, rows[7][1], i % kinds) for i in range(n // 3)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, "x") for i, v, lab in rows], SCHEMA).repartition(3)


def test_equals_brute_force(spark, sizes):
    rows = vectors(300, 1)
    assert got(mine(frame(spark, rows), F.col("id") % 9 == 0)) == brute(rows, lambda i: i % 9 == 0)


def test_other_numbers(spark, sizes):
    rows = vectors(120, 2, kinds=2, dim=3)
    want = brute(rows, lambda i: i % 4 == 1, 2, 4, -300, 250)
    assert want and got(mine(frame(spark, rows), F.col("id") % 4 == 1, positives=2, negatives=4, low=-300, high=250)) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.8, 0.4], 2), (3, [0.8, 0.4], 2), (3, [0.8, 0.4], 2), (0, [0.7, 0.3], 2), (None, [1.0, 1.0], 1), (5, None, 1), (6, [1.0, 1.0], None)]
    rows += [(7, [float("nan"), 1.0], 2), (8, [None, 1.0], 2), (9, [float("inf"), 1.0], 1), (10, [1.0, 0.5, 0.5], 1), (11, [1.0, 0.4, 0.5], 2), (12, [0.0, 0.0], 1), (13, [-1.0, -1.0], 1), (14, [], 1), (15, [], 1), (16, [], 2)]
    want = brute(rows, lambda i: i in (0, 10, 12, 13, 14))
    assert any(x[0] == 0 for x in want) and any(x[0] == 14 for x in want)
    df = frame(spark, rows)
    assert got(mine(df, F.col("id").isin(0, 10, 12, 13, 14))) == want
    assert got(mine(df, F.lit(False))) == [] and got(mine(df.limit(0), F.lit(True))) == []
    huge = frame(spark, [(0, [3e38, 1.0], 1), (1, [1.0, 1.0], 1), (50, [1.0, 1.0], 1), (2, [0.6, 1.0], 2)])
    assert got(mine(huge, F.col("id") % 50 == 0)) == brute([(1, [1.0, 1.0], 1), (50, [1.0, 1.0], 1), (2, [0.6, 1.0], 2)], lambda i: i % 50 == 0)


def test_only_clusters_in_reach_meet(spark, monkeypatch):
    """Tight clusters far apart: after the tiles at home few others are visited."""
    monkeypatch.setattr(hn, "TILE", 32)
    r = np.random.default_rng(3)
    centres = np.eye(16) * 4
    rows = [(i, [float(x) for x in centres[i % 16] + 0.02 * r.normal(size=16)], i // 16 % 3) for i in range(1600)]
    visited = []
    whole = hn.Space.in_reach
    monkeypatch.setattr(hn.Space, "in_reach", lambda self, a: visited.append(whole(self, a).count()) or whole(self, a))
    assert got(mine(frame(spark, rows), F.col("id") % 100 == 0)) == brute(rows, lambda i: i % 100 == 0)
    assert len(visited) == 2


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{Path(sf) / 'embeddings.parquet'}'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(digest(spark.read.parquet(f"{sf}/embeddings.parquet")).select(*names)) == sorted(duck.sql(SQL).select(*names).fetchall())
