import numpy as np

from fabula.llm import embedding_dedup
from fabula.llm.embedding_dedup import dedup, quantise, tile_links, unit

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def plain(rows, threshold=0.98):
    n = len(rows)
    ok = [r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    link = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    link[i].append(j)
    comp = [r[0] for r in rows]
    for _ in range(n):
        comp = [min([c, *(comp[j] for j in link[i])]) if link[i] else c for i, c in enumerate(comp)]
    return [(r[0], len(x), c, r[0] is not None and r[0] == c) for r, x, c in zip(rows, link, comp)]


def made(seed=0, n=300, d=12):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.normal(size=(20, d))
    for k in range(n):
        v = centres[rng.integers(20)] + rng.normal(size=d) * rng.choice([0, 0.05, 0.15, 0.3])
        rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1, 100])], int(rng.integers(3)), "x"))
    return rows


def test_links_and_classes(spark, monkeypatch):
    rows = made()
    monkeypatch.setattr(embedding_dedup, "TILE", 16)  # many tiles, cells and pivots
    got = sorted(map(tuple, dedup(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows) and sum(r[1] for r in got) > 50


def test_bound_is_rigorous():
    rng = np.random.default_rng(3)
    u = unit(rng.normal(size=(200, 40)) ** 3)
    q, s, e, length = quantise(u)
    about = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - about) <= e[:, None] * length[None, :] + e[None, :] + 1e-12).all()
    a = rng.normal(size=(50, 8))
    got = {(int(i), int(j)) for x, y in tile_links(a, a, 0.7, True) for i, j in zip(x, y)}
    c = unit(a) @ unit(a).T
    assert got == {(i, j) for i in range(50) for j in range(i + 1, 50) if c[i, j] >= 0.7}


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (3, None, 1, "a"), (4, [0.0, 0.0], 1, "a"), (5, [0.0, 0.0], 1, "a"),
        (6, [1.0, nan], 1, "a"), (7, [1.0, inf], 1, "a"), (8, [1.0, None], 1, "a"), (9, [1.0, 0.0], None, "a"), (10, [1.0], 1, "a"), (None, [1.0, 0.0], 1, "a"),
        (11, [], 1, "a"), (12, [1.0, 0.0], 2, None), (13, [-0.0, 1.0], 2, None), (14, [0.0, 1.0], 2, None), (15, [1e-30, 1e-38], 3, ""), (16, [1e30, 1e22], 3, ""),
    ]
    got = sorted(map(tuple, dedup(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted(plain(rows), key=str)
    assert dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_and_great_lengths(spark):
    rows = [
        (1, [1.0, 0.0], 1, "a"), (2, [1.0, 0.01], 1, "a"), (2, [0.01, 1.0], 1, "a"), (3, [0.0, 1.0], 1, "a"),
        (5, [1e200, 1e200], 2, "a"), (6, [1e200, 1.0001e200], 2, "a"), (7, [1e-200, 1e-200], 2, "a"), (8, [1e-200, -1e-200], 2, "a"),
    ]
    got = [tuple(r) for r in dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")).collect()]
    assert sorted(got) == [
        (1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 1, 2, False),
        (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (8, 0, 8, True),
    ]
