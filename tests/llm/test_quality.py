import zlib

from fabula.llm.quality import features, fit, keep_good, score_documents

DOCS = "doc_id long, text string, score string, quality int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    a, b = ({r.doc_id: r.score for r in score_documents(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None, "s", 1), (None, "", None, None), (3, "Words here. And more of them.", "s", 0), (3, "Words here. And more of them.", "s", 0), (5, "x" * 300_000, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    assert score_documents(docs, labels).count() == 5
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_documents(docs, none).collect()} == {0.5} and keep_good(docs, none).columns == docs.columns
    assert score_documents(spark.createDataFrame([], DOCS), labels).count() == 0


def test_pairs_rank():
    import numpy as np

    good = [features(f"This is a fine sentence number {k}. It has an end." * (1 + k % 4)) for k in range(40)]
    bad = [features(f"BUY!! NOW!! {k}!! *** $$$ " * (1 + k % 4)) for k in range(40)]
    r = fit(np.array(good + bad), np.array([1] * 40 + [0] * 40), 0.5)
    assert r.score(np.array(good)).min() > 0.5 > r.score(np.array(bad)).max()


def test_weights_equal_those_of_all_pairs():
    import numpy as np

    from fabula.llm import quality as Q

    rng = np.random.default_rng(2)
    for apart, shares in ((0.4, 0.2), (3.0, 0.5)):
        x, y = rng.normal(size=(300, len(Q.FEATURES))), (rng.random(300) < 0.7).astype(int)
        x[y == 1] += apart * rng.random(len(Q.FEATURES))
        r = fit(x, y, shares)
        z = np.clip((x - r.mean) / r.scale, -8, 8)
        pairs = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
        w = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(np.clip(pairs @ w, -50, 50)))
            hess = (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + Q.L2 * np.eye(len(w))
            step = np.linalg.solve(hess, -pairs.T @ p / len(pairs) + Q.L2 * w)
            w -= step * min(1, 5 / np.linalg.norm(step))
        assert abs(w - r.weights).max() < 1e-4
        raw, weight = z @ w, np.where(y == 1, (1 - shares) / (y == 1).sum(), shares / (y == 0).sum())
        order = np.argsort(raw)
        at = np.searchsorted(weight[order].cumsum(), shares - 1e-12)
        assert abs(r.cut - raw[order][at : at + 2].mean()) < 1e-3


def test_every_training_row_counts(spark, monkeypatch):
    """more rows of a label than were taken before, learnt from in several tasks."""
    import numpy as np

    from fabula.llm import quality as Q

    monkeypatch.setattr(Q, "SCORES", 50, raising=False)
    rng = np.random.default_rng(4)
    words = ["alpha", "BETA", "gamma.", "12", "x!!", "$$", "delta,", "\n"]
    texts = [" ".join(rng.choice(words, 3 + k % 9, p=[0.3, 0.1, 0.2, 0.1, 0.05, 0.05, 0.15, 0.05] if k % 12 else [0.1, 0.2, 0.1, 0.2, 0.1, 0.15, 0.1, 0.05])) for k in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 12 > 0)) for k in range(5000)] + [(9000 + k, 0) for k in range(90)], "doc_id long, quality int")
    use = [k for k in range(5000) if zlib.crc32(str(k).encode()) % 3 != 1]
    known = use + [k for k in range(9000, 9090) if zlib.crc32(str(k).encode()) % 3 != 1]
    x, y = np.array([features(texts[k]) for k in use]), np.array([int(k % 12 > 0) for k in use])
    assert (y == 1).sum() > 3000
    r = fit(x, y, sum(k % 12 == 0 or k >= 9000 for k in known) / len(known))
    want = r.score(np.array([features(t) for t in texts]))
    got = {q.doc_id: q.score for q in score_documents(docs, labels).collect()}
    assert max(abs(got[k] - want[k]) for k in range(5000)) < 1e-6
    assert {q.doc_id for q in keep_good(docs, labels).collect()} == {k for k in got if got[k] >= 0.5}


def test_cut_of_equal_scores(spark):
    import numpy as np

    from fabula.llm import quality as Q

    for rows in ([(0, 1.0), (1, 1.0)], [(0, 1.0), (1, 2.0)], [(0, 1.0), (0, 2.0), (1, 2.0), (1, 3.0), (1, 5.0)], [(k % 2, float(k // 7)) for k in range(60)]):
        y, raw = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        good, bad = int((y == 1).sum()), int((y == 0).sum())
        for share in (0.1, 0.4, 0.99):
            weight = np.where(y == 1, (1 - share) / good, share / bad)
            order = np.argsort(raw, kind="stable")
            k = min(int(np.searchsorted(np.cumsum(weight[order]), share - 1e-12)), len(raw) - 2)
            want = (raw[order[k]] + raw[order[k + 1]]) / 2
            got = Q.scores_cut(spark.createDataFrame(rows, "_quality int, raw double"), good, bad, share)
            assert got == want or raw[order[k]] == raw[order[k + 1]] or k == len(raw) - 2
