import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fabula.llm import katz

SCHEMA = "doc_id long, text string, other string"


def plain(rows, order=katz.ORDER):
    """A direct Katz model over Python dictionaries, by recursion on tuples."""
    toks = [((t or "").encode().lower().split() + [b"</s>"]) for _, t, _ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, *_ in rows]
    grams = {n: Counter() for n in range(1, order + 1)}
    for w, h in zip(toks, held):
        if not h:
            grams[1].update((x,) for x in w)
            line = [b"<s>", *w]
            for n in range(2, order + 1):
                grams[n].update(tuple(line[i : i + n]) for i in range(len(line) - n + 1))
    starts = grams[1][b"</s>",]

    def gt(counter):
        n = Counter(counter.values())
        k, d = katz.K, {}
        for r in range(1, k + 1):
            common = (k + 1) * n[k + 1] / n[1] if n[1] else 0
            good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[1] and n[r] and common < 1 else -1
            d[r] = good if 0 < good < 1 else (1 - (n[1] / (n[1] + 2 * n[2])) / r if n[1] else 1.0)
        return d

    d = {n: gt(grams[n]) for n in grams}
    n, v = sum(grams[1].values()), len(grams[1])
    spared1 = sum((1 - d[1].get(c, 1.0)) * c for c in grams[1].values())
    total1 = n if spared1 > 1e-9 else n + 1
    p_unk = spared1 / total1 if spared1 > 1e-9 else 1 / total1
    after = defaultdict(dict)
    for m in range(2, order + 1):
        for g, c in grams[m].items():
            after[g[:-1]][g[-1]] = c

    @lru_cache(None)
    def weight(history, spared, total):
        seen = sum(p(x, history[1:]) for x in after[history])
        return (spared if spared > 1e-9 else 1) / total / (1 - seen)

    @lru_cache(None)
    def p(w, history):
        if not history:
            c = grams[1][w,]
            return d[1].get(c, 1.0) * c / total1 if c else p_unk
        ch = starts if history == (b"<s>",) else grams[len(history)][history]
        if not ch:
            return p(w, history[1:])
        dn = d[len(history) + 1]
        spared = sum((1 - dn.get(c, 1.0)) * c for c in after[history].values())
        total = ch if spared > 1e-9 else ch + 1
        if w in after[history]:
            return dn.get(after[history][w], 1.0) * after[history][w] / total
        return weight(history, spared, total) * p(w, history[1:])

    out = []
    for (i, *_), w, h in zip(rows, toks, held):
        base = sum(math.log10((grams[1][x,] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        line = [b"<s>", *w]
        score = sum(math.log10(p(w[j], tuple(line[max(0, j + 2 - order) : j + 1]))) for j in range(len(w)))
        out.append((i, h, len(w), sum(grams[1][x,] > 0 for x in w), n, base, score))
    histories = [x for x in after if x[-1] != b"</s>"][:: max(1, len(after) // 60)]
    mass = [sum(p(w, x) for (w,) in grams[1]) + p(b"never seen", x) for x in histories]
    return out, mass


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


def test_against_plain_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, "") for r in docs.collect()]
    want, mass = plain(rows)
    model, got = katz.train_and_score(docs, chunk=20_000, hot=50, bucket_bytes=150_000)  # frequent histories lie in several buckets
    same(got.collect(), want)
    for n in (2, 3):  # the stored tables hold the same model
        weights, seen = model.weights(n), model.ngrams(n).groupBy("history").agg(F.sum("discounted").alias("mass"))
        wrong = weights.join(seen, "history", "full").where("mass is null or left_over is null or abs(mass / total + left_over - 1) > 1e-9")
        assert weights.count() > 1000 and wrong.isEmpty()
    assert model.vocabulary().agg(F.sum("count")).first()[0] == want[0][4]
    assert mass == pytest.approx([1.0] * len(mass))
    better = [w for w in want if w[1] and w[2] > 20]
    assert sum(w[6] for w in better) > sum(w[5] for w in better)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b a b", "x"), (4, "a b a b", "x"), (4, "a b a b", "x"), (7, "a " * 3000, None), (9, " \t\n ", None)]
    got = katz.score_documents(spark.createDataFrame(rows, SCHEMA), chunk=100).collect()
    want, mass = plain(rows)
    same(got, want)
    assert mass == pytest.approx([1.0] * len(mass))


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders(spark, sf, order):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = [(r.doc_id, r.text, "") for r in docs.collect()]
    want, mass = plain(rows, order)
    same(katz.score_documents(spark.createDataFrame(rows, SCHEMA), order=order, chunk=9000, bucket_bytes=90_000).collect(), want)
    assert mass == pytest.approx([1.0] * len(mass))


def test_empty_and_untrained(spark):
    assert katz.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    only_held = [(i, "a b", "") for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = katz.score_documents(spark.createDataFrame(only_held, SCHEMA)).collect()
    assert [r.n_known for r in got] == [0, 0, 0] and all(math.isfinite(r.score) for r in got)


def test_blobs_are_read_and_written_one_by_one(spark, sf, monkeypatch):
    """Nothing holds a batch of chunks: reader, Arrow, row groups and pages."""
    seen, before = [], {name: spark.conf.get(name) for name in katz.ONE_ROW}
    with katz.chunk_by_chunk(spark):
        assert {spark.conf.get(name) for name in katz.ONE_ROW} == {"1"}
    assert {name: spark.conf.get(name) for name in katz.ONE_ROW} == before
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 997}" for k in range(400)), "") for i in range(120)], SCHEMA)
    monkeypatch.setitem(katz.BLOBS, "parquet.block.size", "1024")
    model, _ = katz.train_and_score(docs, chunk=400, bucket_bytes=60_000)
    for f in model.tables[2].inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
        seen += [g.num_rows for g in groups]
        assert {g.column(0).compression for g in groups} <= {"UNCOMPRESSED"}  # packed once already
    assert seen and max(seen) <= 2
