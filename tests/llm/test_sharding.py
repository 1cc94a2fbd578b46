import zlib
from collections import Counter, defaultdict

import numpy as np

from fabula.llm.sharding import digest, shuffle_into_shards, write_shards, written_shards

SCHEMA = "doc_id long, text string, shard string, slot long"


def test_law_and_slots(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = digest(shuffle_into_shards(docs, bucket_bytes=50_000)).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert sorted(by) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order) and sum(a < b for a, b in zip(order, order[1:])) < 0.7 * len(order)


def test_partitioning_does_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    place = lambda d: {r.doc_id: (r.shard, r.slot) for r in shuffle_into_shards(d, bucket_bytes=50_000).collect()}
    assert place(docs) == place(docs.repartition(5))


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, "a", 1), (None, None, "a", 1), (1, "", None, None), (1, "x" * 100_000, None, 5), (2, "é", "b", 2)]
    out = shuffle_into_shards(spark.createDataFrame(rows, SCHEMA), shards=3)
    got = digest(out).collect()
    assert sorted(r.size for r in got) == [1, 1, 1, 3, 100_001] and Counter(r.shard for r in got) == {0: 2, 1: 2, 2: 1}
    write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 5
    assert shuffle_into_shards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_a_plain_shuffle(spark):
    """Two passes over a list: scatter by Spark's hash, then shuffle each bucket."""
    rows = [(k, f"text {k} " * (k % 9), None, None) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    total, size = sum(len(r[1]) + 1 for r in rows), 1500
    buckets = -(-total // size)
    of = {r.doc_id: r.b for r in docs.selectExpr("doc_id", f"pmod(xxhash64(20240, doc_id, text), {buckets}) as b").collect()}
    line = []
    for b in range(buckets):
        own = sorted(k for k in of if of[k] == b)
        order = np.arange(len(own))
        np.random.Generator(np.random.PCG64([20240, b])).shuffle(order)
        line += [own[i] for i in order]
    got = sorted((r.shard, r.slot, r.doc_id) for r in written_shards(docs, bucket_bytes=size).collect())
    assert [d for _, _, d in got] == line and [s for s, _, _ in got] == [s for s in range(16) for _ in range(25)]
