import zlib

import numpy as np

from fabula.llm.training_order import END_ID, byte_bpe, feistel, materialise, read_from

DOCS = "doc_id long, text string, slot int, ids string"


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        out = feistel(np.arange(n), n, 5)
        assert sorted(out.tolist()) == list(range(n))
        assert (feistel(out, n, 5, inverse=True) == np.arange(n)).all()
    assert (feistel(np.arange(1000), 1000, 5) != feistel(np.arange(1000), 1000, 6)).mean() > 0.9


def test_shards_hold_every_token(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = "file://" + str(tmp_path / "s")
    got = materialise(docs, path, length=64, shard=100).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n))
    stored = list(read_from(path, 0, n, length=64, shard=100))
    assert len(stored) == n and [x.tolist() for x in read_from(path, 150, 3, length=64, shard=100)] == [x.tolist() for x in stored[150:153]]
    assert len(list(read_from(path, n - 2, 10, length=64, shard=100))) <= 2 if n % 100 > 2 else True
    parts = {}
    for r in got:
        assert r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * 128 and r.crc32 == zlib.crc32(stored[r.slot].astype("<u2").tobytes())
        assert (stored[r.slot][r.n_tokens :] == END_ID).all()
        parts[r.doc_id, r.part] = stored[r.slot][: r.n_tokens].tolist()
    encode = byte_bpe()()
    for r in docs.collect():
        whole = [i for p in range(sum(k[0] == r.doc_id for k in parts)) for i in parts[r.doc_id, p]]
        assert whole == encode([r.text or ""])[0] + [END_ID]


def test_odd_rows(spark):
    rows = [(None, None, 1, "x"), (1, "", None, None), (1, "", None, None), (2, "word " * 20_000, 1, "x")]
    got = materialise(spark.createDataFrame(rows, DOCS), length=16, shard=50).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and sum(r.n_tokens == 1 for r in got) >= 3
    assert materialise(spark.createDataFrame([], DOCS)).count() == 0
