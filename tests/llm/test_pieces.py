import random
import zlib

import numpy as np
import pytest

from fabula.llm.pieces import default_model, encode_documents, marked, max_plus, path_states, vocabulary
from fabula.llm.queries import op8_sentencepiece

DOCS = "doc_id long, text string, row int, n_tokens string"
PARTS = ["a", "b", "the", "  ", " ", "\n", "in", "er", "ß", "é", "😀", "漢", "字", "　", "A", "!!", "***", " " * 5, "ing", "\t", "xyz", "\x00"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def texts():
    rnd = random.Random(1)
    return ["".join(rnd.choices(PARTS, k=rnd.randint(1, 60))) for _ in range(600)] + ["a" * 200, "ab" * 300, " " * 77, "word" * 100, "▁x ▁▁y", "é" * 99]


def test_ids_are_the_librarys(library):
    v = vocabulary(default_model())
    for t in texts():
        ids = v.encode(marked(t)).tolist()
        assert ids == library.encode(t) and v.decode(ids) == library.decode(ids)
        if "▁" not in t:
            assert v.decode(ids) == t
        for u in t.split():
            assert v.path(u) == v.merge(u)
    units = [u for t in texts() for u in t.split(" ")] + ["é漢\x00😀", "x" * 65, "ab" * 40, "\ud800a", "a"]
    assert [list(np.frombuffer(b, np.int32)) for b in v.merge_in_step(units)] == [v.ids(v.merge(u)) for u in units]


def test_chunks_meet(library):
    v = vocabulary(default_model())
    for t in texts():
        for size in (40, 67):
            m = marked(t)
            n = -(-len(m) // size)
            states = [None] + [v.states(m, c * size) for c in range(1, n)] + [None]
            cuts = [(c * size, min(len(m), (c + 1) * size)) for c in range(n)]
            matrices = [v.fast_transfer(m, *cuts[c], states[c], states[c + 1]) for c in range(n)]
            slow = [v.transfer(m, *cuts[c], states[c], states[c + 1]) for c in range(n)]
            assert all((a == b).all() for a, b in zip(matrices, slow))
            product = matrices[0]
            for x in matrices[1:]:
                product = max_plus(product, x)
            assert product.shape == (1, 1) and product[0, 0] == 0
            at = path_states(matrices, 0, 0)
            ids = [
                i
                for c in range(n)
                for i in v.fast_trace(m, *cuts[c], states[c][at[c]] if c else None, states[c + 1][at[c + 1]] if c < n - 1 else None)
            ]
            assert ids == library.encode(t)


def test_giant_documents(spark, library):
    rnd = random.Random(7)
    giants = ["".join(rnd.choices(PARTS, k=2500)), "ab" * 4000, "no blanks" * 900, " the quick" * 700]
    rows = [(k, t, 1, "x") for k, t in enumerate(giants)] + [(7, None, 1, "x"), (8, "", None, None), (None, "short", 1, "x"), (None, "short", 1, "x")]
    got = encode_documents(spark.createDataFrame(rows, DOCS), chunk=50).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "short" if r.doc_id is None else dict((a, b) for a, b, *_ in rows)[r.doc_id] or ""
        assert r.token_ids == library.encode(want) and r.n_tokens == len(r.token_ids) and r.decoded == want
        assert r.n_chunks == (1 if len(want) <= 50 else -(-(len(want) + 1) // 50))
    assert encode_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_query_decodes_every_document(spark, tmp_path):
    rnd = random.Random(3)
    plain = [p for p in PARTS if p != "\x00"]
    texts = {1: "".join(rnd.choices(plain, k=25_000)), 2: "short  one\n", 3: "", 4: " the quick é" * 6000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_sentencepiece(spark, str(tmp_path)).collect()}
    assert all(r.round_trip and r.decoded_chars == len(texts[k]) and r.decoded_crc32 == zlib.crc32(texts[k].encode()) for k, r in got.items())
    assert got[1].n_chunks > 1 and got[4].n_chunks > 1 and got[2].n_chunks == 1


def test_round_trip_is_told(spark):
    rows = [(1, "▁x", 1, "x"), (2, "fine text", 1, "x"), (3, "▁ long enough " * 20, 1, "x"), (4, "fine text " * 20, 1, "x"), (5, None, 1, "x")]
    got = encode_documents(spark.createDataFrame(rows, DOCS), chunk=50).collect()
    assert {r.doc_id: r.round_trip for r in got} == {1: False, 2: True, 3: False, 4: True, 5: True}
