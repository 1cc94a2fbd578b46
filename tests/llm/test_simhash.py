import numpy as np
import xxhash

from fabula.llm.simhash import fingerprint, keep_one, leaf_pairs, link_fingerprints, shingle_hashes, simhash_groups, split_top, trie_join
from fabula.operators.components import connected_components

DOCS = "doc_id long, text string, fp string, fingerprint int"


def plain_print(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, budget=3):
    n = len(prints)
    comp = list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [find(i) for i in range(n)]


def test_fingerprints():
    for t in [None, "", "One", "one TWO", "a b c", "a  b\tc\nd\x0be É x", "x y z " * 200]:
        assert fingerprint(shingle_hashes(t)) == plain_print(t)


def test_trie_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = np.array([int(x) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for x in base], np.uint64)
    a = np.unique(np.concatenate([base, near, base ^ np.uint64(1)]))
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (int(a[i]) ^ int(a[j])).bit_count() <= 3}
    got = [(int(i), int(j)) for x, y in trie_join(a, a, True, 3, 0, 0) for i, j in zip(x, y)]
    assert len(got) == len(set(got)) and set(got) == want
    b = np.unique(near)
    got = [(int(i), int(j)) for x, y in trie_join(a, b, False, 3, 0, 0) for i, j in zip(x, y)]
    assert set(got) == {(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= 3} and len(got) == len(set(got))


def test_top_of_trie_covers_all():
    rng = np.random.default_rng(2)
    counts = np.zeros(1 << 16, np.int64)
    np.add.at(counts, np.concatenate([rng.integers(0, 1 << 16, 3000), np.full(4000, 77)]), 1)
    leaves = split_top(counts, 200, 100)
    assert len(leaves) <= 100
    seen = np.zeros(1 << 16, int)
    for d, p in leaves:
        seen[p << (16 - d) : (p + 1) << (16 - d)] += 1
    assert seen.max() == 1 and (seen[counts > 0] == 1).all()
    assert (0, 0) in leaf_pairs(leaves, 3)


def test_distributed_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    prints = {int(x) for x in base} | {int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for x in base}
    prints = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.component for r in connected_components(link_fingerprints(df, target=16)).collect()}
    want = classes([p & (1 << 64) - 1 for p in prints])
    assert [got.get(p, p) for p in prints] == [prints[w] for w in want]


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [plain_print(t) for _, t in rows]
    want = {d: (f"{p:016x}", rows[c][0]) for (d, _), p, c in zip(rows, prints, classes(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()} == want
    assert {r.doc_id for r in keep_one(docs).collect()} == {c for _, c in want.values()}


def test_odd_rows(spark):
    rows = [(5, None, "x", 1), (3, "", None, None), (None, " \n", "x", 1), (9, "a b c d", "x", 1), (8, "A B c  d", "x", 1), (8, "A B c  d", "x", 1), (None, "lonely words here now", "x", 2)]
    docs = spark.createDataFrame(rows, DOCS)
    got = [(r.doc_id, r.component_id) for r in simhash_groups(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (8, 8), (None, None)], key=str)
    kept = keep_one(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 8, None], key=str) and kept.columns == docs.columns
    assert simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def near_texts():
    """Two texts of different fingerprints that link, and one far from both."""
    words = [f"word{k}" for k in range(400)]
    a = " ".join(words)
    for k in range(400):
        b = " ".join(words[:k] + ["other"] + words[k + 1 :])
        if 0 < (plain_print(a) ^ plain_print(b)).bit_count() <= 3:
            return a, b, "something else that is far from it"
    raise AssertionError


def test_key_in_two_groups(spark):
    a, b, far = near_texts()
    for first, second in ((a, far), (far, a)):
        rows = [(5, first, "x", 1), (5, second, "x", 2), (7, b, "x", 3), (4, "one more text of its own", "x", 4), (4, b + " ", "x", 5)]
        got = keep_one(spark.createDataFrame(rows[:3], DOCS)).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted([(5, a), (5, far)])
        # The head of a's group now is 4, which also stands in a group of its own.
        got = keep_one(spark.createDataFrame(rows, DOCS)).collect()
        assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted([(4, 4), (4, 5), (5, 1 if first == far else 2)])


def test_near_texts_without_keys(spark):
    a, b, far = near_texts()
    rows = [(None, a, "x", 1), (None, b, "x", 2), (None, b, "x", 3), (None, far, "x", 4), (None, far, "x", 5)]
    got = keep_one(spark.createDataFrame(rows, DOCS)).collect()
    want = min((a, b), key=plain_print)
    assert sorted(r.text for r in got) == sorted([want, far])
    got = keep_one(spark.createDataFrame(rows + [(9, a, "x", 6)], DOCS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("9", a), ("None", far)])
