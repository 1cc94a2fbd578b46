import random

from fabula.llm.decontaminate import ItemIndex, bands, clean, contaminated, words

DOCS = "doc_id long, text string, _matches string"


def plain(docs, items, threshold=0.8):
    out = set()
    for d, t, *_ in docs:
        w = words(t)
        for i, x in items:
            iw = words(x)
            if not iw or i is None:
                continue
            n = min(5, len(iw))
            own = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
            have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if len(own & have) >= threshold * len(own):
                out.add((d, i, len(own), len(own & have)))
    return out


def cases(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 12, 40, 120])))) for k in range(60)] + [(60, ""), (61, None), (None, "w1 w2 w3 w4 w5")]
    docs = []
    for d in range(200):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 80)))]
        for _ in range(rng.choice([0, 1, 1, 8])):
            w = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            parts.append(", ".join(w).upper())
        rng.shuffle(parts)
        docs.append((d, ". ".join(parts), "x"))
    return docs, items


def test_all_pairs_are_found(spark):
    docs, items = cases()
    docs += [(500, None, None), (501, "", None), (None, items[3][1], None)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert len(want) > 100
    for block in (4 << 20, 2000):
        assert {tuple(r)[:4] for r in contaminated(d, i, block_chars=block).collect()} == want
    kept = clean(d, i).collect()
    dirty = {x[0] for x in want}
    assert sorted((r.doc_id for r in kept), key=str) == sorted((x[0] for x in docs if x[0] not in dirty), key=str) and kept[0].__fields__ == ["doc_id", "text", "_matches"]


def test_bands_only_are_as_good(spark):
    docs, items = cases(8)
    index = ItemIndex([x for x in items if x[0] is not None])
    got = {(d, *m) for d, t, _ in docs for m in index.matches(t)}
    assert got == plain(docs, items)
    assert bands(20, 25, 0.8) < bands(20, 200, 0.8) < bands(20, 20_000, 0.8)


def test_empty(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert contaminated(d, i).count() == 0
    one = spark.createDataFrame([(1, "a", "b")], DOCS)
    assert contaminated(one, i).count() == 0 and clean(one, i).count() == 1
