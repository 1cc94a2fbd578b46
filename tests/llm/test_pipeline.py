import corpus_pipeline
from fabula.llm import decontaminate, pieces, quality, simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    assert len(corpus_pipeline.STAGES) == 4
    good = {r.doc_id for r in quality.score_documents(docs, labels).collect() if r.predicted}
    step = docs.where(docs.doc_id.isin(good))
    heads = {r.component_id for r in simhash.simhash_groups(step).collect()}
    step = step.where(step.doc_id.isin(heads))
    dirty = {r.doc_id for r in decontaminate.contaminated(step, items).collect()}
    want = {r.doc_id: r.token_ids for r in pieces.encode_documents(step.where(~step.doc_id.isin(dirty))).collect()}
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < docs.count()
    chars = {r.doc_id: len(r.text) for r in docs.collect()}
    assert all(r.decoded_chars == chars[r.doc_id] for r in corpus_pipeline.run(spark, sf).collect())


def test_stages_take_odd_rows(spark, sf):
    long = "A quiet road led past the mill and down to the river, where the ferry waited. " * 3
    rows = [
        (1, long, "en", "s", 1, "x", 1), (1, long, "en", "s", 1, "x", 1), (2, None, "en", "s", None, "x", 2), (3, "", None, None, 0, None, 3),
        (None, long + "And so on.", "en", "s", 1, "x", 4), (None, "Something else altogether, told once and never again by anyone at all.", "en", "s", 1, "x", 5),
        (7, "word " * 20_000, "en", "s", 1, "x", 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, decoded string, _print int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
        if "near-dedup" in name:
            assert sum(r.doc_id == 1 for r in out) == 1 and sum(not r.text for r in out) == 1 and {r.doc_id for r in out} >= {1, 2, 7}
        elif "quality" in name:
            assert all(r in [tuple(x[:5]) for x in rows] for r in map(tuple, out))
        else:
            assert len(out) == len(rows)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert all(r.round_trip for r in out)
