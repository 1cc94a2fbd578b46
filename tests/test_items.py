import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.functions import collections as C
from fabula.operators import bow, classify, mentions
from fabula.plans import queries

MENTION = "doc_id long, mention_id long, grp long, tokens array<struct<pos:string,lemma:string>>"


def groups(df):
    return {(r.doc_id, r.mention_id): r.grp for r in df.collect()}


def test_groups_merge_by_head(spark):
    rows = [
        (1, 1, 1, [("DT", "the"), ("JJ", "old"), ("NN", "King")]),
        (1, 2, 2, [("NN", "king")]),
        (1, 3, 3, [("NN", "king"), ("NN", "crown")]),
        (1, 4, 4, [("JJ", "old"), ("NN", "king")]),
        (1, 5, 5, [("NNS", "king")]),
        (1, 6, 6, []),
        (1, 7, 3, None),
        (2, 1, 9, [("NN", "king")]),
    ]
    m = spark.createDataFrame(rows, MENTION)
    own = {(r[0], r[1]): r[2] for r in rows}
    assert groups(mentions.merged_by_head(m, -1)) == own
    assert groups(mentions.merged_by_head(m, 0)) == own | {(1, 4): 1}
    assert groups(mentions.merged_by_head(m, 1)) == own | {(1, 2): 1, (1, 4): 1}
    assert groups(mentions.merged_by_head(m, 2)) == own | {(1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 7): 1}
    assert groups(mentions.reset_groups(m)) == {k: k[1] for k in own}
    assert mentions.merged_by_head(m.limit(0), 2).count() == 0


def test_symbols_join_groups(spark):
    m = spark.createDataFrame([(1, 1, 4, "a"), (1, 2, 2, "a"), (1, 3, 3, None), (1, 4, 7, None), (2, 5, 4, "a")], "doc_id long, mention_id long, grp long, symbol string")
    got = {(r.doc_id, r.mention_id): (r.grp, r.singleton) for r in mentions.joined_symbols(m).collect()}
    assert got == {(1, 1): (2, False), (1, 2): (2, False), (1, 3): (3, True), (1, 4): (7, True), (2, 5): (4, True)}


def test_left_out_neighbours(spark):
    rows = [(1, [1.0, 0.0], "a", 1), (2, [1.0, 0.1], "b", 1), (3, [0.9, 0.1], "a", 2), (4, [0.0, 1.0], "b", 3), (5, None, "b", 4), (6, [0.2, 0.9], None, 5)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, story long")
    near = classify.nearest(e, e.where("vec_id in (1, 5)"), 2, other=["label"], story="story")
    assert [(r["query"], r.vec_id) for r in near.orderBy("query", "rank").collect()] == [(1, 3), (1, 6)]
    p = {r.label: r.p for r in classify.vote_distribution(near, e, 0.5).collect()}
    assert {k: round(v, 9) for k, v in p.items()} == {"a": 0.5, "b": round(0.5 / 3, 9)}
    assert [r.label for r in classify.likeliest(classify.vote_distribution(near, e)).collect()] == ["a"]
    light = classify.nearest(e, e.where("vec_id = 1"), 1, weights=[1.0, 0.0])
    assert [(r.vec_id, r.similarity) for r in light.collect()] == [(2, 1.0)]


def test_every_vector_gets_a_label(spark, sf):
    """not only those whose id is divisible by 20."""
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r["query"] for r in queries()["gain_weighted_labels"](spark, sf).collect()} == ids


@pytest.mark.parametrize("case", ["plain", "copies", "rounded", "odd"])
def test_all_rows_as_queries(spark, monkeypatch, case):
    """Tile against tile, with bounds, gives what each block of queries gives."""
    for name, value in {"ROWS": 40, "FEW": 16, "TILE": 8}.items():
        monkeypatch.setattr(classify, name, value)
    rng = np.random.default_rng(3)
    v, w = rng.random((150, 6)), rng.random(6)
    w[0] = -1e-18 if case == "rounded" else 0.0
    v = np.round(v, 1) if case == "copies" else v
    v[7] = v[8] = 0
    rows = [(int(i), x.tolist(), None if i % 11 == 0 else int(i) % 3, int(i) % 7) for i, x in zip(rng.permutation(150), v)]
    if case == "odd":
        rows += [(900, None, 1, 1), (901, [float("nan")] * 6, 1, 1), (902, [1.0, None] * 3, 1, 1), (903, [float("inf")] + [0.5] * 5, 1, 2), (904, [-0.5] * 6, 1, 3)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, story long").repartition(3)
    plain = lambda df: sorted((r["query"], r["rank"], r.vec_id, r.similarity, str(r.label)) for r in df.collect())
    given = e.where("vec_id not in (901, 902)")
    for story in ("story", None):
        want = classify.nearest(given, given, 4, other=["label"], story=story, weights=w.tolist())
        assert plain(classify.nearest_of_all(e, 4, w.tolist(), other=["label"], story=story)) == plain(want)
    assert classify.nearest_of_all(e.limit(0), 4, w.tolist(), other=["label"], story="story").count() == 0


def test_gain_weights(spark):
    rows = [("a", [0.0, 1.0]), ("a", [0.0, 0.0]), ("b", [1.0, 1.0]), ("b", [1.0, 0.0]), (None, [1.0, 1.0])]
    got = classify.gain_weights(spark.createDataFrame(rows, "label string, embedding array<double>"))
    assert [round(x, 9) for x in got] == [1.0, 0.0]


def test_updated_documents(spark):
    t = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1), (3, "z", 1)], "doc_id long, term string, n long")
    new = spark.createDataFrame([(1, "w", 5), (4, "w", 1)], t.schema)
    got = {tuple(r) for r in bow.updated(t, new, t.where("doc_id = 3")).select("doc_id", "term", "n").collect()}
    assert got == {(1, "w", 5), (2, "x", 1), (4, "w", 1)}


def test_lists(spark):
    one = spark.createDataFrame([(["c", "a", "b"], [1.0, 3.0], None)], "s array<string>, v array<double>, m map<string,string>")
    r = one.select(
        C.powerset(F.col("s")).alias("all"), C.combinations(F.col("s"), 2).alias("two"), C.product(F.col("s"), F.array(F.lit(1), F.lit(2))).alias("pairs"),
        C.relative(F.col("v")).alias("rel"), C.sparse(F.col("v")).alias("sparse"), C.listed(F.col("s")).alias("listed"), C.listed(F.array(F.lit("x"))).alias("one"),
        C.sum_lists(F.col("v"), F.array(F.lit(1.0))).alias("sum"), C.slice_text(F.lit("ab \n cd"), 1, 6).alias("cut"), C.clamp(F.lit(7), 1, 5).alias("clamp"),
    ).first()
    assert len(r["all"]) == 8 and r["two"] == [["c", "a"], ["c", "b"], ["a", "b"]] and len(r["pairs"]) == 6
    assert (r["rel"], r["sparse"], r["sum"], r["clamp"]) == ([0.25, 0.75], {0: 1.0, 1: 3.0}, [2.0, 3.0], 5)
    assert (r["listed"], r["one"], r["cut"]) == ("c, a and b", "x", "b c")
