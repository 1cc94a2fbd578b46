import pytest
from pyspark.sql import functions as F

from fabula.operators import narrative as N


def test_labels_and_runs(spark):
    d = spark.createDataFrame([("?A1",), ("d2",), ("lambda",), ("up",), ("beta3",), ("H-I",)], "x string").select("x", N.function_label(F.col("x")).alias("y"))
    assert {r.x: r.y for r in d.collect()} == {"?A1": "A", "d2": "D", "lambda": "theta", "up": "depart", "beta3": "beta", "H-I": "H"}
    rows = spark.createDataFrame([(1, 0, 5, "A1"), (1, 6, 4, "?A2"), (1, 11, 3, "B"), (1, 15, 3, "A")], "story_id int, offset long, len long, function string")
    assert [(r.label, r.offset, r.len, r.implicit) for r in N.spans_of_runs(rows).orderBy("run").collect()] == [("A", 0, 10, True), ("B", 11, 3, False), ("A", 15, 3, False)]


def test_features(spark):
    f = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 10)], "doc_id long, fn_id int, offset long, len long")
    m = spark.createDataFrame([(1, 1, 7, "hero"), (1, 1, 7, "hero"), (1, 1, 8, "villain")], "doc_id long, fn_id int, mention_id int, role string")
    assert {r.fn_id: (r.hero, r.villain) for r in N.role_shares(f, m, ["hero", "villain"]).collect()} == {1: (0.5, 0.5), 2: (0.0, 0.0)}
    v = spark.createDataFrame([(1, 1, "go"), (1, 2, "sing")], "doc_id long, fn_id int, lemma string")
    c = spark.createDataFrame([("go", "move")], "word string, class string")
    assert {r.fn_id: r.move for r in N.class_flags(v, c, ["move"]).collect()} == {1: 1.0, 2: 0.0}
    assert [r.position for r in N.positions(f, spark.createDataFrame([(1, "x" * 20)], "doc_id long, text string")).orderBy("fn_id").collect()] == [0.25, 0.75]


def test_frames_and_retrieval(spark):
    v = spark.createDataFrame([("s", 1, "give", "k", "h"), ("s", 1, "give", "k", "h"), ("s", 2, "run", "h", None)], "story string, phase int, lemma string, subject string, object string")
    e = spark.createDataFrame([("s", 1, "k", "king")], "story string, phase int, entity string, type string")
    f = N.frames(v, e)
    assert f.count() == 3 and N.first_phases(f, 1).count() == 2 and N.without_heads(f, ["run"]).count() == 2
    s = spark.createDataFrame([("p", "a", 1, 0.5), ("p", "a", 2, 0.9), ("p", "b", 1, 0.7), ("p", "c", 1, 0.1)], "probe string, story string, instance int, score double")
    assert [(r.story, r.score) for r in N.retrieve(s, 2).orderBy("rank").collect()] == [("a", 0.9), ("b", 0.7)]
    d = N.distractors(spark.createDataFrame([(k,) for k in range(6)], "story int"), 4, 1).collect()
    assert len(d) == 24 and all(r.story != r.other for r in d) and len({(r.story, r.other) for r in d}) == 24


def test_similar_concepts(spark):
    t = spark.createDataFrame([("cat", "isa", "animal"), ("cat", "has", "tail"), ("dog", "isa", "animal"), ("rock", "isa", "thing")], "term string, relation string, concept string")
    sim = N.concept_overlap(t, t)
    got = {(r.left, r.right): r.similarity for r in sim.collect()}
    assert got["cat", "dog"] == 0.5 and got["cat", "cat"] == 1 and ("cat", "rock") not in got
    a = spark.createDataFrame([(1, "cat"), (1, "rock")], "id int, term string")
    b = spark.createDataFrame([(2, "dog")], "id int, term string")
    assert [(r.a, r.b, r.similarity) for r in N.best_match_similarity(a, b, sim).collect()] == [(1, 2, pytest.approx(2 * 0.5 / 3))]


def test_survey_and_arguments(spark):
    a = spark.createDataFrame([("u", 9.0, 6, "s", 1, 4, "y"), ("u", 9.0, 6, "s", 2, 2, "n"), ("v", 1.0, 6, "s", 1, 1, "y")], "uid string, minutes double, checks int, story string, place int, rating int, issue string")
    s = spark.createDataFrame([("u", "s", 1, "machine"), ("u", "s", 2, "human"), ("v", "s", 1, "human")], "uid string, story string, place int, source string")
    got = {(r.story, r.source): (r.ratings, r["mean"], r.issues) for r in N.survey_report(a, s).collect()}
    assert got == {("s", "machine"): (1, 4.0, 1), ("s", "human"): (1, 2.0, -1), ("s", None): (2, 3.0, 0), (None, "machine"): (1, 4.0, 1), (None, "human"): (1, 2.0, -1)}
    p = spark.createDataFrame([(1, 1, "A0", 5), (1, 1, "A1", 6), (1, 2, "A0", 7)], "doc_id long, token_id int, slot string, arg int")
    g = spark.createDataFrame([(1, 1, "A0", 5), (1, 3, "A0", 9)], "doc_id long, token_id int, slot string, arg int")
    assert tuple(N.argument_scores(p, g).first()) == (1, 2, 2, 1, 3, 2)


def test_rules_and_votes(spark):
    t = spark.createDataFrame([(1, k, c) for k, c in enumerate("VPqS")], "d int, pos int, c string")
    r = N.rule_windows(t, ["d"], "pos", "c", "q", 2)
    assert {x.rule for x in r.collect()} == {"q", "P q", "V P q", "q S", "P q S", "V P q S"}
    assert {x.rule for x in N.generalised(r.where("rule = 'P q S'"), "q").collect()} == {"P q S", "P? q S", "P q S?"}
    v = spark.createDataFrame([(1, "r1", "a"), (1, "r2", "b"), (1, "r3", "b")], "item int, rule string, vote string")
    w = spark.createDataFrame([("r1", 0.9), ("r2", 0.3), ("r3", 0.4)], "rule string, weight double")
    assert {m: N.weighted_vote(v, w, ["item"], m).first().vote for m in ("top", "weight", "bayes", "counter")} == {"top": "a", "weight": "a", "bayes": "a", "counter": "b"}


def test_sampling_and_language(spark):
    p = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "label string, p double")
    got = N.sampled_paths(p, 300, 5, 1).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got}["a"] / 1500 == pytest.approx(0.7, abs=0.06)
    w = spark.createDataFrame([(1, "the"), (1, "der"), (1, "of"), (2, "zzz")], "d int, word string")
    lex = spark.createDataFrame([("the", "en"), ("of", "en"), ("der", "de")], "word string, lang string")
    assert {r.d: (r.lang, round(r.share, 3)) for r in N.guessed_language(w, lex, ["d"]).collect()} == {1: ("en", 0.667), 2: (None, 0.0)}
