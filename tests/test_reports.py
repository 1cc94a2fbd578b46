from pyspark.sql import functions as F

from fabula.operators import reports as R


def test_group_statistics(spark):
    m = spark.createDataFrame([(1, 1, 1, "k", True), (1, 2, 1, "q", True), (1, 3, 2, "k", True), (1, 4, 3, None, False)], "doc_id long, mention_id long, grp long, symbol string, character boolean")
    r = R.group_statistics(m).first()
    assert (r.mentions, r.groups, r.symbols, r.characters, r.symbols_per_group, r.groups_per_symbol) == (4, 3, 2, 2, 1.5, 1.5)
    assert {x.grp: (x.characters, x.has_character) for x in R.characters_of_groups(m).collect()} == {1: (2, True), 2: (1, True), 3: (0, False)}
    g = R.own_group(m.drop("grp"), spark.createDataFrame([(1, 1, 0)], "doc_id long, mention_id long, grp long"))
    assert {x.mention_id: x.grp for x in g.collect()} == {1: 0, 2: 2, 3: 3, 4: 4}


def test_counts(spark):
    h = spark.createDataFrame([("said<a/b",), ("Said>c/",), ("cry<a/",), ("<a",)], "hint string")
    assert [tuple(r) for r in R.signal_verbs(h).collect()] == [("said", 2), ("cry", 1)]
    v = spark.createDataFrame([("go", "A"), ("go", "B"), ("sing", "A")], "lemma string, label string")
    c = spark.createDataFrame([("go", "move")], "word string, class string")
    assert [(r.lemma, r.n, r.functions, r["class"]) for r in R.verb_report(v, c).collect()] == [("go", 2, 2, "move"), ("sing", 1, 1, "sing")]
    a = spark.createDataFrame([(1, 2), (3, 4)], "x int, y int")
    assert {r.version: (r.sum_x, r.mean_y) for r in R.before_and_after(a, a.where("x = 1"), ["x", "y"]).collect()} == {"before": (4, 3.0), "after": (1, 2.0)}
    f = spark.createDataFrame([(1, 5, "B"), (1, 0, "A")], "doc_id long, offset long, label string")
    assert R.label_summary(f).first().labels == "A B"
    assert R.reference_check(f.select("label"), spark.createDataFrame([("A",)], "label string"), "unknown", ["label"]).first().n == 1
    assert [(r.label, r["rank"]) for r in R.ranked_by_frequency(f.union(f.where("label = 'B'")), "label", 1).collect()] == [("B", 1)]


def test_sweep_and_loop(spark):
    g = spark.createDataFrame([(1,), (2,)], "k int")
    out = R.parameter_sweep(g, lambda k: spark.range(k).agg(F.count(F.lit(1)).alias("n")), ["k"])
    assert {r.k: r.n for r in out.collect()} == {1: 1, 2: 2}
    m = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b"), (1, 3, 0, "b"), (1, 4, 1, "a")], "doc_id long, mention_id long, grp long, label string")
    assert {r.mention_id: r.label for r in R.refined(m, lambda x: x, lambda x: x, 2).collect()} == {1: "b", 2: "b", 3: "b", 4: "a"}
