from pyspark.sql import functions as F

from fabula.operators import filters, mentions


def deps(spark, rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "doc_id long, sent_id int, type string, gov_idx int, dep_idx int")


def test_verbs_arguments_and_mentions(spark):
    # The old king gave up the fight
    pos = ["DT", "JJ", "NN", "VBD", "RP", "DT", "NN"]
    lemma = "the old king give up the fight".split()
    t = spark.createDataFrame([(1, 1, k + 1, p, w) for k, (p, w) in enumerate(zip(pos, lemma))], "doc_id long, sent_id int, idx int, pos string, lemma string")
    d = deps(spark, [("det", 3, 1), ("nsubj", 4, 3), ("prt", 4, 5), ("dobj", 4, 7), ("neg", 4, 2)])
    v = mentions.verbs_from_dependencies(d, t)
    assert {(r.lemma, r.slot, r.dep_idx) for r in v.collect()} == {("give_up", "A0", 3), ("give_up", "A1", 7), ("give_up", "AM-NEG", 2)}
    m = spark.createDataFrame([(1, 1, 10, 1, 4), (1, 1, 11, 6, 8), (1, 1, 12, 1, 8)], "doc_id long, sent_id int, mention_id long, tok_start int, tok_end int")
    cover = mentions.covering(m, t)
    assert {(r.idx, r["rank"]): r.mention_id for r in cover.collect()}[3, 1] == 10
    got = mentions.subjects_and_objects(v, cover).collect()
    assert {(r.role, r.mention_id) for r in got} == {("subject", 10), ("object", 11)}
    assert filters.dependencies(d, ["n*"]).count() == 2 and filters.dependencies(d, ["det"], 2, 9).count() == 0
    w = filters.negated_weights(t.withColumn("weight", F.lit(1.0)), d)
    assert {r.idx: r.weight for r in w.collect()}[4] == -0.5


def test_copula(spark):
    got = mentions.unfolded_copulas(deps(spark, [("nsubj", 4, 1), ("cop", 4, 2), ("det", 4, 3)]))
    assert {(r.type, r.gov_idx, r.dep_idx) for r in got.collect()} == {("cop_nsubj", 4, 1), ("cop", 4, 2), ("det", 4, 3), ("nsubj", 2, 1)}


def test_parse_nodes(spark):
    # (S (NP (DT)(NN)) (VP (VB) (NP (NP (NN)) (PP))))
    rows = [([], "S", 0, 5), ([0], "NP", 0, 2), ([0, 0], "DT", 0, 1), ([0, 1], "NN", 1, 2), ([1], "VP", 2, 5), ([1, 0], "VB", 2, 3), ([1, 1], "NP", 3, 5), ([1, 1, 0], "NP", 3, 4), ([1, 1, 1], "PP", 4, 5)]
    n = spark.createDataFrame([(1, 1, *r) for r in rows], "doc_id long, sent_id int, path array<int>, label string, node_start int, node_end int")
    m = {tuple(r.path): r.is_independent for r in mentions.mentions_from_tree(n).collect()}
    assert m == {(0,): True, (1, 1): True, (1, 1, 0): False}
    low = mentions.lowest_node(spark.createDataFrame([(1, 1, 7, 3, 4), (1, 1, 8, 1, 3)], "doc_id long, sent_id int, range_id int, tok_start int, tok_end int"), n)
    assert {r.range_id: tuple(r.path) for r in low.collect()} == {7: (1, 1, 0), 8: ()}
    f = {tuple(r.path): (r.above_VP, r.below_PP) for r in mentions.node_flags(n, ["VP"], ["PP"]).collect()}
    assert f[1, 1] == (1.0, 1.0) and f[0,] == (0.0, 0.0) and f[()] == (0.0, 1.0)


def test_links_of_pairs(spark):
    m = spark.createDataFrame([(1, 1, "A", [1.0, 0.0], True, 0.0, 1.0, "hero"), (1, 2, "A", [1.0, 1.0], True, 2.0, 1.0, "hero"), (1, 3, None, [0.0, 0.0], False, 0.0, 0.0, None)], "doc_id long, mention_id long, g string, features array<double>, character boolean, male double, female double, role string")
    assert {(r.i, r.j): r.w for r in mentions.prior_links(m, "g").collect()} == {(1, 2): 1.0, (1, 3): -1.0, (2, 3): -1.0}
    assert {(r.i, r.j): r.w for r in mentions.feature_links(m).collect()} == {(1, 2): 0.5, (1, 3): 0.0, (2, 3): 0.0}
    assert {(r.i, r.j) for r in mentions.conflict_links(m, ["male", "female"]).collect()} == {(1, 2)}
    assert {(r.i, r.j): r.w for r in mentions.role_links(m).collect()} == {(1, 2): 1.0, (1, 3): -1.0, (2, 3): -1.0}
    p = mentions.probabilistic_merge([(mentions.prior_links(m, "g"), 0.9), (mentions.role_links(m), 0.5)])
    assert all((r.w > 0.5) == ((r.i, r.j) == (1, 2)) for r in p.collect())


def test_alignment_owners_and_hints(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 2, 9), (1, 3, 7)], "doc_id long, mention_id long, token int")
    b = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (1, 12, 7)], "doc_id long, mention_id long, token int")
    assert {r.left_id: (r.rights, r.status) for r in mentions.aligned(a, b).collect()} == {1: ([10, 11], "many"), 2: ([], "none"), 3: ([12], "one")}
    o = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 2, 6)], "doc_id long, mention_id long, token int")
    assert {(r.token, r.mention_id) for r in mentions.owners(o).collect()} == {(5, 1), (6, 2)}
    q = spark.createDataFrame([(1, 0, "said<king/queen"), (1, 9, "ask>fox/")], "doc_id long, offset long, hint string")
    got = {r.offset: (r.hint_verb, r.hint_speaker, r.hint_listener, r.next_quote, r.backward) for r in mentions.hinted(q).collect()}
    assert got == {0: ("said", "king", "queen", 9, True), 9: ("ask", "fox", None, None, False)}


def test_filters(spark):
    m = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, None)], "doc_id long, mention_id long, parent_id long")
    assert sorted(r.mention_id for r in filters.remove_mentions(m, m.where("mention_id = 2")).collect()) == [1, 4]
    t = spark.createDataFrame([("HE", "CH"), ("PL", None)], "code string, parent string")
    c = filters.is_character("type", t, spark.createDataFrame([("HE",), ("PL",), (None,)], "type string"))
    assert {r.type: r.character for r in c.collect()} == {"HE": True, "PL": False, None: False}
    s = spark.createDataFrame([(1, 1, ["c", "c"]), (1, 2, ["c", "d"])], "doc_id long, sent_id int, speech array<string>")
    kept, men = filters.without_quoted(s, spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, sent_id int"))
    assert [r.sent_id for r in kept.collect()] == [1] == [r.sent_id for r in men.collect()]
    tok = spark.createDataFrame([("Dogs", "NNS", "NP", None), ("run", "VB", "VP", None)], "token string, tag string, chunk string, role string")
    assert [r.token for r in tok.where(filters.constraint(words=["d*"], tags=["NN*"])).collect()] == ["Dogs"]
    g = spark.createDataFrame([(1, 1, 5, "b", "hero", True), (1, 1, 2, "a", "hero", False), (1, 2, 9, "z", None, False)], "doc_id long, grp long, offset long, text string, role string, character boolean")
    assert {r.grp: (r.representation, r.majority_role, r.any_character) for r in mentions.groups_with_entity(g).collect()} == {1: ("a", "hero", True), 2: ("z", None, False)}
