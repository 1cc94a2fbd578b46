import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from fabula.operators import bow, classify, evaluate, graph, hierarchy, lexicon, linking, sequences, spans, stats, templates
from fabula.operators.components import connected_components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)] + [(None, 1), (5, None), (7, 7)]
    label = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chi_squared_and_fisher(spark):
    rows = [("o", str(k)) for k, n in enumerate([44, 56]) for _ in range(n)]
    t = stats.chi_squared(spark.createDataFrame(rows + [("e", str(k)) for k in (0, 1) for _ in range(50)], "a string, b string"), "a", "b").first()
    assert t.df == 1 and t.x2 == pytest.approx(0.7226, abs=1e-3)
    p = spark.createDataFrame([(1, 9, 11, 3)], "a long, b long, c long, d long").select(stats.fisher_exact(*[F.col(c) for c in "abcd"]).alias("p")).first()["p"]
    assert p == pytest.approx(0.0028, abs=1e-4)


def test_quantiles_and_moments(spark):
    d = spark.createDataFrame([("x", float(k)) for k in range(10)], "g string, v double")
    b = stats.boxplot(d, ["g"], "v").first()
    assert (b.low, b.q1, b.median, b.q3, b.high) == (0, 2.25, 4.5, 6.75, 9)
    assert stats.moments(d, ["g"], "v").first().kurtosis == pytest.approx(-1.2, abs=0.03)
    assert stats.describe(d, ["g"], "v").first().upper_median == 5
    assert [r.n for r in stats.histogram(d, "v", 3).orderBy("bin").collect()] == [4, 3, 3]


def test_scores(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "g string, p string")
    s = {r.label: r for r in evaluate.one_vs_all(d, "g", "p").collect()}
    assert (s["a"].tp, s["a"].fp, s["a"].fn, s["a"].tn) == (1, 1, 1, 1) and s["c"].recall == 0
    assert evaluate.weighted_scores(evaluate.one_vs_all(d, "g", "p")).first().accuracy == 0.5
    assert evaluate.auc(spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "s double, y int"), "s", F.col("y") == 1).first().auc == pytest.approx(0.875)


def test_pair_counts_are_those_of_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(3)) for _ in range(30)]
    got = evaluate.pair_counts(spark.createDataFrame(rows, "g int, p int"), "g", "p").first()
    two = list(itertools.permutations(rows, 2))
    assert got.both == sum(a == b for a, b in two) and got.gold_pairs == sum(a[0] == b[0] for a, b in two) and got.predicted_pairs == sum(a[1] == b[1] for a, b in two)


def test_beam_is_exact_when_wide(spark):
    rng = random.Random(1)
    labels, n = "xyz", 4
    trans = {(a, b): rng.random() for a in [*labels, sequences.START] for b in labels}
    p = {(k, b): rng.random() for k in range(n) for b in labels}
    rows = [(1, k, b, p[k, b]) for k in range(n) for b in labels]
    got = sequences.beam_decode(spark.createDataFrame(rows, "s int, pos int, label string, p double"), trans, "s", width=3**n).first()
    value = lambda path: sum(math.log(p[k, b]) + math.log(trans[a, b]) for k, (a, b) in enumerate(zip((sequences.START, *path), path)))
    assert tuple(got.path) == max(itertools.product(labels, repeat=n), key=value)


def test_live_matches_against_all_windows():
    rng = random.Random(5)
    rules = [("r1", ["a", "b?", "c"]), ("r2", ["a", "a"]), ("r3", ["*", "c", "b?"])]

    def fits(rule, part):
        if not rule:
            return not part
        head = bool(part) and rule[0].rstrip("?") in (part[0], "*") and fits(rule[1:], part[1:])
        return head or (rule[0].endswith("?") and fits(rule[1:], part))

    for _ in range(60):
        seq = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        want = {}
        for name, rule in rules:
            for i in range(len(seq)):
                ends = [j for j in range(i, len(seq)) if fits(rule, seq[i : j + 1])]
                if ends:
                    want[name, i] = max(ends)
        assert {(r, a): b for r, a, b in sequences.live_matches(enumerate(seq), rules)} == want


def test_rules_on_conversations(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    got = sequences.match_rules(c.select("conv_id", "turn", "role"), [("answered", ["user", "assistant"])], "conv_id", "turn", "role").collect()
    roles = {}
    for r in c.orderBy("conv_id", "turn").collect():
        roles.setdefault(r.conv_id, []).append((r.turn, r.role))
    want = {(k, a[0]) for k, v in roles.items() for a, b in zip(v, v[1:]) if (a[1], b[1]) == ("user", "assistant")}
    assert {(r.conv_id, r["first"]) for r in got} == want


def test_continuations_and_text(spark):
    t = spark.createDataFrame([(1, k, w) for k, w in enumerate("a b c a b d".split())], "s int, pos int, w string")
    m = sequences.continuation_table(t, "s", ["pos"], "w", 2)
    assert {(r.key, r.next): r.n for r in m.collect()} == {("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 1, ("b", "d"): 1, ("a b", "c"): 1, ("b c", "a"): 1, ("c a", "b"): 1, ("a b", "d"): 1}
    out = sequences.generate(m, spark.createDataFrame([(1, ["a", "b"])], "id long, words array<string>"), 2, 2).first().words
    assert out[:2] == ["a", "b"] and out[2] in "cd"


def test_spans(spark):
    s = spark.createDataFrame([(1, k, o, n) for k, (o, n) in enumerate([(0, 10), (2, 5), (3, 2), (20, 5), (20, 5), (8, 6)])], "d int, id int, offset long, len long")
    assert {r.id: r.parent for r in spans.parents(s, "d", "id", width=4).collect()} == {0: None, 1: 0, 2: 1, 3: None, 4: 3, 5: None}
    assert sorted(r.id for r in spans.without_overlaps(s, "d").collect()) in ([0, 3], [0, 4])
    a = spark.createDataFrame([(1, 0, "The cat, "), (1, 1, "sat down. It "), (1, 2, "slept")], "d int, a int, t string")
    b = spark.createDataFrame([(1, 0, "The cat"), (1, 1, " sat"), (1, 2, " down. It"), (1, 3, "slept")], "d int, b int, u string")
    assert {r.b: r.aligned for r in spans.align_by_letters(a, b, "d", "a", "b", "t", "u").collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_links(spark):
    m = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x"), (2, 1, "x"), (2, 2, None)], "doc long, m long, w string")
    links = linking.merge_links([(linking.shared_key_links(m, "doc", "m", "w"), 0.5)], "doc")
    assert {(r.doc, r.m): r.grp for r in linking.link_groups(links, m, "doc", "m").collect()} == {(1, 1): 1, (1, 2): 2, (1, 3): 1, (2, 1): 1, (2, 2): 2}


def test_graph_and_phases(spark):
    acts = spark.createDataFrame([(1, "a", "b", "go"), (1, "a", "b", "see"), (1, "b", None, "go")], "s int, src string, dst string, v string")
    e = graph.interaction_edges(acts, ["s"], "src", "dst", "v")
    assert {(r.src, r.dst): (r.n, r.verbs) for r in e.collect()} == {("a", "b"): (2, 2), ("b", "-1"): (1, 1)}


def test_hierarchy(spark):
    e = spark.createDataFrame([("dog", "animal"), ("cat", "animal"), ("animal", "thing"), ("rock", "thing")], "child string, parent string")
    assert {(r.child, r.ancestor, r.depth) for r in hierarchy.ancestors(e).collect()} == {("dog", "animal", 1), ("cat", "animal", 1), ("animal", "thing", 1), ("rock", "thing", 1), ("dog", "thing", 2), ("cat", "thing", 2)}
    pairs = spark.createDataFrame([("dog", "cat"), ("dog", "rock"), ("dog", "dog"), ("dog", "none")], "a string, b string")
    got = {(r.a, r.b): r.similarity for r in lexicon.wu_palmer(pairs, e).collect()}
    assert got == {("dog", "cat"): pytest.approx(4 / 6), ("dog", "rock"): pytest.approx(2 / 5), ("dog", "dog"): 1, ("dog", "none"): 0}
    with pytest.raises(ValueError):
        hierarchy.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), max_depth=4)


def test_classes_of_words(spark):
    c = spark.createDataFrame([("go", "move"), ("run", "move"), ("go", "leave")], "word string, class string")
    w = spark.createDataFrame([("go",), ("run",), ("sing",)], "word string")
    assert {r.word: r["class"] for r in lexicon.mapped(w, c).collect()} == {"go": "leave", "run": "move", "sing": "sing"}


def test_templates(spark):
    t = spark.createDataFrame([(1, "{a} met {b}"), (2, "only {a}")], "id int, template string")
    o = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "slot string, value string")
    assert {(r.id, r.text) for r in templates.expand(t, o).collect()} == {(1, "x met z"), (1, "y met z"), (2, "only x"), (2, "only y")}
    drawn = templates.sample(t, o, 20).collect()
    assert len(drawn) == 40 and {r.text for r in drawn if r.id == 2} == {"only x", "only y"}


def test_distances(spark):
    d = spark.createDataFrame([([1.0, 0.0, 2.0], [1.0, 1.0, 0.0])], "a array<double>, b array<double>")
    get = lambda c: d.select(c.alias("x")).first()["x"]
    assert get(classify.weighted_jaccard(F.col("a"), F.col("b"))) == pytest.approx(1 - 1 / 4)
    assert get(classify.distance(F.col("a"), F.col("b"), "euclidean")) == 5 and get(classify.distance(F.col("a"), F.col("b"), "hamming")) == pytest.approx(2 / 3)
    assert get(classify.distance(F.col("a"), F.col("b"), "cosine")) == pytest.approx(1 - 1 / math.sqrt(10))


def test_nearest_in_blocks(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    a, b = ({tuple(r) for r in classify.nearest(e, q, 3, block=k).select("query", "vec_id", "rank").collect()} for k in (7, 4096))
    assert a == b and len(a) == 3 * q.count()


def test_overlap_share(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "a int, gram string")
    b = spark.createDataFrame([(9, "x"), (9, "x")], "b int, gram string")
    assert [tuple(r) for r in bow.overlap_share(a, b, "a", "b").collect()] == [(1, 9, 0.5)]


def test_spelling_suggestions(spark):
    from fabula.plans.words import suggestions

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = {"the": 9, "teh": 2, "he": 5, "a": 7, "": 1, "über": 3, "uber": 4, "storm": 6, "strom": 2, "stor": 1, "worms": 1, "ab": 2, "ba": 2}
    words = ["the", "über", "storm", "ab", "x"]
    want = {(w, t, distance(w, t), n) for w in words for t, n in terms.items() if 1 <= distance(w, t) <= 2}
    got = suggestions(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(terms.items()), "term string, n long")).collect()
    assert {(r.word, r.term, r.distance, r.n) for r in got} == want
    for r in got:
        assert r.rank == 1 + sum((-n, d, t) < (-r.n, r.distance, r.term) for w, t, d, n in want if w == r.word)


def test_condensed_prototypes_read_every_row(spark):
    import numpy as np

    from fabula.operators.classify import condensed

    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=4) + 3 * np.eye(4)[k % 3]], k % 3) for k in range(240)]
    rows += [(900, [1.0, 0.0, 0.0, 0.0], None), (901, None, 1)]
    chosen = condensed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=7).collect()
    p = np.array([r.embedding for r in chosen])
    p /= np.sqrt((p * p).sum(1, keepdims=True))
    for k, v, y in rows[:240]:
        assert chosen[int((p @ (np.array(v) / np.linalg.norm(v))).argmax())].label == y
    assert len(chosen) < 200


def test_next_token_however_far(spark):
    from fabula.operators.spans import tokens_in_range

    toks = spark.createDataFrame([(1, 0), (1, 5000), (1, 9000), (2, 40)], "doc_id long, offset long")
    ranges = spark.createDataFrame([(1, 0, 10), (1, 100, 200), (2, 0, 10), (2, 30, 41)], "doc_id long, start long, end long")
    got = sorted((r.doc_id, r.start, r.offset) for r in tokens_in_range(ranges, toks, "doc_id").collect())
    assert got == [(1, 0, 0), (1, 0, 5000), (2, 30, 40)]


def test_generated_text_walks_the_table(spark):
    from fabula.operators.sequences import generate

    model = [("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("b", "c", 3), ("a b", "c", 1), ("a b", "a", 1), ("c", "a", 5)]
    table = spark.createDataFrame(model, "key string, next string, n long")
    got = {r.id: r.words for r in generate(table, spark.createDataFrame([(k, ["a"]) for k in range(20)], "id long, words array<string>"), 8, 2).collect()}
    hashes = {(r.id, r.k): r.h for r in spark.range(20).selectExpr("id", "explode(sequence(0, 7)) as k").selectExpr("id", "k", "xxhash64(id, k, 1) as h").collect()}
    for i in range(20):
        words = ["a"]
        for k in range(8):
            for key in (" ".join(words[-2:]) if len(words) > 1 else None, words[-1]):
                options = sorted((x, n) for h, x, n in model if h == key)
                if len(options) > 1:
                    at = hashes[i, k] % sum(n for _, n in options)
                    for x, n in options:
                        if at < n:
                            words.append(x)
                            break
                        at -= n
                    break
        assert got[i] == words


def test_terms_are_shuffled_once(spark):
    """Counts, norms and weights by key are where the texts were dealt."""
    from fabula.operators import bow

    docs = spark.createDataFrame([(1, "a b a c"), (2, "b b d"), (3, None), (1, "a z")], "doc_id long, text string").repartition(3)
    n = bow.term_counts(docs)
    assert {(r.doc_id, r.term): r.n for r in n.collect()} == {(1, "a"): 3, (1, "b"): 1, (1, "c"): 1, (1, "z"): 1, (2, "b"): 2, (2, "d"): 1}
    plan = bow.l2_normalised(n.withColumn("weight", F.col("n").cast("double")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION") >= 1 and "ENSURE_REQUIREMENTS" not in plan.replace("hashpartitioning(term", "")


def test_block_of_queries_gives_the_same(spark):
    from fabula.operators import bow

    q = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, "y")], "item_id long, gram string")
    d = spark.createDataFrame([(7, "a"), (7, "a"), (7, "b"), (8, "c"), (8, "x"), (9, "z")], "doc_id long, gram string")
    each = [sorted(map(tuple, bow.overlap_share(q, d, "item_id", "doc_id", block=b).collect())) for b in (False, True)]
    assert each[0] == each[1] == [(1, 7, 1.0), (2, 8, 1.0)]
    w = lambda df, k: df.distinct().select(k, F.col("gram").alias("term"), F.lit(0.5).alias("w"))
    dots = [sorted(map(tuple, bow.sparse_dot(w(q, "item_id"), w(d, "doc_id"), "item_id", "doc_id", block=b).collect())) for b in (False, True)]
    assert dots[0] == dots[1] == [(1, 7, 0.5), (2, 8, 0.25)]


def test_boxplot_counts_values_first(spark):
    d = spark.createDataFrame([("x", float(k % 3)) for k in range(9)] + [("x", None), ("y", None)], "g string, v double")
    b = {r.g: tuple(r)[1:] for r in stats.boxplot(d, ["g"], "v").collect()}
    assert b == {"x": (0.0, 0.0, 1.0, 2.0, 2.0), "y": (None,) * 5}
    assert "percentile(v" in (plan := stats.boxplot(d, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Aggregate [") == 2
