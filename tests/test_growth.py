"""Work that grows no faster than the input."""

import numpy as np
from pyspark.ml.classification import OneVsRest
from pyspark.sql import functions as F

from fabula.operators import bow, classify, cluster, mentions, rules, semantics
from fabula.plans import files, queries, structure
from fabula.sources import formats, standoff


def counted(df, spark):
    """The rows of df and a counter of how often they are made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    return df.mapInPandas(run, df.schema), made


def test_folds_share_one_count_of_terms(spark):
    terms = spark.createDataFrame([(d, t, 1 + d % 3) for d in range(40) for t in {f"t{d % 4}", f"t{d % 7}", "all", f"own{d}"}], "doc_id long, term string, n long")
    rows = [(d, d % 2) for d in range(30)] + [(3, 0), (5, None), (None, 1), (99, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, label int")
    made_terms, made = counted(terms, spark)
    got = {r.fold: (r.n, r.accuracy) for r in classify.cross_validate(made_terms, labels, 9).collect()}
    assert made.value == terms.count()
    parted = classify.folds(labels, "doc_id", 9)
    for f in range(9):
        train, test = parted.where(F.col("fold") != f), parted.where(F.col("fold") == f)
        s = classify.naive_bayes(terms, train.drop("fold"), terms.join(test.select("doc_id"), "doc_id", "left_semi"))
        right = classify.best_class(s).withColumnRenamed("label", "guess").join(test, "doc_id")
        n, accuracy = right.agg(F.count(F.lit(1)), F.avg((F.col("guess") == F.col("label")).cast("double"))).first()
        assert got[f] == (n, accuracy)


def small_layers(spark):
    row = lambda name, value: standoff.as_layer(spark.createDataFrame([("d", 1, 0, 5, value)], "doc_id string, id long, offset long, len long, value string"), name)
    return [row("sentence", "7~8~9"), row("parse", "(S (NP a b) (VP (VB c)))"), row("role", "2 user be.01 ----a 0:0-ARG0- 1:1,2:1-ARGM-ALL 2:9-ARG3-")]


def test_layers_are_parsed_once(spark):
    rows = files.written_standoff(*small_layers(spark))
    assert rows.inputFiles() and all(f.endswith(".parquet") for f in rows.inputFiles())  # scans of a table, whatever the number of layers


def test_trees_are_parsed_once_for_roles(spark):
    roles = standoff.verb_roles(files.written_standoff(*small_layers(spark)))
    plan = roles._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {(r.label, *r.token_ids, r.verb_token) for r in roles.collect()} == {("A0", 7, 8, 9), ("AM-ALL", 7, 8, 9, 9)}


def test_products_are_made_once(spark):
    block, made = counted(spark.createDataFrame([(f"t{k}", float(k), 1.0 / (1 + k)) for k in range(20)], "term string, q0 double, q1 double"), spark)
    turned, b = semantics.orthonormal(block, "term", 2)
    g = semantics.gram(turned, b)
    assert b == 2 and abs(g - [[1, 0], [0, 1]]).max() < 1e-9 and made.value == 20


def test_rules_are_learnt_once(spark, sf, monkeypatch):
    seen, loosened = [], rules.loosened

    def once(taught):
        df, made = counted(loosened(taught), spark)
        seen.append(made)
        return df

    monkeypatch.setattr(rules, "loosened", once)
    known = []
    assigned = rules.assigned
    monkeypatch.setattr(rules, "assigned", lambda *a, **b: known.append(b["known"]) or assigned(*a, **b))
    queries()["rules_learnt"](spark, sf)
    assert seen[0].value == known[0].count()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_are_shuffled_once(spark, sf):
    assert exchanges(queries()["role_shares"](spark, sf)) == 1


def test_flags_take_one_aggregate_of_the_tokens(spark, sf):
    plan = queries()["word_list_flags"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1  # none beside that with the lists


def test_heads_merge_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr("fabula.operators.components.cut", lambda df: 1 / 0)  # no rounds
    chain = [(d, k, k, [("NN", f"h{k}"), ("NN", f"h{k + 1}")]) for d in (1, 2) for k in range(30 - 20 * (d - 1))] + [(2, 90, 90, [("NN", "x")]), (3, 5, 5, [("NNS", "h1")])]
    m = spark.createDataFrame(chain, "doc_id long, mention_id long, grp long, tokens array<struct<pos:string,lemma:string>>").repartition(3)
    got = {(r.doc_id, r.mention_id): r.grp for r in mentions.merged_by_head(m, 2).collect()}
    assert got == {(d, k): 0 if k < 90 and d < 3 else k for d, k, _, _ in chain}


def test_neighbours_are_counted_once(spark, sf):
    plan = queries()["cooccurrence_window"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "posexplode" not in plan and "least(" in plan  # no array beside each word, a pair in one order


def test_parts_grow_with_the_lines(spark, sf, monkeypatch):
    monkeypatch.setattr(structure, "LINES_A_TASK", 500, raising=False)
    assert structure.lines(spark, sf).rdd.getNumPartitions() == -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)


def test_labels_machines_are_fitted_together(spark, monkeypatch):
    seen, fit = [], OneVsRest.fit
    monkeypatch.setattr(OneVsRest, "fit", lambda self, *a: seen.append(self.getParallelism()) or fit(self, *a))
    rows = spark.createDataFrame([([1.0, 0.1], 0), ([0.1, 1.0], 1), ([-1.0, -1.0], 2)] * 4, "v array<double>, y int")
    model = cluster.linear_svm(rows, "v", "y", 10)
    assert seen[0] > 1 and {(r.y, int(r.predicted)) for r in model.transform(cluster.vectors(rows, "v")).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_leaders_are_those_of_a_whole_sort():
    rng = np.random.default_rng(1)
    for n, k in ((3, 5), (40, 5), (40, 1)):
        sim, own = np.round(rng.random((6, n)), 1), rng.permutation(n)
        sim[0], sim[1, ::2] = -2, -2
        row, column = classify.leaders(sim, own, k)
        want = np.lexsort((np.broadcast_to(own, sim.shape), -sim), axis=1)[:, :k]
        assert column.tolist() == want.reshape(-1).tolist() and row.tolist() == np.repeat(np.arange(6), want.shape[1]).tolist()
    q, v, w = rng.random((5, 7)), rng.random((300, 7)), rng.random(7)
    q[0] = v[0] = 0
    lo, hi = ((w * f(q[:, None], v[None])).sum(2) for f in (np.minimum, np.maximum))
    assert np.allclose(classify.similarities(q, v, list(w)), np.where(hi == 0, 0.5, lo / np.where(hi == 0, 1, hi)), atol=1e-12)


def test_stories_take_a_folder_for_each_task(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "new_folder", lambda *a: str(tmp_path / "texts"))
    got = queries()["story_texts"](spark, sf).collect()
    folders = [f for f in (tmp_path / "texts").iterdir() if f.is_dir()]
    assert len(got) == len(list((tmp_path / "texts").glob("*/*.txt"))) and len(folders) <= 4 < len(got)


def test_stories_keep_key_and_text(spark, tmp_path):
    formats.register(spark)
    rows = [("a/b.c", "x\ny"), ("_é", ""), (None, "z"), ("a/b.c", "again"), ("", "\n")]
    spark.createDataFrame(rows, "doc_id string, text string").repartition(2).write.format("stories").mode("overwrite").save(str(tmp_path / "s"))
    assert sorted((r.doc_id or "-", r.text) for r in spark.read.format("stories").load(str(tmp_path / "s")).collect()) == sorted((d or "-", t + "\n") for d, t in rows)


def test_only_possible_keywords_meet_the_frequencies(spark):
    rows = [(d, t, n) for d in range(60) for t, n in {"all": 5, f"t{d % 3}": 2, f"u{d % 20}": 1 + d % 4, f"own{d}": 1, f"v{d // 2}": 1, "most" if d else "x": 1}.items()]
    rows += [(None, "all", 3), (None, "own1", 1), (70, "all", 1), (71, "u1", 2), (71, "u2", 2), (71, "u3", 2)]
    terms, n = spark.createDataFrame(rows, "doc_id long, term string, n long"), 65
    want = bow.keywords(bow.tf_idf(terms, n), 2)
    got = bow.keywords(bow.top_tf_idf(terms, n, 2, common=4), 2)
    rounded = lambda df: {(r.doc_id, r.term, r["rank"], r.n, r.df, round(r.weight, 12), round(r.share, 12)) for r in df.collect()}
    assert rounded(got) == rounded(want) and want.count() == 123
    assert bow.candidates(terms, bow.document_frequency(terms, n), n, 2, common=4).count() < 0.75 * len(rows)


def test_keywords_sort_no_term_of_every_document(spark, sf):
    plan = queries()["doc_keywords"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2  # stop words and common terms move no term


def test_stop_words_move_no_term(spark, sf):
    plan = queries()["term_counts_threshold"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_alike_turns_are_not_shuffled(spark, sf):
    """tiles are read by the tasks; neither sets nor pairs meet in a join after that."""
    plan = queries()["retrieval_scores"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_both_ways_give_the_same_scores(spark, sf, monkeypatch):
    """By tiles, and by prefixes that are verified afterwards, second sets included."""
    want = sorted(map(tuple, queries()["retrieval_scores"](spark, sf).collect()))
    monkeypatch.setattr("fabula.operators.setjoin.MEETING", 0)
    monkeypatch.setattr("fabula.operators.setjoin.by_tiles", lambda *a: 1 / 0)
    assert sorted(map(tuple, queries()["retrieval_scores"](spark, sf).collect())) == want and want


def test_sequences_of_classes_are_read_once(spark):
    """not once for each token that begins one."""
    table = rules.rule_table(spark, ["P ?S Q > Q.s=P", "_Q1 ?. P Q2 > Q2.l=Q1.s"])
    one = [(0, "P", "a"), (1, "S", None), (2, "q!", None), (3, ".", None), (4, "P", "b"), (5, "q~", None)]
    found = [rules.shapes(spark.createDataFrame([(s, *x) for s in range(n) for x in one], "story long, pos long, cls string, ref string"), table)[1].count() for n in (1, 40)]
    assert found[0] == found[1] == 3


def test_stories_are_elected_in_parts(spark, monkeypatch):
    """whatever the parts, all stories' votes count, and passes shuffle none."""
    one = [(0, "P", "a"), (1, "S", None), (2, "q!", None), (3, ".", None), (4, "P", "b"), (5, "q~", None), (6, "q!", None)]
    t = spark.createDataFrame([(s, p, c, r if s % 3 else "b") for s in range(30) for p, c, r in one if (s + p) % 5], "story long, pos long, cls string, ref string")
    gold = spark.createDataFrame([(s, p, f, "ab"[(s + p) % 2]) for s in range(30) for p in (2, 5, 6) for f in "sl"], "story long, pos long, field string, value string")
    table = rules.rule_table(spark, ["P ?S Q > Q.s=P", "P Q > Q.s=P", "_Q1 ?. P Q2 > Q2.l=Q1.s", "_Q1 Q2 > Q2.l=Q1.s", "Q ?. P > Q.l=P"])
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    whole = [rows(df) for df in rules.assigned(t, gold, table, method="bayes")]
    monkeypatch.setattr(rules, "VOTES", 7)
    out, weights = rules.assigned(t, gold, table, method="bayes")
    assert [rows(out), rows(weights)] == whole and all(whole)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
