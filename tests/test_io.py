import json
from datetime import datetime, timedelta

import pytest

from fabula.sources import readers, writers
from fabula.streaming import matching


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_documents_and_lines(spark, tmp_path):
    put(tmp_path / "a.txt", "one\ntwo\n")
    put(tmp_path / "b.txt", 'He said "go now" twice')
    assert {r.doc_id: r.text for r in readers.text_documents(spark, str(tmp_path)).collect()} == {"a": "one\ntwo\n", "b": 'He said "go now" twice'}
    assert [(r.n, r.value) for r in readers.lines(spark, str(tmp_path / "a.txt")).orderBy("n").collect()] == [(0, "one"), (1, "two")]


def test_parser_xml(spark, tmp_path):
    p = put(
        tmp_path / "d.xml",
        """<root><document><sentences><sentence id="1"><tokens><token id="1"><word>Dogs</word><lemma>dog</lemma><CharacterOffsetBegin>0</CharacterOffsetBegin><CharacterOffsetEnd>4</CharacterOffsetEnd><POS>NNS</POS></token>
        <token id="2"><word>run</word><lemma>run</lemma><CharacterOffsetBegin>5</CharacterOffsetBegin><CharacterOffsetEnd>8</CharacterOffsetEnd></token></tokens><parse>(S)</parse>
        <dependencies type="basic-dependencies"><dep type="nsubj"><governor idx="2">run</governor><dependent idx="1">Dogs</dependent></dep></dependencies></sentence></sentences>
        <coreference><coreference><mention representative="true"><sentence>1</sentence><start>1</start><end>2</end><head>1</head></mention></coreference></coreference></document></root>""",
    )
    d = readers.parser_xml(spark, p)
    assert [(r.idx, r.offset, r.len, r.pos, r.lemma) for r in readers.parser_tokens(d).collect()] == [(1, 0, 4, "NNS", "dog"), (2, 5, 3, "?", "run")]
    assert [(r.type, r.gov_idx, r.dep_idx) for r in readers.parser_dependencies(d).collect()] == [("nsubj", 2, 1)]
    assert [(r.grp, r.tok_start, r.representative) for r in readers.parser_chains(d).collect()] == [(0, 1, True)]


def test_standoff_layers(spark, tmp_path):
    p = put(
        tmp_path / "s.xml",
        """<story><rep id="token"><desc id="1" off="0" len="4">Dogs</desc><desc id="2" off="5" len="3">run</desc></rep><rep id="pos"><desc id="3" off="0" len="4">1 NNS</desc></rep>
        <rep id="stem"><desc id="4" off="0" len="4">1 dog</desc></rep><rep id="sentence"><desc id="5" off="0" len="8">1~2</desc></rep><rep id="coref"><desc id="6" off="0" len="4">pack|1,7</desc></rep>
        <rep id="function"><desc id="8" off="0" len="8">A|ACTUAL:1~2,IMPLICIT:2</desc></rep></story>""",
    )
    layer = lambda n: readers.standoff_layer(spark, p, n)
    assert [(r.id, r.pos, r.lemma) for r in readers.standoff_tokens(layer("token"), layer("pos"), layer("stem")).orderBy("id").collect()] == [(1, "NNS", "dog"), (2, "?", "run")]
    assert [r.token_id for r in readers.id_lists(layer("sentence")).orderBy("pos").collect()] == [1, 2]
    assert {(r.name, r.member) for r in readers.named_groups(layer("coref")).collect()} == {("pack", 1), ("pack", 7)}
    assert {(r.label, r.kind, tuple(r.token_ids)) for r in readers.located_labels(layer("function")).collect()} == {("A", "ACTUAL", (1, 2)), ("A", "IMPLICIT", (2,))}


def test_small_formats(spark, tmp_path):
    p = put(tmp_path / "c.cnlp", "1\tHe\the\tPRP\t_\t2\tsubj\tO\n2\truns\trun\tVBZ\t_\t0\troot\tO\n\n1\tBye\tbye\tUH\t_\t0\troot\tO\n")
    assert [(r.sent_id, r.idx, r.lemma) for r in readers.conll(spark, p).collect()] == [(0, 1, "he"), (0, 2, "run"), (1, 1, "bye")]
    p = put(tmp_path / "x.ann", "T1\tEntity 0 3\tThe\nA1\tGender T1 male\nA2\tNumber T1 one\n")
    assert [(r.id, r.len, r.attributes) for r in readers.standoff_spans(spark, p).collect()] == [("T1", 3, {"Gender": "male", "Number": "one"})]
    p = put(tmp_path / "f.arff", "@RELATION x\n@ATTRIBUTE a NUMERIC\n@DATA\n1.5,2,A\n0,1,B\n")
    assert [(r.attrs, r.label) for r in readers.arff(spark, p).collect()] == [([1.5, 2.0], "A"), ([0.0, 1.0], "B")]
    p = put(tmp_path / "n.txt", "s a,b t\nt c s\n")
    assert {tuple(r) for r in readers.automaton(spark, p).collect()} == {("s", "a", "t"), ("s", "b", "t"), ("t", "c", "s")}
    p = put(tmp_path / "g.txt", "S -> a B\nB -> b | c\n")
    assert {r.label for r in readers.grammar_terminals(spark, p).collect()} == {"a", "b", "c"}
    p = put(tmp_path / "t.txt", "Root\n\tChild One\n\t\tLeaf\n\tTwo\n")
    assert [(r.child, r.parent) for r in readers.indented(spark, p).orderBy("n").collect()] == [("Root", None), ("Child One", "Root"), ("Leaf", "Child One"), ("Two", "Root")]
    p = put(tmp_path / "r.txt", "a\n1\nb\n2\n")
    assert [(r.name, r.value) for r in readers.records(spark, p, 2, ["name", "value"]).orderBy("record").collect()] == [("a", "1"), ("b", "2")]
    p = put(tmp_path / "m.txt", "junk\n# one\nx\ny\n# two\nz\n")
    assert [(r.header, r.text) for r in readers.marked_blocks(spark, p, "^#").orderBy("block").collect()] == [("# one", "# one\nx\ny"), ("# two", "# two\nz")]
    p = put(tmp_path / "w.txt", "@name x\nbig dog 3\ncat 1\n")
    assert {(r.term, r.n) for r in readers.term_file(spark, p).collect()} == {("big dog", 3), ("cat", 1)}


def test_stories_and_annotations(spark, tmp_path):
    p = put(tmp_path / "st.tsv", "7\t\t\tA\tgo,king/2,horse;!see,king\tThe king\n\t\t\tB\t\trode off\n")
    r = readers.story_rows(spark, p).orderBy("n").collect()
    assert [(x.story_id, x.offset, x.len) for x in r] == [(7, 0, 8), (7, 9, 8)]
    a = readers.inline_annotations(readers.story_rows(spark, p)).collect()
    assert {(x.verb, x.subject, x.object, x.negated) for x in a} == {("go", "king/2", "horse", False), ("see", "king", None, True)}
    t = spark.createDataFrame([("king and king", "king/2"), ("king and king", "king"), ("king", "king/3")], "t string, w string")
    from pyspark.sql import functions as F

    assert [x.o for x in t.select(readers.nth_occurrence(F.col("t"), F.col("w")).alias("o")).collect()] == [9, 0, -1]


def test_survey_and_quotes(spark, tmp_path):
    put(tmp_path / "u1_done.json", json.dumps({"r0-1": ["4"], "c1": "y"}))
    assert {tuple(r) for r in readers.survey_json(spark, str(tmp_path / "u1_done.json")).collect()} == {("u1", "done", "r0-1", "4"), ("u1", "done", "c1", "y")}
    p = put(tmp_path / "q.xml", '<DOC><PARAGRAPH>So <PERSON id="1" entity="3">Anna</PERSON> said: <QUOTE speaker="3">Go.</QUOTE></PARAGRAPH></DOC>')
    got = readers.quoted_xml(spark, p).orderBy("pos").collect()
    assert [(r.kind, r.ref, r.text) for r in got] == [("TEXT", "", "So"), ("PERSON", "3", "Anna"), ("TEXT", "", "said:"), ("QUOTE", "3", "Go.")]


def test_writers(spark, tmp_path):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1.0, 2, "A"), (0.5, 3, "B")], "x double, y int, label string")
    writers.arff(d, str(tmp_path / "a"), "demo", "label", ["A", "B"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert sorted(lines[-2:]) == ["0.5000,3.0000,B", "1.0000,2.0000,A"] and "@DATA" in lines
    s = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "k int, o int, t string")
    j = writers.joined_text(s, "k", "o", "t")
    assert {r.k: r.text for r in j.collect()} == {1: "a\nb", 2: "c"}
    writers.text_per_key(j, str(tmp_path / "t"), "k", "text")
    assert spark.read.text(str(tmp_path / "t")).where("k = 2").first().value == "c"
    writers.tsv(d, str(tmp_path / "v"))
    assert readers.tsv(spark, str(tmp_path / "v"), "x double, y int, label string", header=True).count() == 2
    writers.save_tables({"d": d}, str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set/d")).count() == 2
    assert spark.range(1).select(writers.without_comments(F.lit("a/* x\n */b")).alias("v")).first().v == "ab"
    f = spark.createDataFrame([("s1", 1, "give", ["k", "h"], "e1")], "story string, phase int, head string, args array<string>, name string")
    assert writers.frame_text(f).first().text == "(DEF-STORY\n  (:PHASE 1\n    (e1 give k h)))"


@pytest.mark.parametrize("name", ["rules", "forms"])
def test_streams(spark, tmp_path, name):
    src = tmp_path / "in"
    if name == "rules":
        rows = [(1, datetime(2024, 1, 1) + timedelta(minutes=k), c) for k, c in enumerate("abxab")]
        spark.createDataFrame(rows, "u long, t timestamp, c string").write.parquet(str(src))
        s = spark.readStream.schema("u long, t timestamp, c string").parquet(str(src))
        out = matching.live_rules(s, [("ab", ["a", "b"]), ("bx", ["b", "x"])], key="u", at="t", cls="c")
        q = out.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert sorted(r.rule for r in spark.table("found").collect()) == ["ab", "ab", "bx"]
    else:
        spark.createDataFrame([("u", "{1}", False), ("u", "{12}", False), ("v", "{1}", True), ("v", "{123}", False)], "uid string, payload string, final boolean").write.parquet(str(src))
        s = spark.readStream.schema("uid string, payload string, final boolean").parquet(str(src))
        q = matching.latest_form(s).writeStream.format("memory").queryName("forms").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert {r.uid: (r.payload, r.complete) for r in spark.table("forms").collect()} == {"u": ("{12}", False), "v": ("{1}", True)}
