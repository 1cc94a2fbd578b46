import re
from collections import Counter
from pathlib import Path

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fabula.llm.host_rules import SQL, digest, host_of, judge, measures

DOCS = "doc_id long, text string, source string, kept string, row int, host string, n_words int"


def plain(text):
    """The measures of one text, window by window."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))


def measured(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    got = measures(spark.createDataFrame(rows, "k int, text string")).collect()
    return [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in sorted(got, key=lambda r: r.row.k)]


def test_measures_of_odd_texts(spark):
    texts = [
        None, "", " \t\n", "a b c d e", "a b c d e a b c d e", "a b c d e f a b c d e f g", "x " * 50, "a b c d e a b c d e a b c d e",
        "one\ntwo\none\n\n\n one\none\r", "é😀 #*     <x>", "l\x0bm\x0cn\ro", "w" * 100_000, "a b c d e\x00f g", "\x1cq w\x1dx",
        " ".join(f"w{k % 700}" for k in range(3000)),
    ]
    assert measured(spark, texts) == [plain(t) for t in texts]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\t\x0bé", max_size=60), min_size=5, max_size=20))
def test_measures_of_any_texts(spark, texts):
    assert measured(spark, texts) == [plain(t) for t in texts]


def fine(k):
    return " ".join(f"t{k}x{j}" for j in range(12))


def test_hosts_lose_their_documents(spark):
    """A host of nearly nothing but failures goes whole; a host with few
    documents is drawn to the corpus; documents without a host stand alone."""
    rows = [(k, fine(k) if k % 10 else "bad", f"good{k % 7}") for k in range(700)]
    rows += [(1000 + k, "bad" if k % 10 else fine(k), "spam") for k in range(200)]
    rows += [(2000, "bad", "tiny"), (2001, fine(1), "tiny")]
    rows += [(3000, fine(2), None), (3001, "bad", None)]
    docs = spark.createDataFrame([(i, t, h, "x", 1, "y", 0) for i, t, h in rows], DOCS)
    got = {r.row.doc_id: r for r in judge(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[k].kept == bool(k % 10) for k in range(700))
    assert not any(got[1000 + k].kept for k in range(200))
    assert got[1000].host_rate > 0.85 and 0.1 < got[2001].host_rate < 0.5 and got[2001].kept
    assert got[3000].kept and got[3000].host_rate is None and not got[3001].kept
    assert got[5].row.kept == "x" and got[5].row.host == "y" and got[5].row.n_words == 0


def test_few_hosts(spark):
    one = spark.createDataFrame([(1, fine(1), "a", "", 1, "", 1), (1, fine(1), "a", "", 1, "", 1), (2, "bad", "a", "", 1, "", 1)], DOCS)
    assert sorted((r.doc_id, r.kept) for r in digest(one).collect()) == [(1, True), (1, True), (2, False)]
    assert digest(one.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, None, None, None, None, None, None)], DOCS)
    assert [tuple(r) for r in digest(alone).collect()] == [(1, 0, 0, 0, 0, 0, True, False)]


def test_host_of_a_url(spark):
    got = spark.createDataFrame([("HTTP://Www.Ex.org:80/a?b",), ("not a url",), (None,)], "u string").select(host_of(F.col("u"))).collect()
    assert [r[0] for r in got] == ["www.ex.org", None, None]


def test_equals_sql_and_plain(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(sf) / 'documents.parquet'}'")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(tuple(r[c] for c in names) for r in digest(docs).collect())
    assert got == sorted(duck.sql(SQL).select(*names).fetchall())
    assert sorted((r.doc_id, *plain(r.text)) for r in docs.collect()) == [x[:6] for x in got]


def test_no_python_on_the_main_path(spark, sf):
    plan = measures(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
