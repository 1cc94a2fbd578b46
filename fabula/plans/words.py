"""Queries of the bag-of-words and text groups over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators import bow
from fabula.plans.registry import query
from fabula.session import table

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
TERMS = f"""terms AS (
  SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL
)"""
#: A short stop list of the four languages of the tables.
STOP = "the of and to in is it that a for on with la de le les et un une der die das und que el en y los".split()


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bow.term_counts(table(spark, sf_dir, "documents"))


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP], "term string")


STOP_SQL = "stop AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in STOP) + "]) AS term)"


@query(
    "doc_keywords",
    f"""WITH {TERMS}, {STOP_SQL}, kept AS (SELECT * FROM terms WHERE term NOT IN (SELECT term FROM stop)),
    tot AS (SELECT doc_id, sum(n) AS total FROM kept GROUP BY 1), df AS (SELECT term, count(*) AS df FROM kept GROUP BY 1),
    w AS (SELECT doc_id, term, (n / total) * ln((SELECT count(*) FROM documents) / df) AS weight FROM kept JOIN tot USING (doc_id) JOIN df USING (term)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM w QUALIFY rank <= 10)
    SELECT doc_id, term, rank, round(weight, 8) AS weight, round(weight / sum(weight) OVER (PARTITION BY doc_id), 6) AS share FROM r""",
)
def doc_keywords(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = bow.term_counts(docs, stop=stop_words(spark))
    best = bow.keywords(bow.top_tf_idf(counted, docs.count(), 10), 10)
    return best.select("doc_id", "term", F.col("rank").cast("long").alias("rank"), F.round("weight", 8).alias("weight"), F.round("share", 6).alias("share"))


@query("term_df", f"WITH {TERMS} SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)), 9) AS idf FROM terms GROUP BY term")
def term_df(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return bow.document_frequency(terms(spark, sf_dir), n).select("term", "df", F.round("idf", 9).alias("idf"))


@query("term_frequency", f"WITH {TERMS} SELECT doc_id, term, n, round(n / sum(n) OVER (PARTITION BY doc_id), 9) AS tf FROM terms")
def term_frequency(spark, sf_dir):
    return bow.term_frequency(terms(spark, sf_dir)).select("doc_id", "term", "n", F.round("tf", 9).alias("tf"))


@query("term_counts_threshold", f"WITH {TERMS}, {STOP_SQL} SELECT doc_id, term, n FROM terms WHERE n >= 3 AND term NOT IN (SELECT term FROM stop)")
def term_counts_threshold(spark, sf_dir):
    return bow.term_counts(table(spark, sf_dir, "documents"), stop=stop_words(spark), least=3)


@query("top_terms", f"WITH {TERMS} SELECT term, CAST(sum(n) AS BIGINT) AS n FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 100")
def top_terms(spark, sf_dir):
    return terms(spark, sf_dir).groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query("vector_norms", f"WITH {TERMS} SELECT doc_id, count(*) AS n_terms, round(sqrt(sum(n * n)), 9) AS norm FROM terms GROUP BY doc_id")
def vector_norms(spark, sf_dir):
    return terms(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sqrt(F.sum(F.col("n") * F.col("n"))), 9).alias("norm"))


@query("inverted_index", f"WITH {TERMS} SELECT term, doc_id, count(*) OVER (PARTITION BY term) AS df FROM terms")
def inverted_index(spark, sf_dir):
    """A row per posting: a list per term would not be bounded."""
    t = terms(spark, sf_dir)
    return t.join(t.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").select("term", "doc_id", "df")


@query(
    "model_summary",
    f"""WITH {TERMS} SELECT count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_terms, count(*) AS postings,
    round(count(*) / (count(DISTINCT term) * count(DISTINCT term)), 12) AS density FROM terms""",
)
def model_summary(spark, sf_dir):
    return bow.density(terms(spark, sf_dir)).withColumn("density", F.round("density", 12))


@query(
    "vector_space_search",
    f"""WITH {TERMS}, q AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL),
    dn AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM terms GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM q GROUP BY 1),
    s AS (SELECT item_id, doc_id, round(sum(q.n / qn.norm * (terms.n / dn.norm)), 9) AS similarity
      FROM q JOIN qn USING (item_id) JOIN terms USING (term) JOIN dn USING (doc_id) GROUP BY 1, 2)
    SELECT item_id, doc_id, similarity, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""",
)
def vector_space_search(spark, sf_dir):
    """Benchmark items as queries against all documents, cosine of counts."""
    d = bow.l2_normalised(terms(spark, sf_dir).withColumn("weight", F.col("n").cast("double")))
    q = bow.term_counts(table(spark, sf_dir, "benchmark"), key="item_id").withColumn("weight", F.col("n").cast("double"))
    sim = bow.sparse_dot(bow.l2_normalised(q, "item_id"), d, "item_id", "doc_id", block=True).withColumn("similarity", F.round("similarity", 9))
    best = bow.best_per(sim, "item_id", [F.desc("similarity"), F.asc("doc_id")], 5)
    return best.withColumn("rank", F.col("rank").cast("long"))


GRAMS = "list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))"


@query(
    "overlap_vs_benchmark",
    f"""WITH d AS (SELECT DISTINCT doc_id, unnest({GRAMS}) AS gram FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= 3),
    b AS (SELECT DISTINCT item_id, unnest({GRAMS}) AS gram FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) >= 3),
    t AS (SELECT item_id, count(*) AS total FROM b GROUP BY 1)
    SELECT item_id, doc_id, round(least(1.0, count(*) / any_value(total)), 9) AS share FROM b JOIN d USING (gram) JOIN t USING (item_id)
    GROUP BY 1, 2 HAVING count(*) / any_value(total) > 0.1""",
)
def overlap_vs_benchmark(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.ngrams(T.words("text"), 3)).alias("gram"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.ngrams(T.words("text"), 3)).alias("gram"))
    return bow.overlap_share(b, d, "item_id", "doc_id", block=True).where("share > 0.1").withColumn("share", F.round("share", 9))


@query(
    "char_ngram_counts",
    """WITH g AS (SELECT unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, CAST(i AS INT), 3))) AS gram
      FROM (SELECT lower(coalesce(text, '')) AS t FROM documents) WHERE length(t) >= 3) SELECT gram, count(*) AS n FROM g GROUP BY gram""",
)
def char_ngram_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(T.character_ngrams(F.lower(F.coalesce("text", F.lit(""))), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(
    "word_bigrams",
    f"""WITH g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT {WORDS} AS w FROM documents) WHERE len(w) >= 2)
    SELECT gram, count(*) AS n FROM g GROUP BY gram""",
)
def word_bigrams(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(T.ngrams(T.words("text"), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ttr_moving",
    f"""SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) >= 20 THEN round(CAST(list_sum(list_transform(range(1, len(w) - 18), lambda i: len(list_distinct(w[i:i+19])))) AS DOUBLE)
      / (20 * (len(w) - 19)), 9) END AS ttr FROM (SELECT doc_id, {WORDS} AS w FROM documents)""",
)
def ttr_moving(spark, sf_dir):
    """Mean type-token ratio over all windows of 20 words; shorter: null."""
    w = F.col("w")
    kinds = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.size(w) - 19), lambda i: F.size(F.array_distinct(F.slice(w, i, F.lit(20))))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    d = table(spark, sf_dir, "documents").select("doc_id", T.words("text").alias("w"))
    return d.select("doc_id", F.size(w).cast("long").alias("n_words"), F.when(F.size(w) >= 20, F.round(kinds / (20 * (F.size(w) - 19)), 9)).alias("ttr"))


@query(
    "reading_ease",
    rf"""WITH c AS (SELECT doc_id, len({WORDS}) AS nw, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[.!?]+'))) AS ns,
      len(regexp_extract_all(lower(coalesce(text, '')), '{T.VOWELS}')) AS ny FROM documents)
    SELECT doc_id, nw AS n_words, ns AS n_sentences, ny AS n_syllables, CASE WHEN nw > 0 THEN round(206.835 - 1.015 * nw / ns - 84.6 * ny / nw, 6) END AS ease FROM c""",
)
def reading_ease(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    c = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(T.words("text")).cast("long").alias("n_words"),
        F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]+"))).cast("long").alias("n_sentences"),
        T.syllables(text).cast("long").alias("n_syllables"),
    )
    ease = T.reading_ease(F.col("n_words").cast("double"), F.col("n_sentences"), F.col("n_syllables"))
    return c.withColumn("ease", F.when(F.col("n_words") > 0, F.round(ease, 6)))


@query(
    "cooccurrence_window",
    f"""WITH p AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
    n AS (SELECT term AS a, lead(term, 1) OVER w AS b, lead(term, 2) OVER w AS c FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    q AS (SELECT a AS term1, b AS term2 FROM n UNION ALL SELECT b, a FROM n UNION ALL SELECT a, c FROM n UNION ALL SELECT c, a FROM n)
    SELECT term1, term2, count(*) AS n FROM q WHERE term1 IS NOT NULL AND term2 IS NOT NULL GROUP BY 1, 2""",
)
def cooccurrence_window(spark, sf_dir):
    """Pairs within two words of each other (WIN8). A pair is counted once, in
    the order of its words, and turned round when all are counted."""

    def after(w: Column, k: int) -> Column:
        return F.zip_with(w, F.slice(w, k + 1, F.size(w)), lambda a, b: F.when(b.isNotNull(), F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))

    # The array is bound once: a document's words are not looked for again.
    both = F.flatten(F.transform(F.array(T.words("text")), lambda w: F.concat(after(w, 1), after(w, 2))))
    pairs = table(spark, sf_dir, "documents").select(F.explode(both).alias("p")).where("p is not null").select("p.a", "p.b")
    n = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    turned = lambda x, y, k: F.struct(F.col(x).alias("term1"), F.col(y).alias("term2"), k.alias("n"))
    out = F.when(F.col("a") == F.col("b"), F.array(turned("a", "b", F.col("n") * 2))).otherwise(F.array(turned("a", "b", F.col("n")), turned("b", "a", F.col("n"))))
    return n.select(F.explode(out).alias("p")).select("p.*")


def less_letters(word: Column) -> Column:
    """The word, and what is left of it without any one or two letters."""

    def less(x: Column) -> Column:
        gone = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        return F.when(F.length(x) > 0, gone).otherwise(F.array(x))

    return F.array_distinct(F.concat(F.array(word), less(word), F.flatten(F.transform(F.array_distinct(less(word)), less))))


def suggestions(words: DataFrame, counts: DataFrame) -> DataFrame:
    """Known words within two edits of each word, ranked by frequency (STR18).
    Two words within two edits share a variant with at most two letters left
    out, which makes the comparison an equi-join; the distance is verified."""
    b = words.select("word", F.explode(less_letters(F.col("word"))).alias("variant"))
    v = counts.select("term", F.explode(less_letters(F.col("term"))).alias("variant"))
    near = b.join(v, "variant").select("word", "term").distinct().withColumn("distance", F.levenshtein("word", "term")).where("distance between 1 and 2")
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "distance", "term"))
    return near.join(counts, "term").select("word", "term", "distance", "n", rank.alias("rank"))


@query("near_terms")
def near_terms(spark, sf_dir):
    """Spelling suggestions from the corpus for every benchmark word."""
    v = table(spark, sf_dir, "documents").select(F.explode(T.words("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf_dir, "benchmark").select(F.explode(T.words("text")).alias("word")).distinct()
    return suggestions(b, v)


@query(
    "bigram_dice",
    """WITH p AS (SELECT item_id, lower(text) AS t FROM benchmark), g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, CAST(i AS INT), 2))) AS gram FROM p),
    c AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1)
    SELECT a.item_id AS item1, b.item_id AS item2, round(2.0 * count(*) / (any_value(ca.n) + any_value(cb.n)), 9) AS dice
    FROM g a JOIN g b ON a.gram = b.gram AND a.item_id < b.item_id JOIN c ca ON ca.item_id = a.item_id JOIN c cb ON cb.item_id = b.item_id GROUP BY 1, 2""",
)
def bigram_dice(spark, sf_dir):
    """Dice coefficient of the character bigram sets of benchmark items."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.character_ngrams(F.lower("text"), 2)).alias("g"))
    g = b.select("item_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    other = g.select(F.col("item_id").alias("item2"), F.col("n").alias("n2"), "gram")
    pairs = g.join(other, "gram").where("item_id < item2").groupBy(F.col("item_id").alias("item1"), "item2", "n", "n2").count()
    return pairs.select("item1", "item2", F.round(2.0 * F.col("count") / (F.col("n") + F.col("n2")), 9).alias("dice"))


@query(
    "suffix_table",
    f"""WITH v AS (SELECT DISTINCT unnest({WORDS}) AS term FROM documents), s AS (SELECT right(term, 3) AS suffix, substr(term, 1, length(term) - 3) AS base FROM v WHERE length(term) >= 5)
    SELECT suffix, count(*) AS n, round(count(DISTINCT base) / (SELECT count(DISTINCT base) FROM s), 9) AS base_share FROM s GROUP BY suffix ORDER BY n DESC, suffix LIMIT 50""",
)
def suffix_table(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select(F.explode(T.words("text")).alias("term")).distinct().where(F.length("term") >= 5)
    s = v.select(F.substring("term", -3, 3).alias("suffix"), F.expr("substring(term, 1, length(term) - 3)").alias("base"))
    total = s.agg(F.countDistinct("base").alias("bases"))
    counted = s.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("base").alias("b")).crossJoin(F.broadcast(total))  # one row
    return counted.select("suffix", "n", F.round(F.col("b") / F.col("bases"), 9).alias("base_share")).orderBy(F.desc("n"), "suffix").limit(50)


@query("spelling_model", f"WITH w AS (SELECT unnest({WORDS}) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word")
def spelling_model(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "top_group_terms",
    f"""WITH t AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest({WORDS}) AS term FROM documents) GROUP BY ALL),
    g AS (SELECT source, count(*) AS distinct_terms FROM t GROUP BY 1), df AS (SELECT term, sum(n) AS occurrences FROM t GROUP BY 1),
    s AS (SELECT source, term, round(n / distinct_terms * ln((SELECT sum(n) FROM t) / occurrences), 9) AS score FROM t JOIN g USING (source) JOIN df USING (term)),
    m AS (SELECT term, max(score) AS score FROM s GROUP BY term)
    SELECT term, score, row_number() OVER (ORDER BY score DESC, term) AS rank FROM m ORDER BY score DESC, term LIMIT 25""",
)
def top_group_terms(spark, sf_dir):
    """Terms that stand out in some source (TOP9, TOP14): term frequency over
    the group's distinct terms, frequency of occurrences over all groups."""
    d = table(spark, sf_dir, "documents")
    t = d.select("source", F.explode(T.words("text")).alias("term")).groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))
    g = t.groupBy("source").agg(F.count(F.lit(1)).alias("distinct_terms"))
    df = t.groupBy("term").agg(F.sum("n").alias("occurrences"))
    total = t.agg(F.sum("n").alias("total"))
    s = t.join(g, "source").join(df, "term").crossJoin(F.broadcast(total))  # one row
    s = s.withColumn("score", F.round(F.col("n") / F.col("distinct_terms") * F.log(F.col("total") / F.col("occurrences")), 9))
    m = s.groupBy("term").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "term").limit(25)
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "term")).cast("long"))  # 25 rows
