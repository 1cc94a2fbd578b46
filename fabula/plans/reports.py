"""Queries of reports, votes, rules and set similarities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import shallow
from fabula.functions import text as T
from fabula.operators import filters, narrative, reports
from fabula.plans.registry import query
from fabula.plans.words import WORDS
from fabula.session import table

# Frequent words of each language of the tables.
KNOWN = {"en": "the of and to in is it that a for on with are be this was", "de": "der die das und ist für von zu mit sich auf dem eine einer", "fr": "le la les des et est une pour dans que qui par sur avec", "es": "el la los las de que y en un una con por para se"}
LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{k}')" for k, v in KNOWN.items() for w in v.split()) + ") AS lex(word, guess))"


@query(
    "language_guess",
    f"""WITH {LEX}, w AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1), k AS (SELECT doc_id, guess, count(*) AS k FROM w JOIN lex USING (word) GROUP BY 1, 2),
    b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, guess) = 1) SELECT doc_id, guess, round(coalesce(k / n, 0), 9) AS share FROM n LEFT JOIN b USING (doc_id)""",
)
def language_guess(spark, sf_dir):
    lex = spark.createDataFrame([(w, k) for k, v in KNOWN.items() for w in v.split()], "word string, lang string")
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.words("text")).alias("word"))
    g = narrative.guessed_language(w, lex, ["doc_id"])
    return g.select("doc_id", F.col("lang").alias("guess"), F.round("share", 9).alias("share"))


@query("role_summary", "SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS labels FROM conversations GROUP BY 1")
def role_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("offset"), F.col("role").alias("label"))
    return reports.label_summary(c).withColumnRenamed("doc_id", "conv_id")


@query(
    "before_and_after",
    """WITH v AS (SELECT 'before' AS version, n_chars FROM documents UNION ALL SELECT 'after', n_chars FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id))
    SELECT version, CAST(sum(n_chars) AS BIGINT) AS sum_n_chars, round(avg(n_chars), 6) AS mean_n_chars FROM v GROUP BY 1""",
)
def before_and_after(spark, sf_dir):
    """Corpus statistics before and after a filter (AGG19)."""
    d = table(spark, sf_dir, "documents")
    kept = d.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return reports.before_and_after(d, kept, ["n_chars"]).withColumn("mean_n_chars", F.round("mean_n_chars", 6))


@query(
    "group_statistics",
    """WITH m AS (SELECT l_orderkey AS doc_id, l_linenumber AS mention_id, l_suppkey AS grp, l_returnflag AS symbol, l_linestatus = 'O' AS character FROM lineitem), p AS (SELECT DISTINCT doc_id, grp, symbol FROM m WHERE symbol IS NOT NULL),
    g AS (SELECT doc_id, avg(k) AS a FROM (SELECT doc_id, grp, count(*) AS k FROM p GROUP BY 1, 2) GROUP BY 1), s AS (SELECT doc_id, avg(k) AS b FROM (SELECT doc_id, symbol, count(*) AS k FROM p GROUP BY 1, 2) GROUP BY 1)
    SELECT doc_id, count(*) AS mentions, count(DISTINCT grp) AS groups, count(DISTINCT symbol) AS symbols, count(DISTINCT CASE WHEN character THEN symbol END) AS characters, round(any_value(a), 9) AS symbols_per_group, round(any_value(b), 9) AS groups_per_symbol
    FROM m LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id) GROUP BY 1""",
)
def group_statistics(spark, sf_dir):
    """Lines of an order as mentions, suppliers as groups, flags as symbols."""
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("mention_id"), F.col("l_suppkey").alias("grp"), F.col("l_returnflag").alias("symbol"), (F.col("l_linestatus") == "O").alias("character")
    )
    r = reports.group_statistics(m)
    return r.withColumns({c: F.round(c, 9) for c in ("symbols_per_group", "groups_per_symbol")})


VOTES = """WITH x AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = 'user' THEN 'assistant' WHEN lag(role) OVER w = 'assistant' THEN 'user' END AS a, CASE WHEN contains(text, '?') THEN 'user' END AS b, CASE WHEN length(text) > 400 THEN 'assistant' END AS c
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), v AS (SELECT conv_id, turn, 'a' AS rule, role, a AS vote FROM x UNION ALL SELECT conv_id, turn, 'b', role, b FROM x UNION ALL SELECT conv_id, turn, 'c', role, c FROM x),
w AS (SELECT rule, (count(*) FILTER (vote = role) + 1.0) / (count(vote) + 2.0) AS weight FROM v GROUP BY 1)"""


@query(
    "weighted_vote",
    VOTES + """, s AS (SELECT conv_id, turn, vote, round(CAST(sum(weight) AS DOUBLE), 9) AS score FROM v JOIN w USING (rule) WHERE vote IS NOT NULL GROUP BY 1, 2, 3)
    SELECT conv_id, turn, vote, score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, vote) = 1""",
)
def weighted_vote(spark, sf_dir):
    """Speakers picked by weighted rules (SEQ18); weights are the rules' smoothed
    accuracies on the same turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("role").over(w)
    x = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.when(before == "user", "assistant").when(before == "assistant", "user").alias("a"),
        F.when(F.contains("text", F.lit("?")), "user").alias("b"), F.when(F.length("text") > 400, "assistant").alias("c"),
    )
    v = x.unpivot(["conv_id", "turn", "role"], ["a", "b", "c"], "rule", "vote")
    weights = v.groupBy("rule").agg(((F.count_if(F.col("vote") == F.col("role")) + 1.0) / (F.count("vote") + 2.0)).alias("weight"))
    return narrative.weighted_vote(v.where("vote is not null").select("conv_id", "turn", "rule", "vote"), weights, ["conv_id", "turn"])


@query(
    "rule_windows",
    """WITH t AS (SELECT role AS c, lag(role, 1) OVER w AS p1, lag(role, 2) OVER w AS p2, lead(role, 1) OVER w AS n1, lead(role, 2) OVER w AS n2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    b AS (SELECT unnest(['', p1 || ' ', p2 || ' ' || p1 || ' ']) AS l, c, n1, n2 FROM t WHERE c = 'assistant'), r AS (SELECT l || c || unnest(['', ' ' || n1, ' ' || n1 || ' ' || n2]) AS rule FROM b) SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY 1""",
)
def rule_windows(spark, sf_dir):
    """Windows of roles around each assistant turn as rules (SEQ16)."""
    return narrative.rule_windows(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "assistant", 2)


CONCEPTS = """c AS (SELECT DISTINCT l_suppkey AS term, 'flag' AS relation, l_returnflag || l_linestatus AS concept FROM lineitem UNION SELECT DISTINCT l_suppkey, 'tax', CAST(floor(l_tax * 100) AS INT)::VARCHAR FROM lineitem)"""


@query(
    "concept_overlap",
    f"""WITH {CONCEPTS}, s AS (SELECT term, list_sort(list(relation || ':' || concept)) AS held FROM c GROUP BY 1), m AS (SELECT term, min(term) OVER (PARTITION BY held) AS head FROM s),
    h AS (SELECT term, relation, concept FROM c JOIN (SELECT DISTINCT head FROM m) ON term = head), n AS (SELECT term, count(*) AS n FROM h GROUP BY 1),
    p AS (SELECT a.term AS l, b.term AS r, count(*) AS shared FROM h a JOIN h b ON a.relation = b.relation AND a.concept = b.concept GROUP BY 1, 2)
    SELECT 'pair' AS kind, l AS "left", r AS "right", round(shared / (x.n + y.n - shared), 9) AS similarity FROM p JOIN n x ON x.term = l JOIN n y ON y.term = r
    UNION ALL SELECT 'member', term, head, 1.0 FROM m""",
)
def concept_overlap(spark, sf_dir):
    """Suppliers by shared concepts, relation by relation (SET8)."""
    l = table(spark, sf_dir, "lineitem")
    a = l.select(F.col("l_suppkey").alias("term"), F.lit("flag").alias("relation"), F.concat("l_returnflag", "l_linestatus").alias("concept"))
    b = l.select("l_suppkey", F.lit("tax"), F.floor(F.col("l_tax") * 100).cast("int").cast("string"))
    c = a.union(b).distinct()
    heads = narrative.concept_classes(c)
    alone = c.join(heads.where("term = head").select("term"), "term", "left_semi")
    pairs = narrative.concept_overlap(alone, alone).select(F.lit("pair").alias("kind"), "left", "right", F.round("similarity", 9).alias("similarity"))
    return pairs.union(heads.select(F.lit("member"), "term", "head", F.lit(1.0)))


@query(
    "sentence_moods",
    r"""WITH s AS (SELECT item_id, lower(text) AS t FROM benchmark) SELECT item_id, CASE WHEN regexp_matches(t, '\b(if|were i|wish|as if)\b.*\bwere\b', 's') THEN 'subjunctive' WHEN regexp_matches(t, '\b(would|could|should|might|may)\b|\bif\b') THEN 'conditional'
      WHEN regexp_matches(t, '^(please |do |don''t |let |go |come |take |give |stop )') THEN 'imperative' ELSE 'indicative' END AS mood, contains(t, 'the') AS has_the FROM s""",
)
def sentence_moods(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", shallow.mood(F.col("text")).alias("mood"), T.wildcard(F.regexp_replace(F.lower("text"), "\n", " "), "*the*").alias("has_the"))


@query(
    "constrained_words",
    f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS t FROM documents) SELECT t AS token, count(*) AS n FROM w WHERE (starts_with(t, 'th') OR ends_with(t, 'ing')) AND NOT contains(t, 'x') GROUP BY 1""",
)
def constrained_words(spark, sf_dir):
    """Words that meet a wildcard constraint (FLT13, FLT14), counted."""
    w = table(spark, sf_dir, "documents").select(F.explode(T.words("text")).alias("token"))
    hit = w.where(filters.constraint(words=["th*", "*ing"], exclude=T.wildcard(F.col("token"), "*x*")))
    return hit.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("frequent_sources", "SELECT source, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, source) AS INT) AS rank FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def frequent_sources(spark, sf_dir):
    return reports.ranked_by_frequency(table(spark, sf_dir, "documents"), "source", 5)


@query("stemmed_terms")
def stemmed_terms(spark, sf_dir):
    """Term counts by stem (STR30); each distinct word is stemmed once."""
    from fabula.functions.stem import stems

    n = table(spark, sf_dir, "documents").select(F.explode(T.words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return n.join(stems(n), "word").groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
