"""Queries of word patterns, repaired tags and entities over conversations.

Tags by form: CAP (a capital first), NUM (a digit first), PUN (no letter or
digit), else LOW."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.operators import patterns, tagging
from fabula.plans.files import WORDS, words
from fabula.plans.registry import query
from fabula.session import table

LETTER = "CASE WHEN regexp_matches(word, '^[A-Z]') THEN 'C' WHEN regexp_matches(word, '^[0-9]') THEN 'N' WHEN NOT regexp_matches(word, '[a-zA-Z0-9]') THEN 'P' ELSE 'L' END"
BY = ["doc_id", "turn"]


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, turn, k, token, tag."""
    w = words(spark, sf_dir)
    tag = F.when(F.col("word").rlike("^[A-Z]"), "CAP").when(F.col("word").rlike("^[0-9]"), "NUM").when(~F.col("word").rlike("[a-zA-Z0-9]"), "PUN").otherwise("LOW")
    return w.select(*BY, "k", F.col("word").alias("token"), tag.alias("tag"))


@query(
    "word_patterns",
    f"""WITH {WORDS}, s AS (SELECT doc_id, turn, string_agg({LETTER}, '' ORDER BY k) AS s FROM w GROUP BY ALL), m AS (SELECT doc_id, turn, unnest(regexp_extract_all(s, 'L?C+[LPN]L*')) AS m FROM s)
    SELECT doc_id, turn, count(*) AS matches, sum(length(m))::BIGINT AS tokens, sum(length(regexp_extract(m, 'C+')))::BIGINT AS capitals, count(*) FILTER (starts_with(m, 'L')) AS with_first FROM m GROUP BY ALL""",
)
def word_patterns(spark, sf_dir):
    """Leftmost-longest matches of optional, repeated, negated and grouped items
    (SEQ22): how many, how long, and what the groups hold."""
    m = patterns.search(tagged(spark, sf_dir), "{(LOW)} {CAP+} !CAP (LOW)+", BY, "k")
    size = lambda g: F.when(F.col("groups")[g]["first"].isNotNull(), F.col("groups")[g]["last"] - F.col("groups")[g]["first"] + 1).otherwise(0)
    return m.groupBy(*BY).agg(F.count(F.lit(1)).alias("matches"), F.sum(F.size("items")).alias("tokens"), F.sum(size(1)).cast("long").alias("capitals"), F.count_if(size(0) > 0).alias("with_first"))


@query(
    "repaired_tags",
    f"""WITH {WORDS}, l AS (SELECT doc_id, turn, k, word, {LETTER} AS c FROM w),
    m AS (SELECT *, CASE WHEN c = 'L' AND lag(word) OVER o = 'the' THEN 'N' WHEN c = 'L' AND regexp_matches(word, 'ing$') THEN 'I' ELSE c END AS d FROM l WINDOW o AS (PARTITION BY doc_id, turn ORDER BY k)),
    f AS (SELECT *, last_value(CASE WHEN d <> 'L' THEN d END IGNORE NULLS) OVER (PARTITION BY doc_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, lead(d) OVER (PARTITION BY doc_id, turn ORDER BY k) AS n FROM m)
    SELECT doc_id, CASE WHEN d = 'L' AND p = 'C' THEN 'RUN' WHEN d = 'I' AND n = 'C' THEN 'BEFORE' ELSE CASE d WHEN 'C' THEN 'CAP' WHEN 'N' THEN 'NUM' WHEN 'P' THEN 'PUN' WHEN 'I' THEN 'ING' ELSE 'LOW' END END AS tag, count(*) AS n FROM f GROUP BY ALL""",
)
def repaired_tags(spark, sf_dir):
    """Tags after morphological and contextual rules (STR27). The rule on RUN
    feeds itself: a low word behind one that was just repaired is repaired."""
    t = tagging.by_morphology(tagged(spark, sf_dir), ["LOW the fgoodright 3 NUM x", "LOW ing fhassuf 3 ING x"], BY, "k")
    t = tagging.by_context(t, ["LOW RUN PREVTAG CAP", "LOW RUN PREVTAG RUN", "ING BEFORE NEXTTAG CAP"], BY, "k")
    return t.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "named_entities",
    rf"""WITH {WORDS}, e AS (SELECT DISTINCT lower(a.word) AS a, lower(b.word) AS b FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.turn = b.turn AND a.k = 0 AND b.k = 1 WHERE trim(a.word, E' \n\t\r') <> '' AND trim(b.word, E' \n\t\r') <> '' AND NOT regexp_matches(a.word || b.word, '\s')),
    p AS (SELECT doc_id, turn, k, lower(word) AS a, lead(lower(word)) OVER (PARTITION BY doc_id, turn ORDER BY k) AS b FROM w),
    h AS (SELECT doc_id, turn, k, k - row_number() OVER (PARTITION BY doc_id, turn ORDER BY k) AS run FROM p JOIN e USING (a, b)),
    r AS (SELECT doc_id, turn, k - min(k) OVER (PARTITION BY doc_id, turn, run) AS place FROM h) SELECT doc_id, turn, count(*) * 2 AS named FROM r WHERE r.place % 2 = 0 GROUP BY ALL""",
)
def named_entities(spark, sf_dir):
    """Tokens in names of two words, from left to right (STR27); the names are
    the openings of all turns."""
    t = tagged(spark, sf_dir)
    c = table(spark, sf_dir, "conversations").where("text is not null").select(F.slice(F.split("text", " "), 1, 2).alias("w"))
    fine = (F.size("w") == 2) & ~F.exists("w", lambda x: (x == "") | x.rlike(r"\s"))
    entities = c.where(fine).select(F.array_join("w", " ").alias("name"), F.lit("pers").alias("kind"))
    found = tagging.with_entities(t, entities, BY, "k")
    return found.where(F.endswith("tag", F.lit("-PERS"))).groupBy(*BY).agg(F.count(F.lit(1)).alias("named"))
