"""Queries over spans of documents, mentions, conversations and stories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators import graph, linking, spans
from fabula.plans.registry import query
from fabula.plans.words import WORDS
from fabula.session import table

SENT = """sent AS (SELECT doc_id, idx, sentence, length(sentence) AS len, CAST(coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS sentence, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS idx FROM documents))"""


def sents(spark, sf_dir):
    return spans.sentences(table(spark, sf_dir, "documents"))


@query("sentences", f'WITH {SENT} SELECT doc_id, idx, "offset", len, sentence FROM sent')
def sentences(spark, sf_dir):
    return sents(spark, sf_dir)


@query("sentence_neighbours", f'WITH {SENT} SELECT doc_id, idx, lag("offset") OVER w AS previous, lead("offset") OVER w AS next FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY idx)')
def sentence_neighbours(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("idx")
    return sents(spark, sf_dir).select("doc_id", "idx", F.lag("offset").over(w).alias("previous"), F.lead("offset").over(w).alias("next"))


PROBE = "probe AS (SELECT doc_id, CAST(unnest(range(0, length(coalesce(text, '')) + 1, 250)) AS BIGINT) AS place FROM documents)"


def probes(spark, sf_dir):
    """Every 250th character of each document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length(F.coalesce("text", F.lit(""))).cast("long"), F.lit(250).cast("long"))).alias("place"))


@query("sentence_of_offset", f'WITH {SENT}, {PROBE} SELECT doc_id, place, (SELECT max(idx) FROM sent s WHERE s.doc_id = p.doc_id AND s."offset" <= place) AS idx FROM probe p')
def sentence_of_offset(spark, sf_dir):
    return spans.at_or_before(probes(spark, sf_dir), sents(spark, sf_dir), "doc_id", "place", "idx")


@query("sentence_after_offset", f'WITH {SENT}, {PROBE} SELECT doc_id, place, (SELECT min(idx) FROM sent s WHERE s.doc_id = p.doc_id AND s."offset" >= place) AS idx FROM probe p')
def sentence_after_offset(spark, sf_dir):
    return spans.at_or_after(probes(spark, sf_dir), sents(spark, sf_dir), "doc_id", "place", "idx")


@query(
    "token_table",
    r"""SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (regexp_full_match(tok, '[\p{L}\p{N}_]+')) AS n_words, CAST(sum(length(tok)) AS BIGINT) AS chars
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS tok FROM documents) GROUP BY 1""",
)
def token_table(spark, sf_dir):
    t = spans.tokens(sents(spark, sf_dir))
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("token").rlike(r"^[\p{L}\p{N}_]+$")).alias("n_words"), F.sum("len").alias("chars")
    )


@query(
    "token_places",
    """SELECT doc_id, CAST(0 AS BIGINT) AS wrong FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]')) FROM documents) GROUP BY 1""",
)
def token_places(spark, sf_dir):
    """Word tokens whose text is not what stands at their offset; none are."""
    t = spans.tokens(sents(spark, sf_dir)).where(F.col("token").rlike(r"^[\p{L}\p{N}_]+$"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = t.groupBy("doc_id").agg(F.collect_list(F.struct("offset", "len", "token")).alias("t"))  # the tokens of one document
    # A place in a column's text is found by counting its bytes from the front, in Python at once.

    @F.pandas_udf("long")
    def wrong(texts: pd.Series, offsets: pd.Series, sizes: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([sum(text[k : k + n] != x for k, n, x in zip(o.tolist(), s.tolist(), t.tolist())) for text, o, s, t in zip(texts, offsets, sizes, tokens)], dtype="int64")

    return at.join(d, "doc_id").select("doc_id", wrong("text", "t.offset", "t.len", "t.token").alias("wrong"))


@query(
    "tokens_in_range",
    f"""WITH {SENT}, r AS (SELECT doc_id, place AS start, place + 40 AS stop FROM (SELECT doc_id, CAST(unnest(range(0, length(coalesce(text, '')) + 1, 250)) AS BIGINT) AS place FROM documents)),
    b AS (SELECT doc_id, "offset", lag("offset") OVER (PARTITION BY doc_id ORDER BY "offset") AS before FROM sent)
    SELECT r.doc_id, start, count(*) AS n FROM r JOIN b ON r.doc_id = b.doc_id AND "offset" >= start AND ("offset" < stop OR (before < stop AND before >= start)) GROUP BY 1, 2""",
)
def tokens_in_range(spark, sf_dir):
    """Sentences that start in [at, at + 40) of each probe, and the next one."""
    r = probes(spark, sf_dir).select("doc_id", F.col("place").alias("start"), (F.col("place") + 40).alias("end"))
    s = sents(spark, sf_dir).select("doc_id", "offset")
    hit = spans.tokens_in_range(r, s, "doc_id")
    return hit.select("doc_id", "start", "offset").distinct().groupBy("doc_id", "start").agg(F.count(F.lit(1)).alias("n"))


@query(
    "best_overlap",
    f"""WITH {SENT}, c AS (SELECT doc_id, place // 250 AS chunk, place AS a0, place + 250 AS a1 FROM (SELECT doc_id, CAST(unnest(range(0, length(coalesce(text, '')) + 1, 250)) AS BIGINT) AS place FROM documents)),
    o AS (SELECT c.doc_id, chunk, idx, least(a1, "offset" + len) - greatest(a0, "offset") AS overlap FROM c JOIN sent s ON s.doc_id = c.doc_id AND least(a1, "offset" + len) > greatest(a0, "offset"))
    SELECT doc_id, chunk, idx, overlap FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, chunk ORDER BY overlap DESC, idx) = 1""",
)
def best_overlap(spark, sf_dir):
    c = probes(spark, sf_dir).select("doc_id", F.floor(F.col("place") / 250).alias("chunk"), F.col("place").alias("offset"), F.lit(250).cast("long").alias("len"))
    return spans.best_overlap(c, sents(spark, sf_dir), "doc_id", "chunk", "idx").select("doc_id", "chunk", "idx", "overlap")


MENTION = r"""m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS mention, word FROM (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+') AS w FROM documents)) WHERE regexp_matches(word, '^[A-Z][a-z]{5,}$'))"""


def mentions(spark, sf_dir):
    """Capitalised words of six letters and more, numbered in each document."""
    d = table(spark, sf_dir, "documents")
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    m = d.select("doc_id", F.posexplode(F.filter(w, lambda x: x.rlike("^[A-Z][a-z]{5,}$"))).alias("pos", "word"))
    return m.select("doc_id", (F.col("pos") + 1).cast("long").alias("mention"), "word")


@query(
    "pair_links",
    f"WITH {MENTION} SELECT a.doc_id, a.mention AS i, b.mention AS j, a.word = b.word AS same FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.mention < b.mention AND a.mention + 3 >= b.mention",
)
def pair_links(spark, sf_dir):
    """Mentions at most three apart, and whether they are the same word."""
    p = linking.pairs(mentions(spark, sf_dir), "doc_id", "mention", F.col("mention_i") + 3 >= F.col("mention_j"))
    return p.select("doc_id", F.col("mention_i").alias("i"), F.col("mention_j").alias("j"), (F.col("word_i") == F.col("word_j")).alias("same"))


@query(
    "link_groups",
    f"WITH {MENTION} SELECT doc_id, mention, min(mention) OVER (PARTITION BY doc_id, word) AS grp FROM m",
)
def link_groups(spark, sf_dir):
    """Mentions of one word are one group (COR2, COR6, COR7); a second, weak
    link of equal first letters stays below the threshold."""
    m = mentions(spark, sf_dir)
    same = linking.shared_key_links(m, "doc_id", "mention", "word")
    alike = linking.shared_key_links(m.withColumn("letter", F.substring("word", 1, 1)), "doc_id", "mention", "letter")
    links = linking.merge_links([(same, 1.0), (alike, 0.05)], "doc_id")
    return linking.link_groups(links, m, "doc_id", "mention")


@query(
    "shared_word_groups",
    f"WITH {MENTION} SELECT doc_id, count(*) AS mentions, count(DISTINCT word) AS groups, max(n) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, word) AS n FROM m) GROUP BY 1",
)
def shared_word_groups(spark, sf_dir):
    """Statistics of groups per document (AGG2); counts before the maximum."""
    n = mentions(spark, sf_dir).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("doc_id").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"))


ACTS = """acts AS (SELECT conv_id, role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst, lower(regexp_extract(coalesce(text, ''), '[A-Za-z]+')) AS verb FROM conversations)"""


def acts(spark, sf_dir):
    """Each turn as an act on the next speaker, with its first word."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    verb = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("src"), F.lead("role").over(w).alias("dst"), verb.alias("verb"))


@query("interaction_edges", f"WITH {ACTS} SELECT conv_id, coalesce(src, '-1') AS src, coalesce(dst, '-1') AS dst, count(*) AS n, count(DISTINCT verb) AS verbs FROM acts GROUP BY 1, 2, 3")
def interaction_edges(spark, sf_dir):
    return graph.interaction_edges(acts(spark, sf_dir), ["conv_id"], "src", "dst", "verb")


@query(
    "adjacency",
    f"""WITH {ACTS}, e AS (SELECT coalesce(src, '-1') AS src, coalesce(dst, '-1') AS dst, count(*) AS n FROM acts GROUP BY 1, 2)
    SELECT src, CAST(sum(n) FILTER (dst = 'user') AS BIGINT) AS user, CAST(sum(n) FILTER (dst = 'assistant') AS BIGINT) AS assistant, CAST(sum(n) FILTER (dst = '-1') AS BIGINT) AS none FROM e GROUP BY 1""",
)
def adjacency(spark, sf_dir):
    e = graph.interaction_edges(acts(spark, sf_dir), [], "src", "dst", "verb")
    return graph.adjacency(e, ["user", "assistant", "-1"]).withColumnRenamed("-1", "none")


@query(
    "verb_sequence",
    f"""WITH {ACTS}, v AS (SELECT conv_id, turn, lower(regexp_extract(coalesce(text, ''), '[A-Za-z]+')) AS verb FROM conversations)
    SELECT conv_id, turn, verb, round((row_number() OVER w - 1) / count(*) OVER (PARTITION BY conv_id), 9) AS place FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def verb_sequence(spark, sf_dir):
    """First word of each turn and its place in the conversation (GRF3, WIN10)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    verb = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0))
    place = (F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", verb.alias("verb"), F.round(place, 9).alias("place"))


@query(
    "story_phases",
    """SELECT conv_id, turn, CAST(max(CASE WHEN role = 'system' THEN 1 WHEN role = 'user' THEN 2 WHEN role = 'assistant' THEN 3 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INT) AS phase FROM conversations""",
)
def story_phases(spark, sf_dir):
    trigger = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).when(F.col("role") == "assistant", 3).otherwise(0)
    return graph.phases(table(spark, sf_dir, "conversations"), "conv_id", "turn", trigger).select("conv_id", "turn", "phase")


@query(
    "story_retrieval",
    f"""WITH k AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM k GROUP BY 1),
    s AS (SELECT a.item_id, b.item_id AS memory, round(2.0 * count(*) / (any_value(na.n) + any_value(nb.n)), 9) AS dice FROM k a JOIN k b ON a.term = b.term AND a.item_id <> b.item_id
      JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = b.item_id GROUP BY 1, 2)
    SELECT item_id, memory, dice, row_number() OVER (PARTITION BY item_id ORDER BY dice DESC, memory) AS rank FROM s QUALIFY rank <= 3""",
)
def story_retrieval(spark, sf_dir):
    """The three items most like each item by Dice of keyword sets (TOP6, SET7)."""
    k = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.words("text"))).alias("term"))
    n = k.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    other = k.join(n, "item_id").select(F.col("item_id").alias("memory"), F.col("n").alias("n2"), "term")
    both = k.join(n, "item_id").join(other, "term").where("item_id <> memory").groupBy("item_id", "memory", "n", "n2").count()
    dice = both.withColumn("dice", F.round(2.0 * F.col("count") / (F.col("n") + F.col("n2")), 9))
    w = Window.partitionBy("item_id").orderBy(F.desc("dice"), "memory")
    return dice.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("item_id", "memory", "dice", "rank")


@query(
    "leading_speakers",
    """SELECT conv_id, role, count(*) AS turns, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, role) AS rank FROM conversations GROUP BY 1, 2 QUALIFY rank <= 2""",
)
def leading_speakers(spark, sf_dir):
    """The two most frequent speakers of each conversation (TOP7)."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("turns"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turns"), "role")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 2")


@query(
    "speaker_rules",
    """WITH v AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = 'user' THEN 'assistant' WHEN lag(role) OVER w = 'assistant' THEN 'user' END AS alternate, CASE WHEN contains(text, '?') THEN 'user' END AS asks, CASE WHEN length(text) > 400 THEN 'assistant' END AS long
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), u AS (SELECT 'alternate' AS rule, role, alternate AS vote FROM v UNION ALL SELECT 'asks', role, asks FROM v UNION ALL SELECT 'long', role, long FROM v)
    SELECT rule, count(*) AS turns, count(vote) AS votes, count(*) FILTER (vote = role) AS hits, round((count(*) FILTER (vote = role) + 1.0) / (count(vote) + 2.0), 9) AS accuracy, round(count(vote) / count(*), 9) AS coverage FROM u GROUP BY 1""",
)
def speaker_rules(spark, sf_dir):
    """Hits and coverage of three speaker rules, Laplace-smoothed (AGG16)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("role").over(w)
    v = table(spark, sf_dir, "conversations").select(
        "role",
        F.when(before == "user", "assistant").when(before == "assistant", "user").alias("alternate"),
        F.when(F.contains("text", F.lit("?")), "user").alias("asks"),
        F.when(F.length("text") > 400, "assistant").alias("long"),
    )
    u = v.unpivot("role", ["alternate", "asks", "long"], "rule", "vote")
    hit = F.count_if(F.col("vote") == F.col("role"))
    return u.groupBy("rule").agg(
        F.count(F.lit(1)).alias("turns"), F.count("vote").alias("votes"), hit.alias("hits"),
        F.round((hit + 1.0) / (F.count("vote") + 2.0), 9).alias("accuracy"), F.round(F.count("vote") / F.count(F.lit(1)), 9).alias("coverage"),
    )


@query(
    "corpus_summary",
    f"""WITH {SENT} SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS sentences, CAST(sum(len) AS BIGINT) AS chars, round(avg(len), 6) AS mean_length FROM sent JOIN documents USING (doc_id) GROUP BY 1""",
)
def corpus_summary(spark, sf_dir):
    """Corpus statistics by source (AGG1, AGG19); sentences are counted inside
    their document, so no line is shuffled."""
    line = F.split(F.coalesce("text", F.lit("")), "\n")
    d = table(spark, sf_dir, "documents").select("source", F.size(line).alias("k"), (F.length(F.coalesce("text", F.lit(""))) - F.size(line) + 1).cast("long").alias("n"))
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("k").alias("sentences"), F.sum("n").alias("chars"))
    return g.withColumn("mean_length", F.round(F.col("chars") / F.col("sentences"), 6))
