"""Queries of the shallow linguistic path over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import shallow
from fabula.functions import text as T
from fabula.operators import lexicon, sequences, spans, templates
from fabula.plans.registry import query
from fabula.session import table

TOK = r"""t AS (SELECT item_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM benchmark))"""


def sql_tag() -> str:
    """The tagger's rules as one CASE, from the same tables as the operator."""
    closed = " ".join(f"WHEN lower(token) IN ({', '.join(repr(w) for w in v.split())}) THEN '{k}'" for k, v in reversed(shallow.CLOSED.items()))
    ends = " ".join(f"WHEN ends_with(lower(token), '{s}') AND length(token) > {len(s) + 1} THEN '{k}'" for s, k in shallow.SUFFIXES)
    return rf"CASE WHEN regexp_matches(token, '^\d') THEN 'CD' WHEN NOT regexp_matches(token, '[\p{{L}}\p{{N}}]') THEN '.' {closed} {ends} WHEN regexp_matches(token, '^\p{{Lu}}') THEN 'NNP' ELSE 'NN' END"


TAGS = f"""{TOK}, g AS (SELECT *, {sql_tag()} AS g FROM t), tagged AS (SELECT item_id, pos, token, CASE WHEN lag(g) OVER w IN ('TO', 'MD') AND g IN ('NN', 'NNP') THEN 'VB' WHEN lag(g) OVER w = 'DT' AND g IN ('VB', 'VBG', 'VBD') THEN 'NN' ELSE g END AS tag
  FROM g WINDOW w AS (PARTITION BY item_id ORDER BY pos))"""


def item_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.tokens("text")).alias("pos", "token"))


def item_tags(spark, sf_dir):
    return shallow.tagged(item_tokens(spark, sf_dir), "token", ["pos"], ["item_id"])


@query("tagged_items", f"WITH {TAGS} SELECT item_id, CAST(pos AS BIGINT) AS pos, token, tag FROM tagged")
def tagged_items(spark, sf_dir):
    return item_tags(spark, sf_dir).select("item_id", F.col("pos").cast("long").alias("pos"), "token", "tag")


CHUNK = f"""{TAGS}, k AS (SELECT *, CASE WHEN regexp_matches(tag, '^(DT|PRP|JJ|NN|CD)') THEN 'NP' WHEN regexp_matches(tag, '^(MD|VB|RB)') THEN 'VP' WHEN tag IN ('IN', 'TO') THEN 'PP' ELSE 'O' END AS kind FROM tagged),
s AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind OR (tag = 'DT' AND kind = 'NP') THEN 1 ELSE 0 END AS st FROM k WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
n AS (SELECT *, sum(st) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chunk FROM s), c AS (SELECT item_id, CAST(chunk AS BIGINT) AS chunk, kind, min(pos) AS first, max(pos) AS last, arg_max(token, pos) AS head FROM n GROUP BY 1, 2, 3 HAVING kind <> 'O')"""


@query("item_chunks", f"WITH {CHUNK} SELECT item_id, chunk, kind, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, head FROM c")
def item_chunks(spark, sf_dir):
    c = shallow.chunks(item_tags(spark, sf_dir), ["item_id"], "pos")
    return c.withColumns({"first": F.col("first").cast("long"), "last": F.col("last").cast("long")})


@query(
    "chunk_relations",
    f"""WITH {CHUNK}, r AS (SELECT item_id, chunk, kind, head AS verb, CASE WHEN lag(kind) OVER w = 'NP' THEN lag(head) OVER w END AS subject, CASE WHEN lead(kind) OVER w = 'NP' THEN lead(head) OVER w END AS object FROM c WINDOW w AS (PARTITION BY item_id ORDER BY chunk))
    SELECT item_id, chunk, verb, subject, object FROM r WHERE kind = 'VP'""",
)
def chunk_relations(spark, sf_dir):
    return shallow.relations(shallow.chunks(item_tags(spark, sf_dir), ["item_id"], "pos"), ["item_id"])


@query(
    "document_tags",
    r"WITH t AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM documents)), "
    + f"g AS (SELECT doc_id, {sql_tag()} AS tag FROM t) SELECT doc_id, tag, count(*) AS n FROM g GROUP BY 1, 2",
)
def document_tags(spark, sf_dir):
    """Lexical tags of all documents, counted; no neighbour rules here."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens("text")).alias("token"))
    return d.groupBy("doc_id", shallow.lexical_tag("token").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "region_similarity",
    """WITH e AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation) SELECT 'n' || a.n AS a, 'n' || b.n AS b, CASE WHEN a.n = b.n THEN 1.0 WHEN a.r = b.r THEN round(2 * 2 / (3.0 + 3.0), 9) ELSE round(2 * 1 / (3.0 + 3.0), 9) END::DOUBLE AS similarity FROM e a, e b""",
)
def region_similarity(spark, sf_dir):
    """Wu-Palmer similarity of nations in the tree world > region > nation."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    a = n.select(F.col("child").alias("a"))
    pairs = a.crossJoin(a.withColumnRenamed("a", "b"))  # nations by nations
    return lexicon.wu_palmer(pairs, n.union(r)).withColumn("similarity", F.round("similarity", 9))


@query(
    "role_templates",
    """SELECT DISTINCT 'the ' || role || ' of ' || n_name || ' speaks' AS text FROM conversations, nation WHERE role IS NOT NULL""",
)
def role_templates(spark, sf_dir):
    """A template filled with all roles and nations (TPL1)."""
    roles = table(spark, sf_dir, "conversations").where("role is not null").select(F.lit("who").alias("slot"), F.col("role").alias("value")).distinct()
    nations = table(spark, sf_dir, "nation").select(F.lit("where").alias("slot"), F.col("n_name").alias("value"))
    t = spark.createDataFrame([(1, "the {who} of {where} speaks")], "id int, template string")
    return templates.expand(t, roles.union(nations)).select("text")


@query(
    "quoted_text",
    """SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '"[^"]*"')) AS quotes, length(regexp_replace(coalesce(text, ''), '"[^"]*"', 'QUOTE', 'g')) AS plain_length FROM documents""",
)
def quoted_text(spark, sf_dir):
    q = spans.quoted(table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))))
    return q.select("doc_id", F.size("quotes").cast("long").alias("quotes"), F.length("plain").cast("long").alias("plain_length"))


@query("tidied_turns", r"SELECT conv_id, turn, upper(left(t, 1)) || t[2:] AS text FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(trim(text, ' '), '[ \t\n\r\f\v]+', ' ', 'g'), ' ([.,!?;:])', '\1', 'g') AS t FROM conversations WHERE text IS NOT NULL)")
def tidied_turns(spark, sf_dir):
    """Turns with a capital first, single blanks and none before marks (STR21)."""
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", templates.tidy(F.col("text")).alias("text"))


@query("number_words", "SELECT p_partkey, (p_size * 1000 + p_size)::DOUBLE AS value FROM part")
def number_words(spark, sf_dir):
    """Sizes written out, twice in one number, and read again (STR20)."""
    size = F.col("p_size")
    small = F.get(F.array(*map(F.lit, shallow.ONES)), F.least(size, F.lit(19)))
    tens = F.get(F.array(*map(F.lit, shallow.TENS)), F.floor(size / 10).cast("int") - 2)
    written = F.when(size < 20, small).when(size % 10 == 0, tens).otherwise(F.concat_ws("-", tens, F.get(F.array(*map(F.lit, shallow.ONES)), size % 10)))
    text = F.concat(F.initcap(written), F.lit(" thousand and "), written)
    return table(spark, sf_dir, "part").select("p_partkey", shallow.number(text).alias("value"))


@query(
    "allowed_events",
    "WITH e AS (SELECT event_type AS label, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS state FROM events) SELECT state, string_agg(DISTINCT label, ',' ORDER BY label) AS allowed FROM e WHERE state IS NOT NULL GROUP BY 1",
)
def allowed_events(spark, sf_dir):
    """The automaton that all users' event sequences make: what may follow (SEQ4)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.lag("event_type").over(w).alias("state")).where("state is not null")
    return sequences.allowed_next(e)
