"""Round trips: given tables written in a format to the shared folder and read
back by the format's reader. Words of conversations make the annotated stories:
a turn is a sentence, its words (cut at blanks) are tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.plans.registry import query
from fabula.session import new_folder, table, written
from fabula.sources import formats, readers, standoff, writers

#: Token ids: a turn's are from 100,000 times its number on.
TURN = 100_000


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, turn, k, word, token_id, offset of each word of each turn; a
    story is its turns, with one character between them."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    t = c.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("long").alias("turn"), start.alias("start"), F.length("text").alias("size"), F.split("text", " ").alias("words"))
    # Running offsets inside the row: (offset so far, offsets).
    at = F.aggregate("words", F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")), lambda a, x: F.struct((a["n"] + F.length(x) + 1).alias("n"), F.array_append(a["at"], a["n"]).alias("at")))
    z = t.withColumn("at", at["at"]).select("doc_id", "turn", "start", "size", F.posexplode(F.arrays_zip("words", "at")).alias("k", "z"))
    return z.select("doc_id", "turn", "start", "size", "k", F.col("z.words").alias("word"), (F.col("turn") * TURN + F.col("k")).alias("token_id"), (F.col("start") + F.col("z.at")).cast("long").alias("offset"))


WORDS = f"""c AS (SELECT conv_id::VARCHAR AS doc_id, turn::BIGINT AS turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(text) AS size,
    string_split(text, ' ') AS ws FROM conversations WHERE text IS NOT NULL),
  x AS (SELECT doc_id, turn, start, size, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM c),
  w AS (SELECT doc_id, turn, size, k, word, turn * {TURN} + k AS token_id, (start + coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM x)"""


def written_standoff(*layers: DataFrame) -> DataFrame:
    """The layers through the format; each goes to files of its own. The files
    are parsed once, into a table of which each layer is a scan."""
    spark = layers[0].sparkSession
    formats.register(spark)
    path = new_folder(spark, "standoff")
    for k, rows in enumerate(layers):
        rows.write.format("standoff").mode("append" if k else "overwrite").save(path)
    return written(spark.read.format("standoff").load(path), "layers")


def kept_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words as a table, for queries that write several layers of them."""
    return written(words(spark, sf_dir), "words")


def token_layer(w: DataFrame) -> DataFrame:
    return standoff.as_layer(w.select("doc_id", F.col("token_id").alias("id"), "offset", F.length("word").alias("len"), F.col("word").alias("value")), "token")


def sentence_layer(w: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda k: (F.col("turn") * TURN + k).cast("string")), "~")
    s = w.groupBy("doc_id", "turn", "start", "size").agg(F.collect_list("k").alias("words"))  # a turn's words
    return standoff.as_layer(s.select("doc_id", F.col("turn").alias("id"), F.col("start").alias("offset"), F.col("size").alias("len"), ids.alias("value")), "sentence")


@query(
    "standoff_tokens",
    f"""WITH {WORDS} SELECT doc_id, token_id, "offset", length(word)::BIGINT AS len, word AS text, CASE WHEN k % 3 = 2 THEN '?' WHEN regexp_matches(word, '^[A-Z]') THEN 'NN' ELSE 'VB' END AS pos,
    CASE WHEN k % 3 <> 2 AND regexp_matches(word, '^[A-Za-z]+s$') THEN lower(word[:-2]) ELSE lower(word) END AS lemma FROM w WHERE regexp_matches(word, '^[A-Za-z]+$')""",
)
def standoff_tokens(spark, sf_dir):
    """Tokens, tags and stems in layers of their own (SRC9, SRC10, SNK1)."""
    w = kept_words(spark, sf_dir).where(F.col("word").rlike("^[A-Za-z]+$"))
    tagged = w.where("k % 3 <> 2")
    tag = F.when(F.col("word").rlike("^[A-Z]"), "NN").otherwise("VB")
    one = lambda df, id, value: df.select("doc_id", id.alias("id"), "offset", F.length("word").alias("len"), value.alias("value"))
    pos_id = F.col("token_id") + 50_000
    tags = one(tagged, pos_id, F.concat_ws(" ", F.col("token_id").cast("string"), tag))
    stems = one(tagged.where(F.col("word").rlike("s$")), F.col("token_id") + 75_000, F.concat_ws(" ", pos_id.cast("string"), F.lower(F.regexp_replace("word", "s$", ""))))
    rows = written_standoff(token_layer(w), standoff.as_layer(tags, "pos"), standoff.as_layer(stems, "stem"))
    return standoff.tokens(rows)


@query(
    "standoff_mentions",
    f"""WITH {WORDS}, m AS (SELECT doc_id, turn, token_id AS mention_id, lower(word) AS name, token_id, token_id + 1 AS next FROM w WHERE regexp_matches(word, '^[A-Z][a-z]+$')),
    s AS (SELECT doc_id, turn, max(k) AS most FROM w GROUP BY ALL), g AS (SELECT doc_id, name, min(mention_id) AS group_id, count(*) AS mentions FROM m GROUP BY ALL)
    SELECT m.doc_id, m.turn AS sentence_id, mention_id, CASE WHEN m.token_id - m.turn * {TURN} < s.most THEN 2 ELSE 1 END::BIGINT AS n_tokens, group_id, name FROM m JOIN s USING (doc_id, turn) JOIN g USING (doc_id, name) WHERE g.mentions > 1""",
)
def standoff_mentions(spark, sf_dir):
    """Sentences, mentions of one or two words and coreference groups of equal
    names, through their layers (SRC11 to SRC13)."""
    w = kept_words(spark, sf_dir)
    most = F.max("k").over(Window.partitionBy("doc_id", "turn"))
    m = w.withColumn("most", most).where(F.col("word").rlike("^[A-Z][a-z]+$"))
    ids = F.when(F.col("k") < F.col("most"), F.concat_ws("~", F.col("token_id").cast("string"), (F.col("token_id") + 1).cast("string"))).otherwise(F.col("token_id").cast("string"))
    mention = m.select("doc_id", F.col("token_id").alias("id"), "offset", F.length("word").alias("len"), ids.alias("value"))
    g = m.groupBy("doc_id", F.lower("word").alias("name")).agg(F.array_sort(F.collect_list("token_id")).alias("ids"), F.min("offset").alias("offset"))  # a story's mentions
    coref = g.where(F.size("ids") > 1).select("doc_id", F.col("ids")[0].alias("id"), "offset", F.lit(0).alias("len"), F.concat(F.col("name"), F.lit("|"), F.array_join(F.col("ids").cast("array<string>"), ",")).alias("value"))
    rows = written_standoff(sentence_layer(w), standoff.as_layer(mention, "mention"), standoff.as_layer(coref, "coref"))
    at = standoff.members(rows, "mention").groupBy("doc_id", F.col("id").alias("mention_id")).agg(F.count(F.lit(1)).alias("n_tokens"), F.min("token_id").alias("token_id"))
    inside = standoff.members(rows, "sentence").select("doc_id", F.col("id").alias("sentence_id"), "token_id")
    return at.join(inside, ["doc_id", "token_id"]).join(standoff.groups(rows), ["doc_id", "mention_id"]).select("doc_id", "sentence_id", "mention_id", "n_tokens", "group_id", "name")


@query(
    "standoff_functions",
    f"""SELECT conv_id::VARCHAR AS doc_id, turn::BIGINT AS function_id, upper(role) AS label, p.place::INT AS place, CASE WHEN p.place = 2 THEN 'IMPLICIT' ELSE 'ACTUAL' END AS kind, turn * {TURN} + p.place AS first, (2 - p.place % 2)::BIGINT AS n
    FROM conversations, (VALUES (0), (1), (2)) p(place) WHERE role IS NOT NULL AND turn IS NOT NULL""",
)
def standoff_functions(spark, sf_dir):
    """Function labels with their places (SRC15): each turn is one, with two
    actual places and an implicit one."""
    c = table(spark, sf_dir, "conversations").where("role is not null and turn is not null")
    t = F.col("turn").cast("long") * TURN
    label = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("NORMAL:x:"), F.upper("role"))).otherwise(F.upper("role"))
    place = lambda *k: F.concat_ws("~", *[(t + x).cast("string") for x in k])
    value = F.concat(label, F.lit("|ACTUAL:"), place(0, 1), F.lit(","), place(1), F.lit("|IMPLICIT:"), place(2, 3))
    f = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.lit(0).alias("offset"), F.lit(0).alias("len"), value.alias("value"))
    got = standoff.functions(written_standoff(standoff.as_layer(f, "function")))
    return got.select("doc_id", "function_id", "label", "place", "kind", F.get("token_ids", F.lit(0)).alias("first"), F.size("token_ids").cast("long").alias("n"))


@query(
    "standoff_senses",
    f"""WITH {WORDS}, m AS (SELECT doc_id, token_id, turn, k, max(k) OVER (PARTITION BY doc_id, turn) AS most FROM w QUALIFY k % 4 = 0),
    s AS (SELECT doc_id, token_id, 'WID-' || lpad(k::VARCHAR, 8, '0') || '-N-01-' || k AS sense FROM w WHERE k % 3 = 0),
    t AS (SELECT doc_id, sense, token_id FROM s UNION ALL SELECT w.doc_id, s.sense, w.token_id FROM s JOIN w ON s.doc_id = w.doc_id AND w.token_id = s.token_id + 1 WHERE s.token_id % 6 = 0)
    SELECT DISTINCT t.doc_id, m.token_id AS mention_id, t.sense FROM t JOIN m ON t.doc_id = m.doc_id AND t.token_id >= m.token_id AND t.token_id <= m.token_id + 1""",
)
def standoff_senses(spark, sf_dir):
    """Noun senses of mentions (SRC14): every third word has a sense, some are
    collocations of two words; verbs and words without a sense are passed over."""
    w = written(words(spark, sf_dir).withColumn("most", F.max("k").over(Window.partitionBy("doc_id", "turn"))), "words")
    number = F.lpad(F.col("k").cast("string"), 8, "0")
    noun = F.concat(F.lit("WID-"), number, F.lit("-N-01-"), F.col("k").cast("string"))
    pair = (F.col("k") % 3 == 0) & (F.col("token_id") % 6 == 0) & (F.col("k") < F.col("most"))
    # A collocation's id is its first token's and 50,000.
    of = F.when(pair, F.col("token_id") + 50_000).otherwise(F.col("token_id"))
    what = F.when(F.col("k") % 3 == 0, noun).when(F.col("k") % 3 == 1, F.lit("NO_SENSE")).otherwise(F.lit("WID-00000001-V-01-be"))
    one = lambda df, id, value: df.select("doc_id", id.alias("id"), "offset", F.length("word").alias("len"), value.alias("value"))
    t = F.col("token_id").cast("string")
    sense = one(w, F.col("token_id") + 75_000, F.concat(what, F.lit(",USER:,"), of.cast("string"), F.lit(",1,2")))
    colloc = one(w.where(pair), F.col("token_id") + 50_000, F.concat_ws(",", t, (F.col("token_id") + 1).cast("string")))
    mention = one(w.where("k % 4 = 0"), F.col("token_id"), F.concat_ws("~", t, (F.col("token_id") + 1).cast("string")))
    rows = written_standoff(standoff.as_layer(sense, "sense"), standoff.as_layer(colloc, "colloc"), standoff.as_layer(mention, "mention"))
    return standoff.senses(rows)


@query(
    "standoff_roles",
    f"""WITH {WORDS}, s AS (SELECT doc_id, turn, max(k) + 1 AS n FROM w GROUP BY ALL HAVING max(k) >= 3),
    a AS (SELECT 'A0' AS label, 0 AS first, 2 AS size UNION ALL SELECT 'A1', 3, 1 UNION ALL SELECT 'AM-ALL', 0, NULL UNION ALL SELECT 'A2', 0, NULL)
    SELECT doc_id, turn AS role_id, turn * {TURN} + 2 AS verb_token, 'be.01' AS frame, label, turn * {TURN} + first AS first, coalesce(size, CASE WHEN label = 'A2' THEN 3 ELSE n END)::BIGINT AS n FROM s, a""",
)
def standoff_roles(spark, sf_dir):
    """Verb roles that point into parse trees (SRC16, SRC44): (S (NP w w) (VP w w ..)),
    roles by leaf and levels up."""
    w = kept_words(spark, sf_dir)
    s = w.groupBy("doc_id", "turn", "start", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    leaves = lambda a, b, tag: F.array_join(F.transform(F.sequence(a, b), lambda k: F.concat(F.lit(f"({tag} w"), k.cast("string"), F.lit(")"))), " ")
    tree = F.concat(F.lit("(S (NP "), leaves(F.lit(0), F.lit(1), "NN"), F.lit(")\n (VP "), leaves(F.lit(2), F.col("n").cast("int") - 1, "VB"), F.lit("))"))
    one = lambda value: s.select("doc_id", F.col("turn").alias("id"), F.col("start").alias("offset"), F.col("size").alias("len"), value.alias("value"))
    roles = one(F.lit("2 user be.01 ----a 0:1-ARG0- 3:0-ARG1- 2:2-ARGM-ALL 1:1,2:0-ARG2-"))
    rows = written_standoff(sentence_layer(w), standoff.as_layer(one(tree), "parse"), standoff.as_layer(roles, "role"))
    return standoff.verb_roles(rows).select("doc_id", "role_id", "verb_token", "frame", "label", F.col("token_ids")[0].alias("first"), F.size("token_ids").cast("long").alias("n"))


@query("standoff_text", "SELECT conv_id::VARCHAR AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def standoff_text(spark, sf_dir):
    """Original texts, whatever marks are in them (SRC44)."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")  # a story's turns
    t = c.groupBy(F.col("conv_id").alias("doc_id")).agg(whole.alias("value")).select("doc_id", F.lit(0).alias("id"), F.lit(0).alias("offset"), F.length("value").alias("len"), "value")
    return standoff.texts(written_standoff(standoff.as_layer(t, "text")))


@query(
    "conll_tokens",
    f"""WITH {WORDS} SELECT doc_id, turn AS sent_id, k::BIGINT AS idx, word AS form, lower(word) AS lemma, CASE WHEN k % 3 <> 0 THEN 'T' || k % 3 END AS pos, CASE WHEN k > 0 THEN k - 1 END::BIGINT AS head FROM w""",
)
def conll_tokens(spark, sf_dir):
    """All words as CoNLL columns, line ends inside words too (SRC43, SNK4)."""
    formats.register(spark)
    w = words(spark, sf_dir)
    pos = F.when(F.col("k") % 3 != 0, F.concat(F.lit("T"), (F.col("k") % 3).cast("string")))
    rows = w.select("doc_id", F.col("turn").alias("sent_id"), F.col("k").cast("long").alias("idx"), F.col("word").alias("form"), F.lower("word").alias("lemma"), pos.alias("pos"), F.lit(None).cast("string").alias("feats"), F.when(F.col("k") > 0, F.col("k") - 1).cast("long").alias("head"), F.lit("dep").alias("deprel"), F.lit(None).cast("string").alias("ner"))
    path = new_folder(spark, "conll")
    rows.repartition("doc_id").sortWithinPartitions("doc_id", "sent_id", "idx").write.format("conll").mode("overwrite").save(path)
    return spark.read.format("conll").schema("doc_id string, sent_id long, idx long, form string, lemma string, pos string, head long").load(path)


@query("arff_customers", "SELECT c_custkey, c_acctbal::DOUBLE AS c_acctbal, c_mktsegment, c_name FROM customer")
def arff_customers(spark, sf_dir):
    """A table with numbers, nominal values and text as ARFF (SRC27, SNK3, SNK11)."""
    formats.register(spark)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment", "c_name")
    path = new_folder(spark, "arff")
    segments = ",".join(sorted(r[0] for r in c.where("c_mktsegment is not null").select("c_mktsegment").distinct().collect()))  # the nominal values
    c.write.format("arff").option("relation", "customers").option("nominal.c_mktsegment", segments).mode("overwrite").save(path)
    return spark.read.format("arff").load(path)


def lines_of(df: DataFrame, what: str, by: str | None = None) -> str:
    """``value`` as lines of text files in the order of ``n``; a file has all
    lines of a ``by``."""
    path = new_folder(df.sparkSession, what)
    dealt = df.repartition(by) if by else df
    dealt.sortWithinPartitions(*([by] if by else []), "n").select("value").write.text(path)
    return path


@query(
    "parser_documents",
    f"""WITH {WORDS} SELECT w.doc_id, turn::INT AS sent_id, w.k + 1 AS idx, w."offset", length(w.word)::BIGINT AS len, CASE WHEN w.k % 3 = 0 THEN 'NN' ELSE '?' END AS pos, lower(w.word) AS lemma, w.word AS text,
    CASE WHEN w.k > 0 THEN w.k END AS gov_idx, CASE WHEN regexp_matches(w.word, '^[A-Z]') THEN turn::INT END AS grp FROM w WHERE regexp_matches(word, '^[!-~]+$')""",
)
def parser_documents(spark, sf_dir):
    """Parser output as XML: tokens, dependencies and coreference chains of
    each document, written by Spark's XML sink (SRC3 to SRC5, SRC7, SRC8).
    Each word hangs on the one before; a turn's capital words are a chain."""
    w = words(spark, sf_dir).where(F.col("word").rlike("^[!-~]+$"))
    end = F.col("offset") + F.length("word")
    token = F.struct((F.col("k") + 1).alias("_id"), F.col("word").alias("word"), F.lower("word").alias("lemma"), F.col("offset").alias("CharacterOffsetBegin"), end.alias("CharacterOffsetEnd"), F.when(F.col("k") % 3 == 0, "NN").alias("POS"))
    node = lambda k, v: F.struct(v.alias("_VALUE"), k.cast("int").alias("_idx"))
    dep = F.when(F.col("k") > 0, F.struct(F.lit("dep").alias("_type"), node(F.col("k"), F.lit("g")).alias("governor"), node(F.col("k") + 1, F.col("word")).alias("dependent")))
    mention = F.when(F.col("word").rlike("^[A-Z]"), F.struct(F.lit(False).alias("_representative"), F.col("turn").cast("int").alias("sentence"), (F.col("k") + 1).cast("int").alias("start"), (F.col("k") + 2).cast("int").alias("end"), (F.col("k") + 1).cast("int").alias("head")))
    s = w.groupBy("doc_id", "turn").agg(F.array_sort(F.collect_list(token)).alias("t"), F.collect_list(dep).alias("d"), F.collect_list(mention).alias("m"))  # a turn's words
    kinds = F.array(F.struct(F.lit("basic-dependencies").alias("_type"), F.col("d").alias("dep")))
    one = F.struct(F.col("turn").cast("int").alias("_id"), F.struct(F.col("t").alias("token")).alias("tokens"), F.lit("(S)").alias("parse"), kinds.alias("dependencies"))
    # The chain of turn t is the t-th, so that its number is the turn's.
    d = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("c"), F.array_sort(F.collect_list(F.struct("turn", one.alias("s")))).alias("s"), F.max("turn").alias("last"))  # a document's turns
    chains = F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda k: F.struct(F.coalesce(F.get(F.filter("c", lambda x: x["turn"] == k), F.lit(0))["m"], F.array()).alias("mention")))
    xml = d.select(F.col("doc_id").alias("_name"), F.struct(F.transform("s", lambda x: x["s"]).alias("sentence")).alias("sentences"), F.struct(chains.alias("coreference")).alias("coreference"))
    path = new_folder(spark, "parsed")
    xml.write.format("xml").option("rootTag", "root").option("rowTag", "document").save(path)
    parsed = readers.parser_xml(spark, path)
    at = ["doc_id", "sent_id", "idx"]
    deps = readers.parser_dependencies(parsed).select("doc_id", "sent_id", F.col("dep_idx").alias("idx"), "gov_idx")
    chain = readers.parser_chains(parsed).select("doc_id", "sent_id", F.col("tok_start").alias("idx"), "grp")
    return readers.parser_tokens(parsed).join(deps, at, "left").join(chain, at, "left")


@query(
    "outline",
    """SELECT c_name AS child, 'N' || c_nationkey || ' ' || c_mktsegment AS parent, 2 AS depth FROM customer UNION ALL SELECT DISTINCT 'N' || c_nationkey || ' ' || c_mktsegment, 'N' || c_nationkey, 1 FROM customer UNION ALL SELECT DISTINCT 'N' || c_nationkey, NULL, 0 FROM customer""",
)
def outline(spark, sf_dir):
    """Customers below their segment and nation as indented outlines (SRC28 to
    SRC30), a nation's lines in one file."""
    c = table(spark, sf_dir, "customer").where("c_nationkey is not null and c_mktsegment is not null and c_name is not null")
    nation = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    segment = F.concat(nation, F.lit(" "), F.col("c_mktsegment"))
    line = lambda n, tabs, name: F.struct(n.alias("n"), F.concat(F.lit(tabs), name).alias("value"))
    rows = c.select(nation.alias("top"), F.explode(F.array(line(nation, "", nation), line(segment, "\t", segment), line(F.concat(segment, F.lit(" "), "c_name"), "\t\t", F.col("c_name")))).alias("l"))
    return readers.indented(spark, lines_of(rows.select("top", "l.n", "l.value").distinct(), "outline", "top")).select("child", "parent", "depth")


@query("lexicon_file", "SELECT DISTINCT split_part(p_name, ' ', 1) AS word, 'T' || p_size AS tag FROM part WHERE p_size % 5 <> 0")
def lexicon_file(spark, sf_dir):
    """Words and tags with comment lines between them (SRC47, SRC34)."""
    p = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("w"), "p_size").distinct()
    line = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(";;; "), "w")).otherwise(F.concat(F.col("w"), F.lit(" T"), F.col("p_size").cast("string")))
    return readers.lexicon(spark, lines_of(p.select(F.col("w").alias("n"), line.alias("value")), "lexicon"), ["word", "tag"])


@query(
    "sentiment_words",
    """WITH w AS (SELECT split_part(p_name, ' ', 1) AS word, CASE WHEN p_size % 3 > 0 THEN 'P' || p_size % 3 ELSE '' END AS pos, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size / 50.0 - 0.5 END AS polarity, p_partkey % 10 / 10.0 AS subjectivity FROM part WHERE p_partkey % 11 >= 3),
    t AS (SELECT word, pos, avg(polarity) AS polarity, avg(subjectivity) AS subjectivity, 1.0::DOUBLE AS intensity FROM w GROUP BY 1, 2) SELECT word, pos, round(polarity, 9) AS polarity, round(subjectivity, 9) AS subjectivity, intensity FROM t
    UNION ALL SELECT word, NULL, round(avg(polarity), 9), round(avg(subjectivity), 9), 1.0 FROM t GROUP BY 1""",
)
def sentiment_words(spark, sf_dir):
    """A sentiment lexicon as XML, with missing tags and numbers and a least
    confidence: means by word and tag, and by word (SRC33)."""
    p = table(spark, sf_dir, "part")
    polarity = F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 50.0 - 0.5)
    xml = p.select(F.split("p_name", " ")[0].alias("_form"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("P"), (F.col("p_size") % 3).cast("string"))).alias("_pos"), polarity.cast("double").alias("_polarity"), (F.col("p_partkey") % 10 / 10.0).cast("double").alias("_subjectivity"), F.concat(F.lit("s"), (F.col("p_partkey") % 17).cast("string")).alias("_wordnet_id"), (F.col("p_partkey") % 11).cast("double").alias("_confidence"))
    path = new_folder(spark, "sentiment")
    xml.write.format("xml").option("rootTag", "sentiment").option("rowTag", "word").save(path)
    by_word, _ = readers.sentiment_xml(spark, path, least_confidence=3)
    return by_word.withColumns({c: F.round(c, 9) for c in ("polarity", "subjectivity")})


@query("synset_words", "SELECT split_part(p_name, ' ', k) AS word, 'n' AS pos, round(avg(p_size / 50.0), 9) AS positive, round(avg((p_partkey % 10) / 10.0), 9) AS negative FROM part, (VALUES (1), (2)) t(k) GROUP BY 1, 2")
def synset_words(spark, sf_dir):
    """Scores of synsets spread over their words (SRC32, SRC48)."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    cells = ["n", F.col("p_partkey").cast("string"), (F.col("p_size") / 50.0).cast("string"), (F.col("p_partkey") % 10 / 10.0).cast("string"), F.concat(w[0], F.lit("#1 "), w[1], F.lit("#2")), F.lit("gloss")]
    rows = p.select(F.col("p_partkey").alias("n"), F.concat_ws("\t", F.lit(cells[0]), *cells[1:]).alias("value"))
    head = spark.createDataFrame([(-1, "# a comment")], "n long, value string")
    got = readers.synset_scores(spark, lines_of(head.union(rows), "synsets"))
    return got.withColumns({c: F.round(c, 9) for c in ("positive", "negative")})


@query("marked_turns", "SELECT '# ' || conv_id || ' ' || turn AS header, '# ' || conv_id || ' ' || turn || chr(10) || replace(text, '#', '') AS text FROM conversations WHERE text IS NOT NULL AND text <> '' AND NOT ends_with(text, chr(10))")
def marked_turns(spark, sf_dir):
    """Turns as blocks under marker lines (SRC38)."""
    c = table(spark, sf_dir, "conversations").where("text <> '' and not endswith(text, '\n')")
    head = F.concat_ws(" ", F.lit("#"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = c.select(F.col("conv_id").alias("by"), F.col("turn").alias("n"), F.concat(head, F.lit("\n"), F.replace("text", F.lit("#"), F.lit(""))).alias("value"))
    return readers.marked_blocks(spark, lines_of(rows, "blocks", "by"), "^# ").select("header", "text")


@query("record_lines", "SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def record_lines(spark, sf_dir):
    """Records of three lines each (SRC39)."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("n"), F.concat_ws("\n", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("value"))
    return readers.records(spark, lines_of(rows, "records"), 3, ["key", "status", "priority"]).select("key", "status", "priority")


@query("term_files", "SELECT term, sum(1)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM conversations) GROUP BY 1")
def term_files(spark, sf_dir):
    """Term counts of conversations in term files and back (SRC40, SNK12, SNK16)."""
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").alias("doc_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    rows = writers.term_lines(t).select(F.col("doc_id").alias("n"), "value")
    heads = c.select("conv_id").distinct().select(F.col("conv_id").alias("n"), F.concat(F.lit("@name "), F.col("conv_id").cast("string")).alias("value"))
    return readers.term_file(spark, lines_of(heads.union(rows), "terms")).groupBy("term").agg(F.sum("n").alias("n"))


@query("table_set", "SELECT o_orderkey, c_name, o_totalprice::DOUBLE AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def table_set(spark, sf_dir):
    """A set of tables saved and loaded, filters reach the files (SRC41, SNK1, SNK20)."""
    path = new_folder(spark, "tables")
    writers.save_tables({n: table(spark, sf_dir, n) for n in ("orders", "customer")}, path)
    o, c = (spark.read.parquet(f"{path}/{n}") for n in ("orders", "customer"))
    return o.where("o_totalprice > 100000").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("labels_tsv", "SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'tab' || chr(9) || 'here' ELSE 'say \"x\"' END AS note FROM labels")
def labels_tsv(spark, sf_dir):
    """Label rows as tab-separated values, tabs and quotes inside (SRC18, SRC19,
    SRC26, SRC35, SRC36, SNK2, SNK5, SNK6, SNK9, SNK19)."""
    note = F.when(F.col("toxic") == 1, "tab\there").otherwise('say "x"')
    path = new_folder(spark, "labels")
    writers.tsv(table(spark, sf_dir, "labels").select("doc_id", "quality", note.alias("note")), path)
    return readers.tsv(spark, path, "doc_id long, quality int, note string", header=True)


@query(
    "story_sheet",
    """WITH t AS (SELECT conv_id, turn, replace(replace(text, chr(10), ' '), chr(9), ' ') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id::BIGINT AS story_id, 'F' || turn % 3 AS function, 'say' AS verb, CASE WHEN turn % 2 = 0 THEN 'one' END AS subject, 'two' AS object, turn % 4 = 1 AS negated, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length(text)::BIGINT AS len FROM t""",
)
def story_sheet(spark, sf_dir):
    """A sheet whose story ids stand in the first rows only, with annotations
    (SRC21, SRC22): ids are carried forward, offsets run on."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    clean = F.translate("text", "\n\t", "  ")
    note = F.concat(F.when(F.col("turn") % 4 == 1, "!").otherwise(""), F.lit("say,"), F.when(F.col("turn") % 2 == 0, "one").otherwise(""), F.lit(",two;"))
    cells = [F.when(first, F.col("conv_id").cast("string")).otherwise(""), F.lit("x"), F.lit("y"), F.concat(F.lit("F"), (F.col("turn") % 3).cast("string")), note, clean]
    rows = c.select(F.col("conv_id").alias("by"), F.col("turn").alias("n"), F.concat_ws("\t", *cells).alias("value"))
    got = readers.inline_annotations(readers.story_rows(spark, lines_of(rows, "sheet", "by")))
    return got.select("story_id", "function", "verb", "subject", "object", "negated", "offset", "len")


@query(
    "quoted_corpus",
    """SELECT conv_id::VARCHAR || '-' || turn AS ref, 'QUOTE' AS kind, trim(regexp_replace(text, '[<>&]', '', 'g')) AS text FROM conversations WHERE trim(regexp_replace(text, '[<>&]', '', 'g')) <> ''
    UNION ALL SELECT role, 'PERSON', 'The ' || role FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL UNION ALL SELECT '', 'TEXT', 'said' FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL""",
)
def quoted_corpus(spark, sf_dir):
    """Paragraphs with marked quotes and persons (SRC20)."""
    c = table(spark, sf_dir, "conversations").where("text is not null and role is not null")
    quote = F.concat(F.lit('<QUOTE speaker="'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit('">'), F.regexp_replace("text", "[<>&]", ""), F.lit("</QUOTE>"))
    person = F.concat(F.lit(' said <PERSON entity="'), "role", F.lit('">The '), "role", F.lit("</PERSON>"))
    rows = c.select(F.col("conv_id").alias("by"), F.col("turn").alias("n"), F.concat(F.lit("<PARAGRAPH>"), quote, person, F.lit("</PARAGRAPH>")).alias("value"))
    return readers.quoted_xml(spark, lines_of(rows, "quotes", "by")).where("not (kind = 'QUOTE' and text = '')").select("ref", "kind", "text")


@query(
    "foreign_labels",
    """SELECT 'Tale ' || conv_id AS story, (2 * rank() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS pos, 2 AS depth, CASE role WHEN 'user' THEN 'U' ELSE 'A' END AS label FROM conversations WHERE role IS NOT NULL QUALIFY role <> 'system'""",
)
def foreign_labels(spark, sf_dir):
    """A foreign corpus: a Move around each turn's element, whose name is
    mapped to a label; comments hold tags that don't count (SRC25)."""
    c = table(spark, sf_dir, "conversations").where("role is not null")
    one = F.concat(F.lit("<Move><!-- <Gone/> --><"), F.initcap("role"), F.lit(' subtype="x">text</'), F.initcap("role"), F.lit("></Move>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))), lambda x: x["x"]), "\n")  # a story's turns
    tales = c.groupBy("conv_id").agg(body.alias("b"))
    rows = tales.select(F.col("conv_id").alias("n"), F.concat(F.lit('<Folktale Title="Tale '), F.col("conv_id").cast("string"), F.lit('">\n'), "b", F.lit("</Folktale>")).alias("value"))
    mapping = spark.createDataFrame([("User", "U"), ("Assistant", "A"), ("System", ""), ("Gone", "G")], "tag string, label string")
    return readers.mapped_tags(spark, lines_of(rows, "tales"), "Folktale", "Title", mapping)


@query("story_texts", "SELECT string_agg(trim(text, chr(10)), chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text, chr(10)) <> '' AND NOT contains(text, chr(13)) GROUP BY conv_id")
def story_texts(spark, sf_dir):
    """A text file for each story, comments left out (SNK7, SNK8, SNK13, SNK18, SRC1)."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.trim("text", F.lit("\n"))).where("text <> '' and not contains(text, '\r')")
    noted = c.withColumn("text", F.concat(F.lit("/* turn\n */"), "text"))
    one = writers.joined_text(noted.select("conv_id", "turn", writers.without_comments(F.col("text")).alias("text")), "conv_id", "turn", "text")
    path = new_folder(spark, "texts")
    formats.register(spark)
    one.select(F.col("conv_id").cast("string").alias("doc_id"), "text").write.format("stories").mode("overwrite").save(path)
    return spark.read.format("stories").load(path).select(F.regexp_replace("text", "\n$", "").alias("text"))
