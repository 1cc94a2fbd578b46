"""Readers: text, parser output, stand-off layers, tables and taxonomies.

Every reader goes through Spark's own sources with a stated schema; what a file
format nests is exploded into rows. ``key`` columns come from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions.text import tokens

BY_FILE = "_file"


def file_key(column: Column | None = None) -> Column:
    """The file's name without folders and its last ending."""
    return F.regexp_extract(F.col("_metadata.file_path") if column is None else column, r"([^/]+?)(?:\.[^./]*)?$", 1)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents (SRC1, SRC2): doc_id, text."""
    return spark.read.text(path, wholetext=True).select(file_key().alias("doc_id"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files in order: doc_id, n, value. Line numbers come from the
    whole file's array, so they do not depend on splits."""
    whole = text_documents(spark, path)
    return whole.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n")).alias("n", "value"))


def filled(df: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """Carries the last non-null ``value`` forward (headers over their rows)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


PARSER_SCHEMA = """_name string, sentences struct<sentence:array<struct<_id:int,tokens:struct<token:array<struct<_id:int,word:string,lemma:string,CharacterOffsetBegin:bigint,CharacterOffsetEnd:bigint,POS:string>>>,
parse:string,dependencies:array<struct<_type:string,dep:array<struct<_type:string,governor:struct<_VALUE:string,_idx:int>,dependent:struct<_VALUE:string,_idx:int>>>>>>>>,
coreference struct<coreference:array<struct<mention:array<struct<_representative:boolean,sentence:int,start:int,end:int,head:int>>>>>"""


def parser_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per parsed document (SRC3-SRC8) for the functions below. A
    document without a ``name`` is called as its file."""
    return spark.read.schema(PARSER_SCHEMA).format("xml").option("rowTag", "document").load(path).select(F.coalesce("_name", file_key()).alias("doc_id"), "sentences", "coreference")


def parser_tokens(parsed: DataFrame) -> DataFrame:
    s = parsed.select("doc_id", F.explode("sentences.sentence").alias("s"))
    t = s.select("doc_id", F.col("s._id").alias("sent_id"), F.explode("s.tokens.token").alias("t"))
    begin, end = F.col("t.CharacterOffsetBegin"), F.col("t.CharacterOffsetEnd")
    return t.select(
        "doc_id", "sent_id", F.col("t._id").alias("idx"), begin.alias("offset"), (end - begin).alias("len"), F.coalesce("t.POS", F.lit("?")).alias("pos"), F.col("t.lemma").alias("lemma"), F.col("t.word").alias("text")
    )


def parser_dependencies(parsed: DataFrame, kind: str = "basic-dependencies") -> DataFrame:
    s = parsed.select("doc_id", F.explode("sentences.sentence").alias("s"))
    d = s.select("doc_id", F.col("s._id").alias("sent_id"), F.explode("s.dependencies").alias("d")).where(F.col("d._type") == kind)
    e = d.select("doc_id", "sent_id", F.explode("d.dep").alias("e"))
    return e.select("doc_id", "sent_id", F.col("e._type").alias("type"), F.col("e.governor._idx").alias("gov_idx"), F.col("e.dependent._idx").alias("dep_idx"))


def parser_chains(parsed: DataFrame) -> DataFrame:
    """Mentions of coreference chains (SRC7): the chain's number is its group."""
    c = parsed.select("doc_id", F.posexplode("coreference.coreference").alias("grp", "c"))
    m = c.select("doc_id", "grp", F.explode("c.mention").alias("m"))
    return m.select("doc_id", "grp", F.col("m.sentence").alias("sent_id"), F.col("m.start").alias("tok_start"), F.col("m.end").alias("tok_end"), F.coalesce("m._representative", F.lit(False)).alias("representative"))


def standoff_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Rows of one ``<desc id off len>payload</desc>`` layer (SRC9)."""
    schema = "_id string, desc array<struct<_id:bigint,_off:bigint,_len:bigint,_VALUE:string>>"
    r = spark.read.schema(schema).format("xml").option("rowTag", "rep").load(path).where(F.col("_id") == layer)
    return r.select(file_key().alias("doc_id"), F.explode("desc").alias("d")).select(
        "doc_id", F.col("d._id").alias("id"), F.col("d._off").alias("offset"), F.col("d._len").alias("len"), F.trim("d._VALUE").alias("value")
    )


def standoff_tokens(toks: DataFrame, pos: DataFrame, stems: DataFrame) -> DataFrame:
    """Tokens with part of speech and lemma, by default the lower text (SRC10).
    The payload of pos and stem layers is ``token_id value``."""
    part = lambda df, name: df.select("doc_id", F.split("value", r"\s+")[0].cast("long").alias("id"), F.split("value", r"\s+")[1].alias(name))
    t = toks.join(part(pos, "pos"), ["doc_id", "id"], "left").join(part(stems, "lemma"), ["doc_id", "id"], "left")
    return t.select("doc_id", "id", "offset", "len", F.col("value").alias("text"), F.coalesce("pos", F.lit("?")).alias("pos"), F.coalesce("lemma", F.lower("value")).alias("lemma"))


def id_lists(df: DataFrame, sep: str = "~") -> DataFrame:
    """``1~2~3`` payloads to (doc_id, id, pos, token_id) (SRC11, SRC12)."""
    return df.select("doc_id", "id", F.posexplode(F.split("value", sep)).alias("pos", "token")).select("doc_id", "id", "pos", F.trim("token").cast("long").alias("token_id"))


def named_groups(df: DataFrame) -> DataFrame:
    """``name|1,2,3`` payloads to (doc_id, name, member) (SRC13)."""
    p = F.split("value", r"\|")
    return df.select("doc_id", p[0].alias("name"), F.explode(F.split(p[1], ",")).alias("m")).select("doc_id", "name", F.trim("m").cast("long").alias("member"))


def located_labels(df: DataFrame) -> DataFrame:
    """``label|kind:1~2,kind:3`` payloads to (doc_id, id, label, kind,
    token_ids) (SRC15)."""
    p = F.split("value", r"\|")
    g = df.select("doc_id", "id", p[0].alias("label"), F.explode(F.split(p[1], ",")).alias("g"))
    return g.select("doc_id", "id", "label", F.split("g", ":")[0].alias("kind"), F.transform(F.split(F.split("g", ":")[1], "~"), lambda x: x.cast("long")).alias("token_ids"))


def tsv(spark: SparkSession, path: str, schema: str, header: bool = False, comment: str | None = None) -> DataFrame:
    """Tab-separated rows with a stated schema (SRC18, SRC26, SRC32, SRC35)."""
    r = spark.read.schema(schema).option("sep", "\t").option("header", header)
    return (r.option("comment", comment) if comment else r).csv(path)


def story_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of stories whose id stands in the first row only (SRC21): ids are
    carried forward, offsets are running lengths plus one."""
    l = lines(spark, path)
    c = F.split("value", "\t", -1)
    rows = l.where(F.size(c) >= 6).select("doc_id", "n", F.expr("try_cast(trim(split(value, '\\t', -1)[0]) as bigint)").alias("_id"), c[3].alias("function"), c[4].alias("annotations"), c[5].alias("text"))
    rows = filled(rows, "doc_id", "n", F.col("_id"), "story_id").drop("_id")
    w = Window.partitionBy("doc_id", "story_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long")).withColumn("len", F.length("text").cast("long"))


def inline_annotations(df: DataFrame) -> DataFrame:
    """``verb,subj,obj;...`` to (verb, subject, object, negated); a leading
    ``!`` negates, ``token/n`` is the n-th occurrence (SRC22)."""
    a = df.select(*[c for c in df.columns if c != "annotations"], F.explode(F.filter(F.split("annotations", ";"), lambda x: F.trim(x) != "")).alias("a"))
    p = F.transform(F.split("a", ",", -1), lambda x: F.trim(x))
    verb = F.get(p, F.lit(0))
    return a.withColumns({"negated": F.startswith(verb, F.lit("!")), "verb": F.regexp_replace(verb, "^!", ""), "subject": F.nullif(F.get(p, F.lit(1)), F.lit("")), "object": F.nullif(F.get(p, F.lit(2)), F.lit(""))}).drop("a")


def nth_occurrence(text: Column, token: Column) -> Column:
    """Offset of ``word/n`` in a text (n from 1, 1 if not given); -1 if it is
    not there."""
    word, n = F.split(token, "/")[0], F.coalesce(F.get(F.split(token, "/"), F.lit(1)).cast("int"), F.lit(1))
    before = F.call_function("substring_index", text, word, n)
    return F.when(F.length(before) < F.length(text), F.length(before)).otherwise(-1)


def indented(spark: SparkSession, path: str) -> DataFrame:
    """Tab-indented outline to child, parent rows (SRC28-SRC30): a line's
    parent is the last line before it with one tab less. A window for each
    depth carries that depth's last line forward."""
    l = lines(spark, path).where(F.trim("value") != "").withColumn("depth", F.length(F.regexp_extract("value", r"^(\t*)", 1)))
    l = l.withColumn("name", F.regexp_replace("value", r"^\s+|\s+$", ""))
    deepest = l.agg(F.max("depth")).first()[0] or 0
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("depth") == d + 1, F.last(F.when(F.col("depth") == d, F.col("name")), ignorenulls=True).over(w)) for d in range(deepest)]
    return l.select("doc_id", "n", "depth", F.col("name").alias("child"), F.coalesce(*last, F.lit(None).cast("string")).alias("parent"))


def capital_code(name: Column) -> Column:
    """A taxonomy code: the capital letters of a name."""
    return F.regexp_replace(name, "[^A-Z]", "")


def automaton(spark: SparkSession, path: str) -> DataFrame:
    """``from label,label to`` lines to edges (SRC31)."""
    p = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).where(F.size(p) == 3).select(p[0].alias("state"), F.explode(F.split(p[1], ",")).alias("label"), p[2].alias("target"))


def grammar_terminals(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of ``LHS -> RHS`` rules that are no left-hand side (SEQ6)."""
    p = F.split("value", r"\s*->\s*")
    rules = lines(spark, path).where(F.size(p) == 2).select("doc_id", F.trim(p[0]).alias("lhs"), F.explode(F.split(F.trim(p[1]), r"[\s|]+")).alias("symbol"))
    return rules.join(rules.select("doc_id", F.col("lhs").alias("symbol")).distinct(), ["doc_id", "symbol"], "left_anti").select("doc_id", F.col("symbol").alias("label")).distinct()


def conll(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated tokens, blank lines between sentences (SRC43)."""
    l = lines(spark, path)
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("sent_id", F.count_if(F.trim("value") == "").over(w))
    p = F.split("value", "\t", -1)
    field = lambda k: F.get(p, F.lit(k))
    return l.where(F.trim("value") != "").select(
        "doc_id", "sent_id", field(0).cast("int").alias("idx"), field(1).alias("form"), field(2).alias("lemma"), field(3).alias("pos"), field(4).alias("feats"), field(5).cast("int").alias("head"), field(6).alias("deprel"), field(7).alias("ner")
    )


def standoff_spans(spark: SparkSession, path: str) -> DataFrame:
    """``T``/``A`` rows of stand-off files (SRC43): spans with an attribute map."""
    l = lines(spark, path)
    p = F.split("value", r"[\t ]")
    t = l.where(F.startswith("value", F.lit("T"))).select(
        "doc_id", p[0].alias("id"), p[1].alias("type"), p[2].cast("long").alias("offset"), (p[3].cast("long") - p[2].cast("long")).alias("len"), F.split("value", "\t")[2].alias("text")
    )
    a = l.where(F.startswith("value", F.lit("A"))).select("doc_id", p[2].alias("id"), F.struct(p[1].alias("k"), p[3].alias("v")).alias("kv"))
    attrs = a.groupBy("doc_id", "id").agg(F.map_from_entries(F.collect_list("kv")).alias("attributes"))  # a span's attributes
    return t.join(attrs, ["doc_id", "id"], "left")


def arff(spark: SparkSession, path: str) -> DataFrame:
    """Data rows of an ARFF file: doc_id, n, attrs, label (SRC27)."""
    l = lines(spark, path)
    rows = l.where(~F.col("value").rlike(r"^\s*(@|%|$)"))
    p = F.split("value", ",")
    return rows.select("doc_id", "n", F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x.cast("double")).alias("attrs"), F.trim(F.element_at(p, -1)).alias("label"))


def zipped(left: DataFrame, right: DataFrame, by: str = "n") -> DataFrame:
    """Two files row by row (SRC27, SRC36): ranks, then an equi-join."""
    rank = lambda d: d.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy(by)))
    return rank(left).drop(by, "doc_id").join(rank(right).drop(by, "doc_id"), "row")


def records(spark: SparkSession, path: str, size: int, names: list[str]) -> DataFrame:
    """Every ``size`` lines are one record (SRC39); names for its lines."""
    l = lines(spark, path).withColumn("record", F.floor(F.col("n") / size)).withColumn("k", F.col("n") % size)
    return l.groupBy("doc_id", "record").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(n) for k, n in enumerate(names)])


def marked_blocks(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """Blocks that begin with a line matching ``marker`` (SRC38): block,
    header, lines joined by line ends."""
    l = lines(spark, path)
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    b = l.withColumn("block", F.count_if(F.col("value").rlike(marker)).over(w)).where("block > 0")
    head = F.min_by("value", "n")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n")  # a block's lines
    return b.groupBy("doc_id", "block").agg(head.alias("header"), body.alias("text"))


def term_file(spark: SparkSession, path: str) -> DataFrame:
    """``term count`` lines under ``@`` headers (SRC40): doc_id, term, n."""
    l = lines(spark, path).where(~F.startswith("value", F.lit("@")) & F.col("value").rlike(r"\s\d+$"))
    return l.select("doc_id", F.regexp_extract("value", r"^(.*)\s\d+$", 1).alias("term"), F.regexp_extract("value", r"(\d+)$", 1).cast("long").alias("n"))


def survey_json(spark: SparkSession, path: str) -> DataFrame:
    """One flat JSON object per ``uid_event`` file (SRC37, JSN1): uid, event,
    name, value rows; a list counts by its first entry."""
    whole = spark.read.text(path, wholetext=True).select(file_key().alias("f"), F.from_json("value", "map<string,string>").alias("m"))
    e = whole.select(F.split("f", "_")[0].alias("uid"), F.split("f", "_")[1].alias("event"), F.explode("m").alias("name", "value"))
    return e.withColumn("value", F.regexp_replace("value", r'^\["?|"?\]$', ""))


def lexicon(spark: SparkSession, path: str, names: list[str], comment: str = ";;;", sep: str = " ") -> DataFrame:
    """Comment-skipping word lists (SRC47): fields under the given names."""
    p = F.split(F.trim("value"), sep)
    l = lines(spark, path).where((F.trim("value") != "") & ~F.startswith("value", F.lit(comment)))
    return l.select(*[F.get(p, F.lit(k)).alias(n) for k, n in enumerate(names)])


def synset_scores(spark: SparkSession, path: str) -> DataFrame:
    """``pos id positive negative terms`` rows to word scores (SRC32, SRC48)."""
    t = tsv(spark, path, "pos string, id string, positive double, negative double, terms string, gloss string", comment="#")
    w = t.select("pos", F.explode(F.split("terms", " ")).alias("t"), "positive", "negative").where("positive is not null")
    return w.groupBy(F.regexp_replace("t", "#.*$", "").alias("word"), "pos").agg(F.avg("positive").alias("positive"), F.avg("negative").alias("negative"))


def quoted_xml(spark: SparkSession, path: str, tag: str = "PARAGRAPH") -> DataFrame:
    """Mixed content of paragraphs as ordered pieces (SRC20): doc_id, paragraph,
    pos, kind, attributes, text. The row tag's own text is cut at tags."""
    whole = text_documents(spark, path)
    paragraphs = whole.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))).alias("paragraph", "body"))
    piece = F.regexp_extract_all("body", F.lit(r"(?s)<(?:PERSON|ORGANIZATION|QUOTE)\b[^>]*>.*?</(?:PERSON|ORGANIZATION|QUOTE)>|[^<]+"), F.lit(0))
    p = paragraphs.select("doc_id", "paragraph", F.posexplode(piece).alias("pos", "raw")).where(F.trim("raw") != "")
    kind = F.regexp_extract("raw", r"^<(\w+)", 1)
    return p.select(
        "doc_id", "paragraph", "pos", F.when(kind == "", "TEXT").otherwise(kind).alias("kind"),
        F.regexp_extract("raw", r'(?:entity|speaker)="([^"]*)"', 1).alias("ref"), F.trim(F.regexp_replace("raw", "<[^>]*>", "")).alias("text"),
    )


def light_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token lists only (SRC6)."""
    return docs.select(key, tokens(text).alias("tokens"))


SENTIMENT_SCHEMA = "_form string, _pos string, _polarity double, _subjectivity double, _intensity double, _label string, _wordnet_id string, _confidence double"


def sentiment_xml(spark: SparkSession, path: str, least_confidence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``<word form pos polarity subjectivity intensity wordnet_id/>`` files
    (SRC33): (word, pos, polarity, subjectivity, intensity), means over a
    word's senses for each tag and, where pos is null, over its tags; and the
    same by synset. Missing numbers are 0, a missing intensity is 1. Rows
    without a tag are a tag of their own, called ``''``."""
    r = spark.read.schema(SENTIMENT_SCHEMA).format("xml").option("rowTag", "word").load(path)
    if least_confidence is not None:
        r = r.where(F.coalesce("_confidence", F.lit(0.0)) >= least_confidence)
    r = r.select(
        F.col("_form").alias("word"), F.coalesce("_pos", F.lit("")).alias("pos"), F.col("_wordnet_id").alias("synset"),
        F.coalesce("_polarity", F.lit(0.0)).alias("polarity"), F.coalesce("_subjectivity", F.lit(0.0)).alias("subjectivity"), F.coalesce("_intensity", F.lit(1.0)).alias("intensity"),
    )
    means = [F.avg(c).alias(c) for c in ("polarity", "subjectivity", "intensity")]
    by_tag = r.where("word <> ''").groupBy("word", "pos").agg(*means)
    every = by_tag.groupBy("word").agg(*means).select("word", F.lit(None).cast("string").alias("pos"), "polarity", "subjectivity", "intensity")
    return by_tag.union(every), r.where("synset <> ''").groupBy("synset").agg(*means)


def mapped_tags(spark: SparkSession, path: str, story_tag: str, title: str, mapping: DataFrame) -> DataFrame:
    """Labels of a foreign XML corpus in document order (SRC25): each
    ``story_tag`` element is a story called by its ``title`` attribute, every
    element inside is looked up by its name in ``mapping`` (tag, label). Gives
    story, pos (the element's number in the story), depth and label; elements
    without a label count but give no row, nor do comments or text."""
    whole = text_documents(spark, path)
    story = F.regexp_extract_all("text", F.lit(rf"(?s)<{story_tag}\b[^>]*>.*?</{story_tag}>"), F.lit(0))
    # A comment may hold tags; it goes first.
    s = whole.select("doc_id", F.posexplode(story).alias("k", "body")).withColumn("body", F.regexp_replace("body", r"(?s)<!--.*?-->", ""))
    name = F.regexp_extract("body", rf'^<{story_tag}\b[^>]*\b{title}="([^"]*)"', 1)
    tags = F.regexp_extract_all("body", F.lit(r"</?[A-Za-z][^>]*>"), F.lit(0))
    each = s.select("doc_id", "k", name.alias("story"), F.posexplode(F.slice(tags, 2, 1 << 30)).alias("n", "tag"))
    w = Window.partitionBy("doc_id", "k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    closing, alone = F.startswith("tag", F.lit("</")), F.endswith("tag", F.lit("/>"))
    step = F.when(closing, -1).when(alone, 0).otherwise(1)
    each = each.withColumn("pos", F.count_if(~closing).over(w)).withColumn("depth", (F.sum(step).over(w) + alone.cast("int")).cast("int")).where(~closing)
    known = mapping.where("label <> ''").select(F.col("tag").alias("_tag"), "label")
    return each.withColumn("_tag", F.regexp_extract("tag", r"^<([\w:.-]+)", 1)).join(known, "_tag").select("story", "pos", "depth", "label")
