"""Tables from the layers of stand-off annotated stories.

All functions take rows of the ``standoff`` format (doc_id, layer, id, offset,
length, value); a document's layers may come from any number of files. What a
layer lacks gives no rows; ids that point nowhere are dropped by the joins."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: The layers' names in the format.
LAYERS = {
    "text": "edu.mit.story.char", "token": "edu.mit.parsing.token", "pos": "edu.mit.parsing.pos", "stem": "edu.mit.parsing.stem", "sentence": "edu.mit.parsing.sentence",
    "parse": "edu.mit.parsing.parse", "colloc": "edu.mit.parsing.colloc", "sense": "edu.mit.wordnet.sense", "mention": "edu.mit.discourse.rep.refexp",
    "coref": "edu.mit.discourse.rep.coref", "function": "edu.mit.semantics.rep.function", "role": "edu.mit.semantics.semroles",
}


def layer(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("layer") == LAYERS[name]).select("doc_id", "id", "offset", F.col("length").alias("len"), F.trim("value").alias("value"))


def as_layer(df: DataFrame, name: str) -> DataFrame:
    """Rows to write from doc_id, id, offset, len and value."""
    return df.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(LAYERS[name]).alias("layer"), F.col("id").cast("long").alias("id"), F.col("offset").cast("long").alias("offset"), F.col("len").cast("long").alias("length"), F.col("value"))


def numbers(column: str, pattern: str = "[~,]"):
    return F.transform(F.filter(F.split(column, pattern), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))


def tokens(rows: DataFrame) -> DataFrame:
    """Tokens with tag and lemma (SRC10): a tag names its token, a stem names
    its tag; without one the tag is ``?`` and the lemma the lower-case text."""
    pair = lambda name: layer(rows, name).select("doc_id", F.col("id").alias(f"{name}_id"), F.split("value", r"\s+", 2)[0].cast("long").alias("of"), F.get(F.split("value", r"\s+", 2), F.lit(1)).alias(name))
    tags, stems = pair("pos"), pair("stem").drop("stem_id").withColumnRenamed("of", "pos_id")
    t = layer(rows, "token").join(tags.withColumnRenamed("of", "id"), ["doc_id", "id"], "left").join(stems, ["doc_id", "pos_id"], "left")
    return t.select("doc_id", F.col("id").alias("token_id"), "offset", "len", F.col("value").alias("text"), F.coalesce("pos", F.lit("?")).alias("pos"), F.coalesce("stem", F.lower("value")).alias("lemma"))


def members(rows: DataFrame, name: str) -> DataFrame:
    """doc_id, id, k, token_id of a layer of token lists, ``1~2,5`` (SRC11,
    SRC12): sentences, mentions, collocations."""
    return layer(rows, name).select("doc_id", "id", F.posexplode(numbers("value")).alias("k", "token_id"))


def groups(rows: DataFrame) -> DataFrame:
    """doc_id, group_id, name, mention_id of ``name|1,2`` (SRC13)."""
    cut = F.length("value") - F.length(F.substring_index("value", "|", -1)) - 1
    g = layer(rows, "coref").where(F.contains("value", F.lit("|"))).select("doc_id", F.col("id").alias("group_id"), F.substr("value", F.lit(1), cut).alias("name"), F.substring_index("value", "|", -1).alias("list"))
    return g.select("doc_id", "group_id", "name", F.explode(numbers("list")).alias("mention_id"))


def functions(rows: DataFrame) -> DataFrame:
    """doc_id, function_id, label, place, kind, token_ids (SRC15) of
    ``label|kind:1~2,4~5|kind:7``; ``NORMAL:x:label`` is its last part."""
    parts = F.split("value", r"\|")
    label = F.when(F.startswith(parts[0], F.lit("NORMAL")), F.get(F.split(parts[0], ":"), F.lit(2))).otherwise(parts[0])
    one = F.flatten(F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.transform(F.split(F.get(F.split(p, ":"), F.lit(1)), ","), lambda g: F.struct(F.split(p, ":")[0].alias("kind"), F.transform(F.split(g, "~"), lambda x: x.cast("long")).alias("token_ids")))))
    f = layer(rows, "function").where(F.contains("value", F.lit("|"))).select("doc_id", F.col("id").alias("function_id"), label.alias("label"), F.posexplode(one).alias("place", "l"))
    return f.select("doc_id", "function_id", "label", "place", "l.kind", "l.token_ids")


def senses(rows: DataFrame) -> DataFrame:
    """doc_id, mention_id, sense (SRC14): noun senses of the smallest mention
    over each of their tokens, ties to the least id. A sense that names a
    collocation stands for all of its tokens; NO_SENSE rows say nothing."""
    p = F.split("value", ",")
    s = layer(rows, "sense").select("doc_id", p[0].alias("sense"), F.get(p, F.lit(2)).try_cast("long").alias("of")).where(F.col("sense").rlike("^WID-[^-]*-N-"))
    whole = members(rows, "colloc").select("doc_id", F.col("id").alias("of"), "token_id")
    at = s.join(whole, ["doc_id", "of"], "left").select("doc_id", "sense", F.coalesce("token_id", "of").alias("token_id"))
    m = members(rows, "mention")
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "id"))
    m = m.withColumn("size", size).groupBy("doc_id", "token_id").agg(F.min(F.struct("size", F.col("id").alias("mention_id"))).alias("m"))
    return at.join(m, ["doc_id", "token_id"]).select("doc_id", "m.mention_id", "sense").distinct()


NODE = StructType([StructField(n, IntegerType()) for n in ("node", "last", "depth", "first_leaf", "end_leaf")] + [StructField("label", StringType())])
BRACKET = re.compile(r"\(\s*([^\s()]*)|\)|[^\s()]+")


def tree_nodes(text: str | None) -> list[dict]:
    """Nodes of a bracketed tree, numbered in preorder: the last descendant's
    number and the leaves [first_leaf, end_leaf). Words are no nodes. Brackets
    that don't close end with the text, surplus ones close nothing."""
    out, open_nodes, leaf = [], [], 0

    def close():
        n = open_nodes.pop()
        n["last"], n["end_leaf"] = len(out) - 1, leaf

    for m in BRACKET.finditer(text or ""):
        if m[0][0] == "(":
            n = {"node": len(out), "last": 0, "depth": len(open_nodes), "first_leaf": leaf, "end_leaf": leaf, "label": m[1]}
            out.append(n)
            open_nodes.append(n)
        elif m[0] != ")":
            leaf += 1
        elif open_nodes:
            close()
    while open_nodes:
        close()
    return out


def sentence_trees(rows: DataFrame) -> DataFrame:
    """doc_id, sentence_id and the nodes of a parse string, which belongs to
    the sentence of its offset (SRC44). The strings are dealt out before they
    are parsed: they are few bytes, of which Spark makes few tasks."""

    @F.pandas_udf(ArrayType(NODE))
    def nodes(texts: pd.Series) -> pd.Series:
        return texts.map(tree_nodes)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = layer(rows, "sentence").groupBy("doc_id", "offset").agg(F.min("id").alias("sentence_id"))
    p = layer(rows, "parse").join(s, ["doc_id", "offset"]).select("doc_id", "sentence_id", "value").repartition(parts, "doc_id", "sentence_id")
    return p.select("doc_id", "sentence_id", nodes("value").alias("nodes"))


def parse_nodes(rows: DataFrame) -> DataFrame:
    """doc_id, sentence_id, node, last, depth, first_leaf, end_leaf, label of
    parse strings."""
    return sentence_trees(rows).select("doc_id", "sentence_id", F.explode("nodes").alias("n")).select("doc_id", "sentence_id", "n.*")


def verb_roles(rows: DataFrame) -> DataFrame:
    """doc_id, role_id, verb_token, frame, label and token_ids (SRC16) of
    ``verb user frame aspect leaf:up,leaf:up-ARGn-suffix ...``: an argument is
    what the ancestor ``up`` levels above a leaf's own node spans."""
    s = layer(rows, "sentence").groupBy("doc_id", "offset").agg(F.min("id").alias("sentence_id"))
    word = members(rows, "sentence").select("doc_id", F.col("id").alias("sentence_id"), F.col("k").alias("leaf"), "token_id")
    trees = sentence_trees(rows).groupBy("doc_id", "sentence_id").agg(F.flatten(F.collect_list("nodes")).alias("nodes"))  # a sentence's nodes
    p = F.split("value", r"\s+")
    r = layer(rows, "role").join(s, ["doc_id", "offset"]).join(trees.hint("merge"), ["doc_id", "sentence_id"])  # trees are larger than their bytes in a shuffle
    r = r.select("doc_id", "sentence_id", F.col("id").alias("role_id"), p[0].cast("int").alias("verb"), F.get(p, F.lit(2)).alias("frame"), "nodes", F.explode(F.slice(p, 5, 1 << 30)).alias("arg"))
    a = F.split("arg", "-")
    suffix = F.get(a, F.lit(2))
    r = r.withColumn("label", F.concat(F.regexp_replace(a[1], "RG", ""), F.when(suffix != "", F.concat(F.lit("-"), suffix)).otherwise("")))
    r = r.withColumn("spot", F.explode(F.split(a[0], ","))).withColumn("leaf", F.split("spot", ":")[0].cast("int")).withColumn("up", F.split("spot", ":")[1].cast("int"))
    r = r.withColumn("over", F.filter("nodes", lambda n: (n["first_leaf"] <= F.col("leaf")) & (F.col("leaf") < n["end_leaf"]))).drop("nodes")
    own = F.array_max(F.transform("over", lambda n: n["depth"]))
    at = r.withColumn("at", F.explode(F.filter("over", lambda n: n["depth"] == own - F.col("up")))).select("*", "at.first_leaf", "at.end_leaf")
    spanned = at.select("doc_id", "sentence_id", "role_id", "verb", "frame", "label", F.explode(F.sequence("first_leaf", F.col("end_leaf") - 1)).alias("leaf"))
    named = spanned.join(word, ["doc_id", "sentence_id", "leaf"]).groupBy("doc_id", "sentence_id", "role_id", "verb", "frame", "label").agg(F.array_sort(F.collect_set("token_id")).alias("token_ids"))  # a sentence's tokens
    verb = word.select("doc_id", "sentence_id", F.col("leaf").alias("verb"), F.col("token_id").alias("verb_token"))
    return named.join(verb, ["doc_id", "sentence_id", "verb"]).select("doc_id", "role_id", "verb_token", "frame", "label", "token_ids")


def texts(rows: DataFrame) -> DataFrame:
    """doc_id and the original text (SRC44), as it stands in the file."""
    return rows.where(F.col("layer") == LAYERS["text"]).groupBy("doc_id").agg(F.min_by("value", "id").alias("text"))
