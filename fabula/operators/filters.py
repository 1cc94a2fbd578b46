"""Predicates and filters over the text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_tag(tokens: DataFrame, tags: list[str], column: str = "pos") -> DataFrame:
    """Tokens of given tags (FLT1)."""
    return tokens.where(F.col(column).isin(*tags))


def is_character(types: str, taxonomy: DataFrame, mentions: DataFrame) -> DataFrame:
    """Adds ``character`` (FLT4): an explicit flag, else whether the type's
    parent code is CH. Taxonomy: code, parent."""
    t = taxonomy.select(F.col("code").alias("_code"), (F.coalesce("parent", "code") == "CH").alias("_ch"))
    j = mentions.join(t, F.col(types) == F.col("_code"), "left")
    known = F.col("character") if "character" in mentions.columns else F.lit(None).cast("boolean")
    return j.withColumn("character", F.coalesce(known, "_ch", F.lit(False))).drop("_code", "_ch")


def having_label(df: DataFrame, labels: str, value: str) -> DataFrame:
    return df.where(F.array_contains(labels, value))  # FLT2


def independent(mentions: DataFrame) -> DataFrame:
    """Independent mentions that are not to be split (FLT3, FLT10)."""
    return mentions.where(F.col("is_independent") & ~F.coalesce("split_ignore", F.lit(False)))


def is_normal(speech: Column) -> Column:
    """A sentence whose speech labels are just ``c`` (FLT5, FLT21)."""
    return F.array_distinct(speech) == F.array(F.lit("c"))


def without_quoted(sents: DataFrame, mentions: DataFrame, speech: str = "speech") -> tuple[DataFrame, DataFrame]:
    """Normal sentences, and mentions of them (FLT6)."""
    kept = sents.where(is_normal(F.col(speech)))
    return kept, mentions.join(kept.select("doc_id", "sent_id"), ["doc_id", "sent_id"], "left_semi")


def remove_mentions(mentions: DataFrame, removed: DataFrame) -> DataFrame:
    """Removes mentions and all below them (FLT7). Only children of a removed
    parent's parent stay and move up. Tables: doc_id, mention_id, parent_id."""
    from fabula.operators.hierarchy import ancestors

    node = lambda c: F.struct(F.col("doc_id"), F.col(c).alias("m"))
    edges = mentions.where("parent_id is not null").select(node("mention_id").alias("child"), node("parent_id").alias("parent"))
    below = ancestors(edges).select("child.doc_id", F.col("child.m").alias("mention_id"), F.col("ancestor.m").alias("top"))
    gone = removed.select("doc_id", "mention_id").union(below.join(removed.withColumnRenamed("mention_id", "top"), ["doc_id", "top"]).select("doc_id", "mention_id"))
    return mentions.join(gone.distinct(), ["doc_id", "mention_id"], "left_anti")


def dependencies(deps: DataFrame, types: list[str], first: int | None = None, last: int | None = None, field: str = "dep_idx") -> DataFrame:
    """Types in a list or by a prefix ``x*``, within an index range (FLT8)."""
    hit = F.lit(False)
    for t in types:
        hit = hit | (F.startswith("type", F.lit(t[:-1])) if t.endswith("*") else F.col("type") == t)
    out = deps.where(hit)
    return out if first is None else out.where(F.col(field).between(first, last))


def same_fields(a: str, b: str, fields: list[str]) -> Column:
    """Field by field, nulls equal (FLT11)."""
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def any_common(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))  # FLT12


def contained(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0  # FLT12


def without_plural(mentions: DataFrame, tags: str = "tags") -> DataFrame:
    return mentions.where(~F.exists(tags, lambda t: t.isin("NNS", "NNPS")))  # FLT19


def negated_weights(verbs: DataFrame, deps: DataFrame) -> DataFrame:
    """Weights of governors of a ``neg`` times -0.5 (FLT20)."""
    neg = deps.where("type = 'neg'").select("doc_id", "sent_id", F.col("gov_idx").alias("idx"), F.lit(True).alias("_n")).distinct()
    j = verbs.join(neg, ["doc_id", "sent_id", "idx"], "left")
    return j.withColumn("weight", F.col("weight") * F.when(F.col("_n"), -0.5).otherwise(1.0)).drop("_n")


def picked_attributes(attrs: Column, ranks: list[tuple[int, float]], top: int) -> Column:
    """The best attributes by (index from 1, weight), weighted (FLT16)."""
    return F.array(*[F.element_at(attrs, i) * w for i, w in ranks[:top]])


def split_by_keys(df: DataFrame, key: str, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a key set (FLT17)."""
    t = test.select(key).distinct()
    return df.join(t, key, "left_anti"), df.join(t, key, "left_semi")


def constraint(words: list[str] = (), tags: list[str] = (), chunks: list[str] = (), roles: list[str] = (), exclude: Column | None = None, custom: Column | None = None) -> Column:
    """A word constraint over token columns (FLT13, FLT14); lists may use
    wildcards, empty lists allow all."""
    from fabula.functions.text import wildcard

    def one(column: str, patterns) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | (wildcard(F.lower(column), p.lower()) if "*" in p else F.lower(column) == p.lower())
        return F.coalesce(out, F.lit(False)) if patterns else F.lit(True)

    hit = one("token", words) & one("tag", tags) & one("chunk", chunks) & one("role", roles)
    hit = hit if custom is None else hit & custom
    return hit if exclude is None else hit & ~exclude


def index_range(df: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """Rows whose index lies in a range, both ends included (JN15)."""
    return df.where(F.col(column).between(first, last))


def all_values(df: DataFrame, by: list[str], collection: str, field: str) -> DataFrame:
    """A field of the members of child lists, each value once (FLT18)."""
    return df.select(*by, F.explode(F.col(collection)[field]).alias(field)).dropDuplicates()
