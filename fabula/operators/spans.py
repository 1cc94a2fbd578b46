"""Sentences, tokens and other spans of documents, and the lookups between
them. Offsets count characters from 0; an end is offset + len."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.text import TOKEN, letter_count


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One sentence per line (SRC1): key, idx, offset, len, sentence. Offsets
    are running sums of the lengths of the lines before."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    s = docs.select(key, F.posexplode(lines).alias("idx", "sentence"))
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("len", F.length("sentence").cast("long"))
    return s.withColumn("offset", F.coalesce(F.sum(F.col("len") + 1).over(w), F.lit(0))).select(key, F.col("idx").cast("long").alias("idx"), "offset", "len", "sentence")


def tokens(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens of sentences with document offsets: key, idx (of the sentence),
    tok, offset, len, token. What lies between two tokens is split off, so a
    token's place is a running sum of lengths."""
    gaps = F.split(F.col("sentence"), TOKEN)
    marks = F.regexp_extract_all(F.col("sentence"), F.lit(TOKEN), F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(marks), F.lit(0))).alias("gap"), marks.alias("token"))
    t = sents.where(F.size(marks) > 0).select(key, "idx", F.col("offset").alias("_from"), F.posexplode(pairs).alias("tok", "p"))
    t = t.select(key, "idx", "_from", F.col("tok").cast("long").alias("tok"), F.length("p.gap").alias("g"), F.length("p.token").cast("long").alias("len"), F.col("p.token").alias("token"))
    w = Window.partitionBy(key, "idx").orderBy("tok").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("offset", F.col("_from") + F.sum(F.col("g") + F.col("len")).over(w) - F.col("len")).select(key, "idx", "tok", "offset", "len", "token")


def at_or_before(probes: DataFrame, spans: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Backward as-of (SPN1): the last span that starts at or before the probe;
    before the first span, the first. Union and window, no range join."""
    p = probes.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(spans.schema[value].dataType).alias("_v"))
    s = spans.select(key, F.col("offset").alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_at", "_kind")
    last = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return p.union(s).withColumn("_hit", F.coalesce(last, first)).where("_kind = 1").select(key, F.col("_at").alias(at), F.col("_hit").alias(value))


def at_or_after(probes: DataFrame, spans: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Forward as-of (SPN2): the first span that starts at or after the probe."""
    p = probes.select(key, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(spans.schema[value].dataType).alias("_v"))
    s = spans.select(key, F.col("offset").alias("_at"), F.lit(1).alias("_kind"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing)
    return p.union(s).withColumn("_hit", F.first("_v", ignorenulls=True).over(w)).where("_kind = 0").select(key, F.col("_at").alias(at), F.col("_hit").alias(value))


def binned(df: DataFrame, start: Column, end: Column, width: int, name: str = "_bin") -> DataFrame:
    """A row for each bin of ``width`` characters that a span touches; makes an
    interval join an equi-join however long the document is."""
    lo, hi = F.floor(start / width), F.floor(F.greatest(start, end - 1) / width)
    return df.withColumn(name, F.explode(F.sequence(lo, hi)))


def tokens_in_range(ranges: DataFrame, toks: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """Tokens that start in [start, end), and the first one after them, however
    far it is (SPN3). Each token carries its follower, so the join needs the
    bins of the range alone."""
    follower = F.lead(F.struct(*toks.columns)).over(Window.partitionBy(key).orderBy("offset"))
    t = toks.withColumn("_next", follower).withColumn("_bin", F.floor(F.col("offset") / width))
    r = binned(ranges, F.col("start"), F.col("end"), width)
    hit = r.join(t, [key, "_bin"]).where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")))
    names = [*ranges.columns, *(c for c in toks.columns if c != key)]
    after = hit.where(F.col("_next.offset") >= F.col("end")).select(*ranges.columns, *(F.col("_next")[c].alias(c) for c in toks.columns if c != key))
    return hit.select(names).unionByName(after)


def best_overlap(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, width: int = 1000) -> DataFrame:
    """For each left span the right span with the largest overlap, the smallest
    id of equals (SPN11)."""
    a = binned(left.select(key, left_id, F.col("offset").alias("a0"), (F.col("offset") + F.col("len")).alias("a1")), F.col("a0"), F.col("a1"), width)
    b = binned(right.select(key, right_id, F.col("offset").alias("b0"), (F.col("offset") + F.col("len")).alias("b1")), F.col("b0"), F.col("b1"), width)
    o = F.least("a1", "b1") - F.greatest("a0", "b0")
    pairs = a.join(b, [key, "_bin"]).select(key, left_id, right_id, o.alias("overlap")).where("overlap > 0")
    return pairs.groupBy(key, left_id).agg(F.max("overlap").alias("overlap"), F.min_by(right_id, F.struct(-F.col("overlap"), F.col(right_id))).alias(right_id))


def parents(spans: DataFrame, key: str, span: str, width: int = 1000) -> DataFrame:
    """Each span's smallest container, if any (WIN13, SPN6): equal spans hold
    each other by id."""
    s = spans.select(key, span, F.col("offset").alias("s0"), (F.col("offset") + F.col("len")).alias("s1"))
    inner = s.withColumn("_bin", F.floor(F.col("s0") / width))
    outer = binned(s.select(key, F.col(span).alias("parent"), F.col("s0").alias("p0"), F.col("s1").alias("p1")), F.col("p0"), F.col("p1"), width)
    holds = (F.col("p0") <= F.col("s0")) & (F.col("p1") >= F.col("s1")) & (F.col("parent") != F.col(span))
    proper = holds & ((F.col("p0") < F.col("s0")) | (F.col("p1") > F.col("s1")) | (F.col("parent") < F.col(span)))
    best = inner.join(outer, [key, "_bin"]).where(proper).groupBy(key, span).agg(F.min_by("parent", F.struct(F.col("p1") - F.col("p0"), -F.col("parent"))).alias("parent"))
    return spans.join(best, [key, span], "left")


def align_by_letters(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str, left_text: str, right_text: str) -> DataFrame:
    """Aligns two segmentations of one text by running letter counts (SPN13-15):
    a right segment belongs to the left one in which it begins. Counts are
    window sums; the lookup is the as-of of SPN1."""
    before = lambda o: Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    a = left.withColumn("offset", F.coalesce(F.sum(letter_count(F.col(left_text))).over(before(left_order)), F.lit(0)))
    b = right.withColumn("at", F.coalesce(F.sum(letter_count(F.col(right_text))).over(before(right_order)), F.lit(0)))
    starts = a.where(letter_count(F.col(left_text)) > 0)
    hit = at_or_before(b.select(key, "at").distinct(), starts, key, "at", left_order)
    return b.join(hit.select(key, "at", F.col(left_order).alias("aligned")), [key, "at"], "left")


def without_overlaps(spans: DataFrame, key: str) -> DataFrame:
    """First span wins, later ones that start before its end go (WIN14). The
    sweep is sequential within a document."""
    import pandas as pd

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["offset", "len"], kind="stable")
        keep, end = [], -1
        for o, n in zip(pdf["offset"], pdf["len"]):
            keep.append(o >= end)
            end = o + n if o >= end else end
        return pdf[keep]

    return spans.groupBy(key).applyInPandas(sweep, spans.schema)


def quoted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Text between double quotes, in order, and the text with ``QUOTE`` in its
    place (SRC2)."""
    return docs.select(
        key, F.regexp_extract_all(F.col(text), F.lit('"([^"]*)"'), F.lit(1)).alias("quotes"), F.regexp_replace(text, '"[^"]*"', "QUOTE").alias("plain")
    )
