"""Bag-of-words operators. Term tables are long: (doc_id, term, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.text import words
from fabula.session import written


def term_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", stop: DataFrame | None = None, items: Column | None = None, least: int = 1, stemmer=None) -> DataFrame:
    """Counts of the terms of each document (BOW1). ``items`` replaces the
    word split, ``stemmer`` maps a term column, ``stop`` has a column term. The
    texts are dealt by key, not their terms, so that what is counted, summed or
    joined by key afterwards is in place."""
    terms = docs.repartition(key).select(F.col(key), F.explode(words(text) if items is None else items).alias("term"))
    if stemmer is not None:
        terms = terms.withColumn("term", stemmer(F.col("term")))
    counted = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    if stop is not None:  # a word list fits each task; the counts stay where they are
        counted = counted.join(F.broadcast(stop.select("term")), "term", "left_anti").select(key, "term", "n")
    return counted.where(F.col("n") >= least) if least > 1 else counted


def document_frequency(terms: DataFrame, n_docs: int | Column) -> DataFrame:
    """Number of documents of each term, and ln(N / df) (BOW3)."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(n / F.col("df")))


def term_frequency(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """n divided by the document's total (BOW2)."""
    total = terms.groupBy(key).agg(F.sum("n").alias("total"))
    return terms.join(total, key).withColumn("tf", F.col("n") / F.col("total")).drop("total")


def tf_idf(terms: DataFrame, n_docs: int, key: str = "doc_id") -> DataFrame:
    """tf * idf of each term of each document (BOW4)."""
    return (
        term_frequency(terms, key).join(document_frequency(terms, n_docs), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    )


def candidates(terms: DataFrame, frequency: DataFrame, n_docs: int, top: int, key: str = "doc_id", common: int = 200, digits: int = 9) -> DataFrame:
    """The terms that can be among the ``top`` of their document: key, term, n,
    total. Those in at least one document of ``common`` have their own idf, any
    other one has between ln(common) and ln(N). There are at most ``common``
    times as many common terms as a document has terms on average, whatever the
    number of documents, so they are broadcast. An array holds a document's terms."""
    known = frequency.where(F.col("df") * common >= n_docs).select("term", "idf")
    cells = terms.where(F.col(key).isNotNull()).join(F.broadcast(known), "term", "left")
    docs = cells.groupBy(key).agg(F.sum("n").alias("total"), F.collect_list(F.struct("term", "n", "idf")).alias("cells"))
    weight = lambda c, idf: c["n"] / F.col("total") * F.coalesce(c["idf"], F.log(F.lit(float(idf))))
    low = F.sort_array(F.transform("cells", lambda c: weight(c, common)), asc=False)
    docs = docs.withColumn("least", F.coalesce(F.get(low, F.lit(top - 1)) - 10.0**-digits, F.lit(-1.0)))  # ties after rounding stay
    kept = F.filter("cells", lambda c: weight(c, max(n_docs, 1)) >= F.col("least"))
    return docs.select(key, "total", F.explode(kept).alias("c")).select(key, "c.term", "c.n", "total")


def top_tf_idf(terms: DataFrame, n_docs: int, top: int, key: str = "doc_id", **options) -> DataFrame:
    """Rows of ``tf_idf`` that hold the ``top`` of each document; only those
    that can be among them meet the table of frequencies."""
    frequency = written(document_frequency(terms, n_docs), "frequency")
    met = candidates(terms, frequency, n_docs, top, key, **options).join(frequency, "term")
    return met.withColumn("tf", F.col("n") / F.col("total")).drop("total").withColumn("weight", F.col("tf") * F.col("idf"))


def keywords(weights: DataFrame, top: int = 10, key: str = "doc_id", digits: int = 9) -> DataFrame:
    """The heaviest terms of each document with their share (TOP4). Weights
    that agree to ``digits`` are ties, and go by the term."""
    by = Window.partitionBy(key).orderBy(F.round("weight", digits).desc(), "term")
    best = weights.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return best.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(key)))


def l2_normalised(weights: DataFrame, key: str = "doc_id", weight: str = "weight") -> DataFrame:
    norm = weights.groupBy(key).agg(F.sqrt(F.sum(F.col(weight) ** 2)).alias("norm"))
    return weights.join(norm, key).where("norm > 0").withColumn("w", F.col(weight) / F.col("norm")).select(key, "term", "w")


def sparse_dot(left: DataFrame, right: DataFrame, left_key: str, right_key: str, block: bool = False) -> DataFrame:
    """Similarity of all pairs that share a term (JN12): an equi-join on the
    term and a sum, so partial sums form before the pairs are shuffled. With
    ``block`` the left side is a block of queries, and the right one stays
    where it is."""
    r = right.select(F.col(right_key), F.col("term"), F.col("w").alias("w2"))
    q = left.select(left_key, "term", "w")
    return (F.broadcast(q) if block else q).join(r, "term").groupBy(left_key, right_key).agg(F.sum(F.col("w") * F.col("w2")).alias("similarity"))


def overlap_share(left: DataFrame, right: DataFrame, left_key: str, right_key: str, weight=lambda gram: F.lit(1.0), block: bool = False) -> DataFrame:
    """Which share of the left text's distinct n-grams (by weight) the right
    text has too (BOW10, JN11); column gram on both sides. With ``block`` the
    left side is a block of queries; then only n-grams that it has are made
    distinct and shuffled."""
    lg, r = left.select(left_key, "gram").distinct(), right.select(right_key, "gram")
    total = lg.groupBy(left_key).agg(F.sum(weight(F.col("gram"))).alias("total"))
    met = r.join(F.broadcast(lg), "gram").distinct() if block else lg.join(r.distinct(), "gram")
    hit = met.groupBy(left_key, right_key).agg(F.sum(weight(F.col("gram"))).alias("shared"))
    return hit.join(total, left_key).select(left_key, right_key, F.least(F.lit(1.0), F.col("shared") / F.col("total")).alias("share"))


def best_per(frame: DataFrame, key: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each key in a total order (TOP1-3)."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= top)


def density(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents, vocabulary and postings divided by vocabulary squared (BOW7)."""
    one = terms.agg(F.countDistinct(key).alias("n_docs"), F.countDistinct("term").alias("n_terms"), F.count(F.lit(1)).alias("postings"))
    return one.withColumn("density", F.col("postings") / (F.col("n_terms") * F.col("n_terms")))


def updated(terms: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Documents taken out, then others put in (BOW8); one that is put in again
    replaces what was there. Frequencies are counted from the result."""
    if removed is not None:
        terms = terms.join(removed.select(key), key, "left_anti")
    if added is not None:
        terms = terms.join(added.select(key).distinct(), key, "left_anti").unionByName(added)
    return terms
