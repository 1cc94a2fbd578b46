"""Quality rules with a verdict by host, in Spark's own functions.

Every document is measured and judged by itself; failures are summed by host,
each host's rate of failures is shrunk towards the corpus by a beta prior that
is fitted to the hosts (method of moments), and hosts whose shrunk rate is too
high lose all of their documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.session import written

#: The white space that parts words, and the symbols counted.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_list(text: Column) -> Column:
    """The runs of characters other than SPACES, in order."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), "")


def chars_without(text: Column, dropped: str) -> Column:
    return F.char_length(F.translate(text, dropped, ""))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    return F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1)


def neighbours(words: Column, join) -> Column:
    """One value for each window of WINDOW words, by ``join`` of its words."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: join(i, w, *[F.get(words, i + k) for k in range(1, WINDOW)]))


def covered_words(words: Column) -> Column:
    """How many words lie in windows that occur twice or more. The windows are
    sorted as text, so equal ones are neighbours; the work is n log n."""
    windows = F.sort_array(neighbours(words, lambda i, *w: F.struct(F.concat_ws(" ", *w).alias("w"), i.alias("i"))))

    def starts(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    found = F.element_at(F.transform(F.array(windows), starts), 1)
    return F.element_at(F.transform(F.array(found), covered), 1)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` packed into the struct ``row``, with MEASURES (long) and
    base_failed. Windows are told apart by a hash first: where all hashes of a
    text differ, so do the windows; the others are compared as text."""
    t = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("words", word_list(t))
    two = one.withColumn("marks", neighbours(F.col("words"), lambda i, *w: F.xxhash64(*w)))
    repeated = F.when(F.size(F.array_distinct("marks")) == F.size("marks"), 0).otherwise(covered_words(F.col("words")))
    three = two.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        chars_without(t, SPACES).cast("long").alias("word_chars"),
        (F.char_length(t) - chars_without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(t).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return three.withColumn("base_failed", failed)


@dataclass
class Prior:
    """Beta prior of the hosts' rates: its mean, and its weight in documents
    (null: so heavy that all hosts have the mean)."""

    mean: float
    weight: float | None

    def rate(self, failed: Column, n: Column) -> Column:
        if self.weight is None:
            return F.lit(self.mean)
        return (failed + F.lit(self.mean * self.weight)) / (n + F.lit(self.weight))


def fitted_prior(hosts: DataFrame) -> Prior:
    """The prior by moments of (host, n, failed): the spread of rates beyond
    what chance gives is the intra-host correlation rho, and the weight is
    (1 - rho) / rho. One row leaves Spark. Without hosts, with one host, or
    where all rates are 0 or 1 or spread no more than chance, the weight is
    null."""
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("ff")).first()
    if not total["n"]:
        return Prior(0.0, None)
    n, k = float(total["n"]), total["k"]
    mean = total["failed"] / n
    chance = mean * (1 - mean)
    between = total["ff"] - n * mean * mean
    room = (n - total["nn"] / n - (k - 1)) * chance
    rho = (between - (k - 1) * chance) / room if room > 0 else 0.0
    return Prior(mean, None if rho <= 0 else (1 - min(rho, 1.0)) / min(rho, 1.0))


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def judge(docs: DataFrame, *, text: str = "text", host: str | Column = "source", max_rate: float = MAX_HOST_RATE, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with MEASURES, base_failed,
    host_rate (its host's shrunk rate of failures) and kept.

    ``host``: a column, or an expression over the columns of ``docs`` such as
    ``host_of(F.col("url"))``. ``carry``: the columns that ``row`` holds, if not
    all; the text is not written again if it isn't among them. A null text has no words and fails. A null host
    is no host: its rows have no rate and are judged by themselves. Repeated
    rows count each time; an empty table gives an empty result; other columns
    may have any name, they travel inside ``row``. A text of any length counts
    whole. Measures are written once, then summed before they are shuffled; the
    join back is a sort-merge join whose hot hosts Spark splits, or a broadcast
    where Spark finds the hosts' table below its threshold.
    """
    host = F.col(host) if isinstance(host, str) else host
    names = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    packed = docs.select(F.struct(*names).alias("_doc"), host.cast("string").alias("_host"), F.col(text).alias("_text"))
    judged = written(measures(packed, "_text").select(F.col("row._doc").alias("row"), F.col("row._host").alias("host"), *MEASURES, "base_failed"), "measures")
    hosts = written(judged.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    rates = hosts.select(F.col("host").alias("_rated"), fitted_prior(hosts).rate(F.col("failed"), F.col("n")).alias("host_rate"))
    both = judged.join(rates, F.col("host") == F.col("_rated"), "left").drop("_rated")
    return both.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_rate))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and the verdicts of the registered query."""
    return judge(docs, carry=["doc_id"]).select("row.doc_id", *MEASURES, "base_failed", "kept")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
g AS (SELECT p.rid, p.i, array_to_string(w.ws[p.i : p.i + {WINDOW - 1}], ' ') AS g FROM p JOIN w USING (rid)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS place FROM r) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN u USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(n) AS n, sum(f) / sum(n) AS mean, count(*) AS k, sum(n * n) AS nn, sum(f * f / n) AS ff FROM h),
v AS (SELECT mean, CASE WHEN (n - nn / n - (k - 1)) * mean * (1 - mean) > 0
        THEN (ff - n * mean * mean - (k - 1) * mean * (1 - mean)) / ((n - nn / n - (k - 1)) * mean * (1 - mean)) ELSE 0 END AS rho FROM s),
x AS (SELECT source, CASE WHEN rho <= 0 THEN mean ELSE (f + mean * (1 - least(rho, 1)) / least(rho, 1)) / (n + (1 - least(rho, 1)) / least(rho, 1)) END AS rate FROM h, v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= {MAX_HOST_RATE} AS kept
FROM b LEFT JOIN x ON b.source = x.source
"""
