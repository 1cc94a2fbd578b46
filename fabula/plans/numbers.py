"""Queries of the statistics and evaluation groups over the star schema,
events, labels and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.operators import evaluate, stats
from fabula.plans.registry import query
from fabula.plans.words import WORDS
from fabula.functions import text as T
from fabula.session import table


def rounded(df, digits=6, *columns):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@query(
    "price_boxplot",
    """SELECT l_returnflag, round(min(l_extendedprice), 6) AS low, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 6) AS median,
    round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.75), 6) AS q3, round(max(l_extendedprice), 6) AS high FROM lineitem GROUP BY 1""",
)
def price_boxplot(spark, sf_dir):
    return rounded(stats.boxplot(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice"), 6, "low", "q1", "median", "q3", "high")


@query(
    "qty_histogram",
    """WITH e AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 7 + 1e-6 AS width FROM lineitem)
    SELECT CAST(floor((l_quantity - lo) / width) AS BIGINT) AS bin, count(*) AS n, CAST(min(l_quantity) AS DOUBLE) AS least, CAST(max(l_quantity) AS DOUBLE) AS most FROM lineitem, e GROUP BY 1""",
)
def qty_histogram(spark, sf_dir):
    h = stats.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 7)
    return h.withColumns({c: F.col(c).cast("double") for c in ("least", "most")})


@query(
    "value_moving_avg",
    """SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS average FROM events""",
)
def value_moving_avg(spark, sf_dir):
    e = stats.centred_average(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 2)
    return e.select("event_id", "user_id", F.round("average", 6).alias("average"))


@query(
    "running_total",
    "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events",
)
def running_total(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.sum("value").over(w), 4).alias("total"))


CHI = """WITH seen AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) AS rt FROM seen GROUP BY 1),
c AS (SELECT b, sum(n) AS ct FROM seen GROUP BY 1), g AS (SELECT a, b, coalesce(n, 0) AS o, rt * ct / (SELECT sum(n) FROM seen) AS e FROM r CROSS JOIN c LEFT JOIN seen USING (a, b))"""


@query(
    "chi2_flag_status",
    CHI + " SELECT round(sum((o - e) * (o - e) / e), 4) AS x2, round(2 * sum(CASE WHEN o > 0 THEN o * ln(o / e) ELSE 0 END), 4) AS g, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS df FROM g",
)
def chi2_flag_status(spark, sf_dir):
    return rounded(stats.chi_squared(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"), 4, "x2", "g")


@query("expected_flag_status", CHI + " SELECT a AS l_returnflag, b AS l_linestatus, CAST(o AS BIGINT) AS observed, round(CAST(e AS DOUBLE), 6) AS expected FROM g")
def expected_flag_status(spark, sf_dir):
    t = stats.expected_table(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return t.select("l_returnflag", "l_linestatus", "observed", F.round("expected", 6).alias("expected"))


@query(
    "fisher_quality_toxic",
    """WITH t AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d
      FROM documents JOIN labels USING (doc_id) GROUP BY lang),
    x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM t),
    p AS (SELECT *, lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) - lgamma(k+1) - lgamma(a+b-k+1) - lgamma(a+c-k+1) - lgamma(d-a+k+1) AS lp FROM x),
    o AS (SELECT *, max(lp) FILTER (k = a) OVER (PARTITION BY lang) AS own FROM p)
    SELECT lang, a, b, c, d, round(least(1.0, sum(CASE WHEN lp <= own + 1e-9 THEN exp(lp) ELSE 0 END)), 6) AS p FROM o GROUP BY ALL""",
)
def fisher_quality_toxic(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    cell = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    t = d.groupBy("lang").agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    return t.withColumn("p", F.round(stats.fisher_exact(*[F.col(c) for c in "abcd"]), 6))


@query(
    "ks_quantity",
    """WITH n AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
    r AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM n WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))
    SELECT round(max(abs(ca / (SELECT sum(a) FROM n) - cb / (SELECT sum(b) FROM n))), 9) AS distance, CAST((SELECT sum(a) FROM n) AS BIGINT) AS n1, CAST((SELECT sum(b) FROM n) AS BIGINT) AS n2 FROM r""",
)
def ks_quantity(spark, sf_dir):
    return rounded(stats.ks_distance(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "A", "R"), 9, "distance")


@query(
    "welch_price",
    """WITH s AS (SELECT avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, count(*) FILTER (l_returnflag = 'A') AS n1,
      avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2, count(*) FILTER (l_returnflag = 'R') AS n2 FROM lineitem)
    SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 3) AS df FROM s""",
)
def welch_price(spark, sf_dir):
    t = stats.welch(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "A", "R")
    return t.select(F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@query(
    "value_moments",
    """WITH m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY 1), d AS (SELECT event_type, mu, value - mu AS x FROM events JOIN m USING (event_type))
    SELECT event_type, round(any_value(mu), 6) AS mean, round(avg(x * x), 4) AS variance, round(avg(x * x * x) / pow(avg(x * x), 1.5), 5) AS skewness, round(avg(x * x * x * x) / pow(avg(x * x), 2) - 3, 5) AS kurtosis FROM d GROUP BY 1""",
)
def value_moments(spark, sf_dir):
    m = stats.moments(table(spark, sf_dir, "events"), ["event_type"], "value")
    return m.select("event_type", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"))


@query(
    "describe_lengths",
    """WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
    m AS (SELECT source, n_chars AS mode FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, n_chars) AS k FROM documents GROUP BY 1, 2) WHERE k = 1)
    SELECT source, any_value(n) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS deviation, min(n_chars) AS low, max(n_chars) AS high,
      max(n_chars) FILTER (r = n // 2 + 1) AS upper_median, any_value(mode) AS mode FROM r JOIN m USING (source) GROUP BY source""",
)
def describe_lengths(spark, sf_dir):
    return rounded(stats.describe(table(spark, sf_dir, "documents"), ["source"], "n_chars"), 6, "mean", "deviation")


@query(
    "entropy_by_source",
    """WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS t FROM n)
    SELECT source, round(-sum(n / t * log2(n / t)), 9) + 0.0 AS entropy FROM t GROUP BY 1""",
)
def entropy_by_source(spark, sf_dir):
    e = stats.entropy(table(spark, sf_dir, "documents"), ["source"], "lang")
    return e.select("source", (F.round("entropy", 9) + F.lit(0.0)).alias("entropy"))


@query(
    "auc_by_length",
    """WITH n AS (SELECT n_chars AS s, sum(quality) AS p, sum(1 - quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT p, q, sum(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp FROM n)
    SELECT round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 9) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives FROM r""",
)
def auc_by_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(evaluate.auc(d, "n_chars", F.col("quality") == 1), 9, "auc")


GUESS = "SELECT doc_id, quality AS gold, CASE WHEN n_chars >= 1500 AND toxic = 0 THEN 1 ELSE 0 END AS guess FROM documents JOIN labels USING (doc_id)"


def guesses(spark, sf_dir):
    """A plain rule to be scored: long and not toxic."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("gold"), F.when((F.col("n_chars") >= 1500) & (F.col("toxic") == 0), 1).otherwise(0).alias("guess"))


@query("confusion_quality", f"WITH g AS ({GUESS}) SELECT gold, guess, count(*) AS n FROM g GROUP BY 1, 2")
def confusion_quality(spark, sf_dir):
    return evaluate.confusion(guesses(spark, sf_dir), "gold", "guess")


PRF = f"""WITH g AS ({GUESS}), l AS (SELECT unnest([0, 1]) AS label), t AS (SELECT label, count(*) FILTER (gold = label AND guess = label) AS tp, count(*) FILTER (gold <> label AND guess = label) AS fp,
  count(*) FILTER (gold = label AND guess <> label) AS fn, count(*) AS total FROM l CROSS JOIN g GROUP BY label),
s AS (SELECT *, total - tp - fp - fn AS tn, tp / CASE WHEN tp + fp = 0 THEN 1 ELSE tp + fp END AS precision, tp / CASE WHEN tp + fn = 0 THEN 1 ELSE tp + fn END AS recall FROM t),
f AS (SELECT *, 2 * precision * recall / CASE WHEN precision + recall = 0 THEN 1 ELSE precision + recall END AS f1, tn / CASE WHEN tn + fp = 0 THEN 1 ELSE tn + fp END AS specificity FROM s)"""


@query(
    "label_scores",
    PRF + " SELECT label, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(specificity, 9) AS specificity FROM f",
)
def label_scores(spark, sf_dir):
    s = evaluate.one_vs_all(guesses(spark, sf_dir), "gold", "guess")
    return rounded(s, 9, "precision", "recall", "f1", "specificity").select("label", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "specificity")


@query(
    "weighted_scores",
    PRF + """ SELECT round(sum(precision * (tp + fn)) / sum(tp + fn), 9) AS weighted_precision, round(sum(recall * (tp + fn)) / sum(tp + fn), 9) AS weighted_recall,
    round(sum(f1 * (tp + fn)) / sum(tp + fn), 9) AS weighted_f1, round(avg(f1), 9) AS macro_f1, round(sum(tp) / max(total), 9) AS accuracy FROM f""",
)
def weighted_scores(spark, sf_dir):
    w = evaluate.weighted_scores(evaluate.one_vs_all(guesses(spark, sf_dir), "gold", "guess"))
    return rounded(w, 9, *w.columns)


@query(
    "kappa_votes",
    """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, sum(n) AS k, sum(n * (n - 1)) AS agree FROM n GROUP BY 1 HAVING sum(n) > 1),
    o AS (SELECT avg(agree / (k * (k - 1))) AS observed FROM p), s AS (SELECT event_type, sum(n) AS n FROM n WHERE user_id IN (SELECT user_id FROM p) GROUP BY 1),
    c AS (SELECT sum(pow(n / (SELECT sum(n) FROM s), 2)) AS chance FROM s) SELECT round(observed, 9) AS observed, round(chance, 9) AS chance, round((observed - chance) / (1 - chance), 9) AS kappa FROM o, c""",
)
def kappa_votes(spark, sf_dir):
    return rounded(evaluate.fleiss_kappa(table(spark, sf_dir, "events"), "user_id", "event_type"), 9, "observed", "chance", "kappa")


@query(
    "vote_by_group",
    """SELECT source, lang, count(*) AS votes FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) = 1""",
)
def vote_by_group(spark, sf_dir):
    return evaluate.vote_by_group(table(spark, sf_dir, "documents"), "source", "lang")


@query(
    "purity_scores",
    """WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT max(n) AS b, sum(n) AS s, count(*) AS k FROM n GROUP BY source), g AS (SELECT max(n) AS b, sum(n) AS s, count(*) AS k FROM n GROUP BY lang)
    SELECT round((SELECT sum(b) / sum(s) FROM p), 9) AS precision, round((SELECT avg(k) FROM p), 9) AS gold_per_group, round((SELECT sum(b) / sum(s) FROM g), 9) AS recall, round((SELECT avg(k) FROM g), 9) AS groups_per_gold""",
)
def purity_scores(spark, sf_dir):
    s = evaluate.purity(table(spark, sf_dir, "documents"), "lang", "source")
    return rounded(s, 9, *s.columns)


@query(
    "pairwise_scores",
    """WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), b AS (SELECT sum(n * (n - 1)) AS b, sum(n) AS m FROM n), p AS (SELECT sum(k * (k - 1)) AS p FROM (SELECT sum(n) AS k FROM n GROUP BY source)),
    g AS (SELECT sum(k * (k - 1)) AS g FROM (SELECT sum(n) AS k FROM n GROUP BY lang)) SELECT CAST(b AS BIGINT) AS both, CAST(m AS BIGINT) AS members, CAST(p AS BIGINT) AS predicted_pairs, CAST(g AS BIGINT) AS gold_pairs,
    round(b / p, 9) AS precision, round(b / g, 9) AS recall, round(2 * (b / p) * (b / g) / (b / p + b / g), 9) AS f1 FROM b, p, g""",
)
def pairwise_scores(spark, sf_dir):
    return rounded(evaluate.pair_counts(table(spark, sf_dir, "documents"), "lang", "source"), 9, "precision", "recall", "f1")


@query(
    "infogain_terms",
    f"""WITH t AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS term FROM documents JOIN labels USING (doc_id)), y AS (SELECT doc_id, max(quality) AS quality FROM labels SEMI JOIN documents USING (doc_id) GROUP BY 1),
    tot AS (SELECT count(*) AS n, sum(quality) AS p FROM y), c AS (SELECT term, count(*) AS n1, sum(quality) AS p1 FROM t JOIN y USING (doc_id) GROUP BY 1 HAVING count(*) >= 5),
    h AS (SELECT term, n1, p1 / n1 AS a, (p - p1) / (n - n1) AS b, n1 / n AS w, p / n AS r FROM c, tot WHERE n1 < n)
    SELECT term, n1 AS df, round((CASE WHEN r IN (0, 1) THEN 0 ELSE -r * log2(r) - (1 - r) * log2(1 - r) END) - w * (CASE WHEN a IN (0, 1) THEN 0 ELSE -a * log2(a) - (1 - a) * log2(1 - a) END)
      - (1 - w) * (CASE WHEN b IN (0, 1) THEN 0 ELSE -b * log2(b) - (1 - b) * log2(1 - b) END), 8) + 0.0 AS gain FROM h""",
)
def infogain_terms(spark, sf_dir):
    """Gain of a term's presence about the quality label (AGG44-46), for terms
    of five documents at least; absences come from totals, not from rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    y = labels.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    t = docs.join(y, "doc_id").select("doc_id", "quality", F.explode(F.array_distinct(T.words("text"))).alias("term"))
    c = t.groupBy("term").agg(F.count(F.lit(1)).alias("n1"), F.sum("quality").alias("p1")).where("n1 >= 5")
    c = c.crossJoin(F.broadcast(y.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("p")))).where("n1 < n")  # one row
    h = lambda r: F.when(r.isin(0.0, 1.0), 0.0).otherwise(-r * F.log2(r) - (1 - r) * F.log2(1 - r))
    w = F.col("n1") / F.col("n")
    gain = h(F.col("p") / F.col("n")) - w * h(F.col("p1") / F.col("n1")) - (1 - w) * h((F.col("p") - F.col("p1")) / (F.col("n") - F.col("n1")))
    return c.select("term", F.col("n1").alias("df"), (F.round(gain, 8) + F.lit(0.0)).alias("gain"))


@query(
    "class_baseline",
    """WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS t FROM n)
    SELECT quality, n, round(n / t, 9) AS share, n = (SELECT max(n) FROM n) AS majority, n = (SELECT min(n) FROM n) AS minority FROM n, t""",
)
def class_baseline(spark, sf_dir):
    n = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    e = n.agg(F.sum("n").alias("t"), F.max("n").alias("most"), F.min("n").alias("least"))
    x = n.crossJoin(F.broadcast(e))  # one row
    return x.select("quality", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"), (F.col("n") == F.col("most")).alias("majority"), (F.col("n") == F.col("least")).alias("minority"))


@query(
    "part_pairs",
    """WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM o)
    SELECT a.l_suppkey AS first, b.l_suppkey AS second, count(*) AS support, round(count(*) / any_value(n), 9) AS share FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey, n
    GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def part_pairs(spark, sf_dir):
    """Frequent sets of two suppliers in an order (CLU4)."""
    o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    n = o.agg(F.countDistinct("l_orderkey").alias("n"))
    pairs = o.withColumnRenamed("l_suppkey", "first").join(o.withColumnRenamed("l_suppkey", "second"), "l_orderkey").where("first < second")
    c = pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("support")).where("support >= 3").crossJoin(F.broadcast(n))  # one row
    return c.select("first", "second", "support", F.round(F.col("support") / F.col("n"), 9).alias("share"))


@query(
    "value_folds",
    "SELECT event_id, CAST(ntile(5) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS fold, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS chunk FROM events",
)
def value_folds(spark, sf_dir):
    """Five near-equal folds and chunks of 100, within each event type."""
    w = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.ntile(5).over(w).cast("long").alias("fold"), F.floor((F.row_number().over(w) - 1) / 100).cast("long").alias("chunk"))


@query(
    "taxonomy_closure",
    """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
    t AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT t.child, e.parent, t.depth + 1 FROM t JOIN e ON t.ancestor = e.child)
    SELECT child, ancestor, CAST(depth AS INT) AS depth FROM t""",
)
def taxonomy_closure(spark, sf_dir):
    from fabula.operators.hierarchy import ancestors

    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return ancestors(n.union(c))


@query(
    "quality_counts",
    """SELECT 'lineitem without order' AS check, count(*) AS n FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'order without customer', count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'label without document', count(*) FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT 'document without label', count(*) FROM documents ANTI JOIN labels USING (doc_id)
    UNION ALL SELECT 'repeated text', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM documents GROUP BY text)""",
)
def quality_counts(spark, sf_dir):
    """Named error counts from anti joins (AGG21, JN10)."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "labels", "documents")}
    count = lambda name, df: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    parts = [
        count("lineitem without order", t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        count("order without customer", t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        count("label without document", t["labels"].join(t["documents"], "doc_id", "left_anti")),
        count("document without label", t["documents"].join(t["labels"], "doc_id", "left_anti")),
        t["documents"].groupBy("text").count().agg(F.lit("repeated text").alias("check"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    "phase_stats",
    """WITH t AS (SELECT conv_id, role, turn % 4 AS phase, length(text) AS n FROM conversations) SELECT conv_id, phase, count(*) AS turns, count(DISTINCT role) AS roles, CAST(sum(n) AS BIGINT) AS chars
    FROM t GROUP BY GROUPING SETS ((conv_id, phase), (conv_id))""",
)
def phase_stats(spark, sf_dir):
    """Statistics by phase and for the whole conversation (AGG20)."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", (F.col("turn") % 4).alias("phase"), F.length("text").alias("n"))
    g = t.groupingSets([["conv_id", "phase"], ["conv_id"]], "conv_id", "phase")
    return g.agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("roles"), F.sum("n").alias("chars"))


@query(
    "elapsed_minutes",
    "SELECT user_id, round(date_diff('second', min(ts), max(ts)) / 60.0, 6) AS minutes, count(*) AS n FROM events GROUP BY 1",
)
def elapsed_minutes(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.round((F.unix_timestamp("b") - F.unix_timestamp("a")) / 60.0, 6).alias("minutes"), "n")
