"""Queries of classifiers, clusters and searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators import agglomerate, bow, classify, cluster, semantics, trees
from fabula.plans.registry import query
from fabula.plans.words import TERMS, WORDS
from fabula.session import table, written

NEAR = """q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS b FROM embeddings),
n AS (SELECT query, vec_id, label, round(list_cosine_similarity(a, b), 6) AS similarity FROM q JOIN r ON query <> vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM n QUALIFY rank <= 5)"""


def neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return classify.nearest(e, e.where("vec_id % 20 = 0"), 5, other=["label"])


@query("knn_embeddings", f"WITH {NEAR} SELECT query, vec_id, similarity, CAST(rank AS INT) AS rank FROM k")
def knn_embeddings(spark, sf_dir):
    """Every twentieth vector as a query against all rows, exact."""
    return neighbours(spark, sf_dir).select("query", "vec_id", "similarity", "rank")


@query(
    "knn_label",
    f"""WITH {NEAR}, s AS (SELECT query, label, round(sum(similarity), 9) AS weight FROM k WHERE similarity > 0 GROUP BY 1, 2)
    SELECT query, label, weight FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY weight DESC, label) = 1""",
)
def knn_label(spark, sf_dir):
    return classify.knn_label(neighbours(spark, sf_dir))


@query(
    "nb_quality",
    f"""WITH {TERMS}, tr AS (SELECT doc_id, quality AS label FROM labels WHERE doc_id % 5 <> 0), te AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id % 5 = 0),
    c AS (SELECT label, term, sum(n) AS c FROM terms JOIN tr USING (doc_id) GROUP BY 1, 2), k AS (SELECT label, sum(c) AS total FROM c GROUP BY 1), p AS (SELECT label, ln(count(*) / (SELECT count(*) FROM tr)) AS lp FROM tr GROUP BY 1),
    d AS (SELECT doc_id, sum(n) AS size FROM terms SEMI JOIN te USING (doc_id) GROUP BY 1), g AS (SELECT doc_id, label, sum(n * (ln(c) - ln(0.0001))) AS gain FROM terms SEMI JOIN te USING (doc_id) JOIN c USING (term) GROUP BY 1, 2),
    s AS (SELECT doc_id, label, lp + size * (ln(0.0001) - ln(total)) + coalesce(gain, 0) AS score FROM d CROSS JOIN k JOIN p USING (label) LEFT JOIN g USING (doc_id, label))
    SELECT doc_id, label, round(score, 3) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, label) = 1""",
)
def nb_quality(spark, sf_dir):
    """Naive Bayes: four fifths of the labels train, the others are read."""
    terms = bow.term_counts(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    test = terms.join(labels.where("doc_id % 5 = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    s = classify.naive_bayes(terms, labels.where("doc_id % 5 <> 0"), test)
    return classify.best_class(s).withColumn("score", F.round("score", 3))


@query(
    "centroid_distances",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2)
    SELECT vec_id, round(1 - sum(least(abs(x), abs(m))) / sum(greatest(abs(x), abs(m))), 6) AS jaccard, round(sum((x - m) * (x - m)), 6) AS euclidean, round(sum(abs(x - m)), 6) AS manhattan, round(max(abs(x - m)), 6) AS chebyshev,
      round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine FROM e JOIN c USING (label, i) GROUP BY 1""",
)
def centroid_distances(spark, sf_dir):
    """Distances of each vector to its label's centroid (CLS1, CLS4, CLS5)."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    m = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))  # a vector's entries
    j = e.join(m, "label")
    mod = lambda c: F.transform(c, lambda x: F.abs(x))
    out = {"jaccard": classify.weighted_jaccard(mod(F.col("v")), mod(F.col("c")))}
    out |= {k: classify.distance(F.col("v"), F.col("c"), k) for k in ("euclidean", "manhattan", "chebyshev", "cosine")}
    return j.select("vec_id", *[F.round(c, 6).alias(n) for n, c in out.items()])


@query("nb_cross_validation")
def nb_cross_validation(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    return classify.cross_validate(bow.term_counts(docs), labels, 3)


@query("embedding_clusters")
def embedding_clusters(spark, sf_dir):
    return cluster.k_means(table(spark, sf_dir, "embeddings"), "embedding", 8).select("vec_id", "cluster")


@query("embedding_hierarchy")
def embedding_hierarchy(spark, sf_dir):
    return cluster.hierarchical(table(spark, sf_dir, "embeddings"), "embedding", 8).select("vec_id", "cluster")


@query("latent_vectors")
def latent_vectors(spark, sf_dir):
    return cluster.latent(table(spark, sf_dir, "embeddings"), "embedding", 4).select("vec_id", "latent")


@query(
    "frequent_quantity_sets",
    """WITH o AS (SELECT DISTINCT l_orderkey AS k, 'q' || CAST(floor(l_quantity / 10) AS INT) AS m FROM lineitem), n AS (SELECT count(DISTINCT k) AS n FROM o),
    m AS (SELECT k, bit_or(1 << CAST(m[2:] AS INT)) AS held FROM o GROUP BY k), s AS (SELECT CAST(unnest(range(1, 64)) AS INT) AS part)
    SELECT array_to_string(list_transform(list_filter(range(6), lambda i: (part >> CAST(i AS INT)) & 1 = 1), lambda i: 'q' || i), ',') AS bands, count(*) AS n
    FROM m JOIN s ON (held & part) = part, n GROUP BY part HAVING count(*) >= any_value(n.n) * 0.05""",
)
def frequent_quantity_sets(spark, sf_dir):
    """Frequent sets of quantity bands in an order (CLU4)."""
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("q"), F.floor(F.col("l_quantity") / 10).cast("int"))).alias("items"))  # six bands at most
    s = cluster.frequent_sets(b, "items", 0.05)
    return s.select(F.array_join(F.array_sort("items"), ",").alias("bands"), F.col("freq").alias("n"))


@query("svm_predictions")
def svm_predictions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    model = cluster.linear_svm(e.where("vec_id % 5 <> 0"), "embedding", "label", 10)
    return model.transform(cluster.vectors(e, "embedding")).select("vec_id", "label", F.col("predicted").cast("int").alias("predicted"))


@query("tree_predictions")
def tree_predictions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    model = cluster.decision_tree(e.where("vec_id % 5 <> 0"), "embedding", "label")
    return model.transform(cluster.vectors(e, "embedding")).select("vec_id", "label", F.col("predicted").cast("int").alias("predicted"))


@query("condensed_prototypes")
def condensed_prototypes(spark, sf_dir):
    return classify.condensed(table(spark, sf_dir, "embeddings")).select("vec_id", "label")


@query("perceptron_predictions")
def perceptron_predictions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    names, w = classify.perceptron(e.where("vec_id % 5 <> 0"))

    @F.pandas_udf("int")
    def guess(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), np.float64)
        return pd.Series(np.array(names)[(np.hstack([x, np.ones((len(x), 1))]) @ w.T).argmax(1)])

    return e.select("vec_id", "label", guess("embedding").alias("predicted"))


@query(
    "gain_tree_quality",
    f"""WITH y AS (SELECT doc_id, max(quality)::VARCHAR AS y FROM labels SEMI JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1), t AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS term FROM documents),
    s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (y = '1')::DOUBLE AS p FROM y), c AS (SELECT term, count(*)::DOUBLE AS n1, count(*) FILTER (y = '1')::DOUBLE AS p1 FROM t JOIN y USING (doc_id) GROUP BY 1),
    e AS (SELECT term, n1, [n1 / n, p / n, p1 / n1, (p - p1) / (n - n1)] AS q, n FROM c, s WHERE n1 >= 10 AND n - n1 >= 10),
    h AS (SELECT term, n1 / n AS w, list_transform(q, lambda x: CASE WHEN x <= 0 OR x >= 1 THEN 0 ELSE -x * log2(x) - (1 - x) * log2(1 - x) END) AS h FROM e),
    f AS (SELECT term, row_number() OVER (ORDER BY round((h[2] - w * h[3] - (1 - w) * h[4]) / h[1], 9) DESC, term) AS r FROM h QUALIFY r <= 8),
    b AS (SELECT d.doc_id, string_agg(CASE WHEN t.term IS NULL THEN '0' ELSE '1' END, '' ORDER BY r) AS bits FROM documents d CROSS JOIN f LEFT JOIN t ON t.doc_id = d.doc_id AND t.term = f.term WHERE r <= 7 GROUP BY 1),
    x AS (SELECT doc_id, y, k, left(bits, k) AS node FROM b JOIN y USING (doc_id), range(0, 8) z(k)), g AS (SELECT node, y, count(*) AS n FROM x GROUP BY 1, 2),
    m AS (SELECT node, y AS class FROM g QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, y) = 1),
    o AS (SELECT DISTINCT x.node FROM x JOIN m ON m.node = left(x.node, x.k - 1) WHERE x.k > 0 AND x.y <> m.class),
    u AS (SELECT b.doc_id, k, m.node, m.class, bool_and(k = 0 OR o.node IS NOT NULL) OVER (PARTITION BY b.doc_id ORDER BY k) AS fine FROM b, range(0, 8) z(k) LEFT JOIN o ON o.node = left(b.bits, k) LEFT JOIN m ON m.node = left(b.bits, k))
    SELECT doc_id, arg_max(class, k) AS predicted FROM u WHERE fine GROUP BY 1""",
)
def gain_tree_quality(spark, sf_dir):
    """Quality of all documents by presence tests on eight words, in order of
    gain ratio (CLS9); learnt on the labelled ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    y = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("string").alias("y"))
    d = docs.select("doc_id", T.words("text").alias("f")).join(y, "doc_id", "left")
    stored = written(d.withColumn("f", F.array_distinct("f")), "words")
    return trees.gain_tree(stored, stored, "y", "f", least=10, depth=8)[1].select("doc_id", "predicted")


@query("embedding_merges")
def embedding_merges(spark, sf_dir):
    """The merge tree of the vectors whose id is divisible by 20 (CLU2)."""
    return agglomerate.merge_tree(table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0"), "vec_id", "embedding").withColumn("cost", F.round("cost", 6))


@query("latent_turns")
def latent_turns(spark, sf_dir):
    """How alike neighbouring turns of a conversation are in the space of four
    latent directions of their words (CLU3)."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    cells = c.select(key.alias("doc"), F.explode(T.words("text")).alias("term")).groupBy("doc", "term").agg(F.log1p(F.count(F.lit(1))).alias("w"))
    docs, _, _ = semantics.latent(cells, 4, more=4, rounds=8)
    one = c.select("conv_id", "turn", key.alias("doc")).join(docs, "doc")
    two = one.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("latent").alias("after"))
    return one.join(two, ["conv_id", "turn"]).select("conv_id", "turn", F.round(semantics.cosine(F.col("latent"), F.col("after")), 4).alias("similarity"))
