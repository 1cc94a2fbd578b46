"""Queries of lists, sets and vectors, lookups, leave-one-story-out neighbours,
mended mention groups and lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.functions import collections as C
from fabula.operators import bow, classify, filters, lexicon, mentions
from fabula.plans.learning import NEAR
from fabula.plans.registry import query
from fabula.plans.structure import M, lines
from fabula.plans.words import TERMS
from fabula.session import table


# -- lists and numbers ------------------------------------------------------


@query(
    "order_flag_lists",
    f"""WITH {M}, o AS (SELECT doc_id, list(flag ORDER BY mention_id) AS a, list(status ORDER BY mention_id) AS b FROM m GROUP BY 1)
    SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS one, array_to_string(list_filter(a || b, lambda x, i: list_position(a || b, x) = i), ',') AS both,
      array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i AND list_contains(b, x)), ',') AS common FROM o""",
)
def order_flag_lists(spark, sf_dir):
    """Ordered de-duplication, union, intersection and flattening (SET1, SET2, SET3, SET5)."""
    o = lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("mention_id", "flag", "status"))).alias("m"))  # an order's few lines
    a, b = F.col("m.flag"), F.col("m.status")
    out = {"one": C.distinct_items(a), "both": C.union_items(a, b), "common": C.common_items(a, b)}
    same = F.array_join(C.flat_set(F.array(a, b)), ",")
    out = {k: F.array_join(v, ",") for k, v in out.items()}
    return o.select("doc_id", out["one"].alias("one"), F.when(same == out["both"], same).alias("both"), out["common"].alias("common"))


@query(
    "order_flag_subsets",
    f"""WITH {M}, o AS (SELECT doc_id, flag || status AS f FROM m GROUP BY 1, 2), h AS (SELECT f, dense_rank() OVER (ORDER BY f) - 1 AS k FROM (SELECT DISTINCT f FROM o)),
    d AS (SELECT doc_id, bit_or(1 << CAST(k AS INT)) AS held, count(*) AS kinds FROM o JOIN h USING (f) GROUP BY 1), s AS (SELECT CAST(unnest(range(1, 1 << CAST((SELECT count(*) FROM h) AS INT))) AS INT) AS part)
    SELECT (SELECT string_agg(f, ',' ORDER BY f) FROM h WHERE (part >> CAST(k AS INT)) & 1 = 1) AS flags, count(*) AS n, sum(CASE WHEN bit_count(part) = 2 THEN 1 ELSE 0 END)::BIGINT AS pairs
    FROM d JOIN s ON (held & part) = part GROUP BY part""",
)
def order_flag_subsets(spark, sf_dir):
    """In how many orders each set of line flags occurs; powerset, combinations (SET6)."""
    o = lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat("flag", "status"))).alias("f"))  # six flags at most
    flags = lambda s: F.array_join(s, ",")
    sets = o.select(F.explode(C.powerset(F.col("f"))).alias("s")).where(F.size("s") > 0).groupBy(flags("s").alias("flags")).agg(F.count(F.lit(1)).alias("n"))
    pairs = o.select(F.explode(C.combinations(F.col("f"), 2)).alias("s")).groupBy(flags("s").alias("flags")).agg(F.count(F.lit(1)).alias("pairs"))
    return sets.join(pairs, "flags", "left").na.fill(0, ["pairs"])


@query(
    "clamped_lines",
    """SELECT l_orderkey, l_linenumber, greatest(10, least(40, CAST(l_quantity AS DOUBLE))) AS quantity, CAST(bit_count(l_partkey) AS INT) AS bits,
      CAST(l_quantity AS DOUBLE) + l_linenumber AS first, CAST(l_linenumber AS DOUBLE) AS second FROM lineitem""",
)
def clamped_lines(spark, sf_dir):
    """Clamp, bit count and sums by element (NUM1, NUM2)."""
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    total = C.sum_lists(F.array(q, n), F.array(n))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.clamp(q, 10.0, 40.0).alias("quantity"), F.bit_count("l_partkey").alias("bits"), total[0].alias("first"), total[1].alias("second"))


@query(
    "sparse_vectors",
    """WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN abs(x) < 0.1 THEN 0 ELSE abs(x) END) AS v FROM embeddings)
    SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, CAST(len(list_filter(v, lambda x: x <> 0)) AS INT) AS entries, round(list_max(v) / list_sum(v), 6) AS largest FROM e""",
)
def sparse_vectors(spark, sf_dir):
    """Length, sparse entries and largest share of each vector (ARR1)."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < 0.1, 0.0).otherwise(F.abs(x)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.round(C.l2_norm(F.col("v")), 6).alias("norm"), F.size(C.sparse(F.col("v"))).alias("entries"), F.round(F.array_max(C.relative(F.col("v"))), 6).alias("largest"))


@query(
    "event_properties",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'low' ELSE 'high' END AS level, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS large FROM events",
)
def event_properties(spark, sf_dir):
    """Properties over defaults (MAP1)."""
    own = F.create_map(F.lit("level"), F.when(F.col("event_type") == "view", "low"), F.lit("large"), F.when(F.col("value") > 50, "yes"))
    m = C.with_defaults(own, F.create_map(F.lit("level"), F.lit("high"), F.lit("large"), F.lit("no")))
    return table(spark, sf_dir, "events").select("event_id", m["level"].alias("level"), m["large"].alias("large"))


@query(
    "turn_slices",
    r"""SELECT conv_id, turn, trim(regexp_replace(substr(text, 4, 21), '[ \t\n\f\r]+', ' ', 'g')) AS slice, concat(role, ', ', role, ' and ', turn) AS label FROM conversations WHERE turn BETWEEN 1 AND 3""",
)
def turn_slices(spark, sf_dir):
    """Rows of an index range, their text slices and a label (JN15, STR24, STR29)."""
    c = filters.index_range(table(spark, sf_dir, "conversations"), "turn", 1, 3)
    return c.select("conv_id", "turn", C.slice_text(F.col("text"), 3, 24).alias("slice"), C.listed(F.array("role", "role", F.col("turn").cast("string"))).alias("label"))


@query("orders_of_customers", "SELECT DISTINCT o_custkey, c_nationkey, CAST(l_linenumber AS INT) AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey")
def orders_of_customers(spark, sf_dir):
    """Values of child lists once each, with a row looked up by its key (FLT18, JN14)."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("line"))).alias("lines"))  # an order's few lines
    held = table(spark, sf_dir, "orders").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return filters.all_values(held, ["o_custkey"], "lines", "line").join(c, "o_custkey", "left").select("o_custkey", "c_nationkey", "line")


@query("page_numbers", r"SELECT page_id, try_cast(nullif(regexp_extract(url, '/(\d+)', 1), '') AS BIGINT) AS number, nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS part FROM pages")
def page_numbers(spark, sf_dir):
    """Numbers of a source found in its name (SRC17)."""
    found = lambda pattern: F.nullif(F.regexp_extract("url", pattern, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", found(r"/(\d+)").try_cast("bigint").alias("number"), found(r"page=(\d+)").alias("part"))


# -- leave one story out ----------------------------------------------------

LEFT_OUT = NEAR.replace("query <> vec_id", "query % 7 <> vec_id % 7")
SHARES = """l AS (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL), c AS (SELECT query, label, count(*) AS c FROM k GROUP BY 1, 2), z AS (SELECT query, sum(c) AS size FROM c GROUP BY 1),
p AS (SELECT query, l.label, (coalesce(c, 0) + 0.1::DOUBLE) / (size + 0.1::DOUBLE * (SELECT count(*) FROM l)) AS p FROM z CROSS JOIN l LEFT JOIN c USING (query, label))"""


def shares(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("story", F.pmod("vec_id", F.lit(7)))
    near = classify.nearest(e, e.where("vec_id % 20 = 0"), 5, other=["label"], story="story")
    return classify.vote_distribution(near, e)


@query("left_out_shares", f"WITH {LEFT_OUT}, {SHARES} SELECT query, label, round(p, 9) AS p FROM p")
def left_out_shares(spark, sf_dir):
    """Smoothed shares of labels among the nearest of all other stories (CLS3)."""
    return shares(spark, sf_dir).select("query", "label", F.round("p", 9).alias("p"))


@query("left_out_labels", f"WITH {LEFT_OUT}, {SHARES} SELECT query, label FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(p, 9) DESC, label) = 1")
def left_out_labels(spark, sf_dir):
    """The likeliest label of these, without a sequence model (SEQ23, TOP12)."""
    return classify.likeliest(shares(spark, sf_dir)).select("query", "label")


@query(
    "gain_weighted_labels",
    """WITH e AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS v FROM embeddings), x AS (SELECT label, unnest(range(len(v))) AS i, unnest(v) > 0.1 AS bit FROM e WHERE label IS NOT NULL),
    n AS (SELECT i, bit, label, count(*) AS n FROM x GROUP BY ALL), w AS (SELECT i, label, sum(n) AS n FROM n GROUP BY ALL), h AS (SELECT i, -sum(s * log2(s)) AS h FROM (SELECT i, n / sum(n) OVER (PARTITION BY i) AS s FROM w) GROUP BY 1),
    b AS (SELECT i, bit, sum(n) AS size, -sum(s * log2(s)) AS h FROM (SELECT i, bit, n, n / sum(n) OVER (PARTITION BY i, bit) AS s FROM n) GROUP BY ALL), t AS (SELECT i, sum(size * h) / sum(size) AS hb FROM b GROUP BY 1),
    g AS (SELECT list(h - hb ORDER BY i) AS g FROM h JOIN t USING (i)),
    r AS (SELECT q.vec_id AS query, r.vec_id, r.label, round(list_sum(list_transform(range(1, len(g) + 1), lambda i: g[i] * least(q.v[i], r.v[i]))) / list_sum(list_transform(range(1, len(g) + 1), lambda i: g[i] * greatest(q.v[i], r.v[i]))), 6) AS s
      FROM e q JOIN e r ON q.vec_id % 7 <> r.vec_id % 7 CROSS JOIN g), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 5)
    SELECT query, label, round(sum(s), 4) AS weight FROM k GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(sum(s), 9) DESC, label) = 1""",
)
def gain_weighted_labels(spark, sf_dir):
    """The label of every vector's nearest ones in other stories, by Jaccard
    with weights from information gain (CLS2). All vectors against all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("embedding"), F.pmod("vec_id", F.lit(7)).alias("story"))
    near = classify.nearest_of_all(e, 5, classify.gain_weights(e, threshold=0.1), other=["label"], story="story")
    return classify.knn_label(near).select("query", "label", F.round("weight", 4).alias("weight"))


# -- mention groups ---------------------------------------------------------


def grouped(spark, sf_dir):
    token = lambda c, pos: F.struct(F.lit(pos).alias("pos"), F.col(c).alias("lemma"))
    m = lines(spark, sf_dir).withColumn("grp", F.pmod("mention_id", F.lit(3)))
    return m.withColumn("tokens", F.when(F.col("q") > 40, F.array(token("flag", "NNS"))).otherwise(F.array(token("flag", "NN"), token("status", "NNP"))))


@query(
    "groups_by_head",
    f"""WITH {M}, g AS (SELECT *, mention_id % 3 AS grp FROM m), h AS (SELECT DISTINCT doc_id, grp, unnest([lower(flag), lower(status)]) AS head FROM g WHERE q <= 40),
    e AS (SELECT DISTINCT a.doc_id, a.grp AS a, b.grp AS b FROM h a JOIN h b USING (doc_id, head)), t AS (SELECT x.doc_id, x.a AS grp, min(y.b) AS least FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.b = y.a GROUP BY 1, 2)
    SELECT doc_id, mention_id, CAST(coalesce(least, grp) AS BIGINT) AS grp FROM g LEFT JOIN t USING (doc_id, grp)""",
)
def groups_by_head(spark, sf_dir):
    """Groups merged on any common head (COR9)."""
    return mentions.merged_by_head(grouped(spark, sf_dir), 2).select("doc_id", "mention_id", F.col("grp").cast("long").alias("grp"))


@query(
    "joined_symbols",
    f"""WITH {M}, g AS (SELECT *, mention_id % 3 AS grp, CASE WHEN status = 'F' THEN flag END AS symbol FROM m), j AS (SELECT doc_id, mention_id, CASE WHEN symbol IS NULL THEN grp ELSE min(grp) OVER (PARTITION BY doc_id, symbol) END AS grp FROM g)
    SELECT doc_id, mention_id, CAST(grp AS BIGINT) AS grp, count(*) OVER (PARTITION BY doc_id, grp) = 1 AS singleton FROM j""",
)
def joined_symbols(spark, sf_dir):
    """Split groups of one symbol joined, and groups of one mention (COR11); all began alone (COR12)."""
    m = mentions.reset_groups(lines(spark, sf_dir)).withColumn("grp", F.pmod("grp", F.lit(3))).withColumn("symbol", F.when(F.col("status") == "F", F.col("flag")))
    return mentions.joined_symbols(m).select("doc_id", "mention_id", F.col("grp").cast("long").alias("grp"), "singleton")


# -- lexicons and models ----------------------------------------------------


@query(
    "lexicon_taxonomy",
    """WITH s AS (SELECT c_name AS word, 'n' || c_nationkey AS synset FROM customer), e AS (SELECT word AS child, synset AS parent FROM s UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
    SELECT child, parent, n_name AS renamed FROM e LEFT JOIN nation ON parent = 'n' || n_nationkey""",
)
def lexicon_taxonomy(spark, sf_dir):
    """Words below synsets below their hypernyms, with mapped ids (LEX13, LEX14)."""
    n, synset = table(spark, sf_dir, "nation"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    words = table(spark, sf_dir, "customer").select(F.col("c_name").alias("word"), synset("n", "c_nationkey").alias("synset"))
    up = n.select(synset("n", "n_nationkey").alias("synset"), F.lit("hypernym").alias("kind"), synset("r", "n_regionkey").alias("other"))
    names = n.select(synset("n", "n_nationkey").alias("old"), F.col("n_name").alias("new"))
    return lexicon.mapped_ids(lexicon.taxonomy(words, up), names, "parent").withColumnRenamed("parent_new", "renamed")


@query(
    "updated_frequencies",
    f"""WITH {TERMS}, a AS (SELECT -1 - item_id AS doc_id, term, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark) GROUP BY ALL),
    u AS (SELECT * FROM terms WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT * FROM a) SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1""",
)
def updated_frequencies(spark, sf_dir):
    """Term counts after toxic documents went and benchmark items came (BOW8)."""
    b = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    items = bow.term_counts(b, items=F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    u = bow.updated(bow.term_counts(table(spark, sf_dir, "documents")), items, toxic)
    return u.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))
