"""Queries over label sequences: events of a user, turns of a conversation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators import sequences as S
from fabula.plans.registry import query
from fabula.plans.words import WORDS
from fabula.session import table

PAIRS = "pairs AS (SELECT user_id, ts, event_id, event_type AS label, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '<start>') AS previous FROM events)"
ORDER = ["ts", "event_id"]


@query("sequence_pairs", f"WITH {PAIRS} SELECT previous, label, count(*) AS n FROM pairs GROUP BY 1, 2")
def sequence_pairs(spark, sf_dir):
    p = S.previous_pairs(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type")
    return p.groupBy("previous", F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "transition_laplace",
    f"""WITH {PAIRS}, n AS (SELECT previous, label, count(*) AS n FROM pairs GROUP BY 1, 2), l AS (SELECT DISTINCT label FROM n), t AS (SELECT previous, sum(n) AS total FROM n GROUP BY 1)
    SELECT previous, label, coalesce(n, 0) AS n, round((coalesce(n, 0) + 1.0) / (total + (SELECT count(*) FROM l) - 1), 9) AS p FROM t CROSS JOIN l LEFT JOIN n USING (previous, label)""",
)
def transition_laplace(spark, sf_dir):
    return S.transition_table(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type").withColumn("p", F.round("p", 9))


@query(
    "cardinality_table",
    """WITH per AS (SELECT conv_id, role AS label, count(*) AS c FROM conversations GROUP BY 1, 2), s AS (SELECT count(DISTINCT conv_id) AS stories FROM conversations),
    sm AS (SELECT label, least(c, 5) AS times, count(*) AS n FROM per GROUP BY 1, 2), none AS (SELECT label, 0 AS times, stories - sum(n) AS n FROM sm, s GROUP BY label, stories HAVING stories - sum(n) > 0)
    SELECT label, CAST(times AS BIGINT) AS times, CAST(n AS BIGINT) AS n, round((n + 1.0) / (stories * 2.0), 9) AS p FROM (SELECT * FROM sm UNION ALL SELECT * FROM none), s""",
)
def cardinality_table(spark, sf_dir):
    return S.cardinality_table(table(spark, sf_dir, "conversations"), "conv_id", "role").withColumn("p", F.round("p", 9))


@query(
    "turn_islands",
    """WITH t AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM t)
    SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first, max(turn) AS last, count(*) AS length FROM r GROUP BY 1, 2, 3""",
)
def turn_islands(spark, sf_dir):
    return S.runs(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role")


@query(
    "event_islands",
    """WITH t AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM t)
    SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(ts) AS first, max(ts) AS last, count(*) AS length FROM r GROUP BY 1, 2, 3""",
)
def event_islands(spark, sf_dir):
    return S.runs(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type")


SEQS = "SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id"
#: The automaton: an optional system turn, then user and assistant in turn.
EDGES = [("s", "system", "a"), ("s", "user", "b"), ("a", "user", "b"), ("b", "assistant", "a")]


def role_lists(spark, sf_dir):
    """Roles in turn order. A conversation is one row, as in the reference's
    stories; the array holds its turns' roles only."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))


@query(
    "automaton_accept",
    """WITH RECURSIVE e AS (SELECT * FROM (VALUES """
    + ", ".join(str(x) for x in EDGES)
    + """) AS e(state, label, target)), q AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    w AS (SELECT DISTINCT conv_id, 0 AS k, 's' AS state FROM q UNION ALL SELECT w.conv_id, w.k + 1, e.target FROM w JOIN q ON q.conv_id = w.conv_id AND q.k = w.k + 1 JOIN e ON e.state = w.state AND e.label = q.role),
    m AS (SELECT conv_id, max(k) AS k FROM w GROUP BY 1), n AS (SELECT conv_id, count(*) AS n FROM q GROUP BY 1)
    SELECT conv_id, m.k = n.n AND w.state = 'a' AS accepted, CAST(m.k AS INT) AS n_read FROM m JOIN n USING (conv_id) JOIN w USING (conv_id, k)""",
)
def automaton_accept(spark, sf_dir):
    return S.automaton_accept(role_lists(spark, sf_dir), "roles", EDGES, "s", ["a"]).select("conv_id", "accepted", "n_read")


@query(
    "automaton_table",
    "WITH e AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in EDGES) + """) AS e(state, label, target)), s AS (SELECT DISTINCT state FROM e), r AS (SELECT role, count(*) AS n FROM conversations GROUP BY 1)
    SELECT role, state, n, EXISTS (SELECT 1 FROM e WHERE e.state = s.state AND e.label = r.role) AS allowed FROM r CROSS JOIN s""",
)
def automaton_table(spark, sf_dir):
    """Which roles each state allows, and how often they come."""
    e = spark.createDataFrame(EDGES, "state string, label string, target string")
    roles = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    grid = roles.crossJoin(e.select("state").distinct())  # roles by states, both few
    hit = grid.join(e.select("state", F.col("label").alias("role"), F.lit(True).alias("hit")), ["state", "role"], "left")
    return hit.select("role", "state", "n", F.coalesce("hit", F.lit(False)).alias("allowed"))


REF = ["system", "user", "assistant"]


@query(
    "order_test",
    f"""WITH s AS ({SEQS}), i AS (SELECT conv_id, list_transform(list_filter(roles, lambda x: list_contains({REF}, x)), lambda x: list_position({REF}, x)) AS ix FROM s)
    SELECT conv_id, list_sort(ix) = ix AS in_order FROM i""",
)
def order_test(spark, sf_dir):
    return role_lists(spark, sf_dir).select("conv_id", S.in_order(F.col("roles"), REF).alias("in_order"))


@query(
    "grammar_coverage",
    "SELECT conv_id, count(*) AS n, count(*) FILTER (role NOT IN ('user', 'assistant')) AS unknown, count(*) FILTER (role NOT IN ('user', 'assistant')) = 0 AS covered FROM conversations GROUP BY 1",
)
def grammar_coverage(spark, sf_dir):
    terminals = spark.createDataFrame([("user",), ("assistant",)], "label string")
    return S.coverage(table(spark, sf_dir, "conversations"), "role", terminals, ["conv_id"])


TRANS = f"""{PAIRS}, n AS (SELECT previous, label, count(*) AS n FROM pairs GROUP BY 1, 2), l AS (SELECT DISTINCT label FROM n), t AS (SELECT previous, sum(n) AS total FROM n GROUP BY 1),
tr AS (SELECT previous, label, round((coalesce(n, 0) + 1.0) / (total + (SELECT count(*) FROM l) - 1), 12) AS p FROM t CROSS JOIN l LEFT JOIN n USING (previous, label))"""


@query(
    "gold_rank",
    f"""WITH {TRANS}, s AS (SELECT event_id, pairs.label AS gold, tr.label, dense_rank() OVER (PARTITION BY event_id ORDER BY p DESC) - 1 AS rank FROM pairs JOIN tr USING (previous))
    SELECT rank, count(*) AS n FROM s WHERE gold = label GROUP BY 1""",
)
def gold_rank(spark, sf_dir):
    """Rank of each event's true type among the transitions from the one
    before; the rank depends on the pair alone, so pairs are ranked."""
    e = table(spark, sf_dir, "events")
    t = S.transition_table(e, "user_id", ORDER, "event_type").withColumn("p", F.round("p", 12))
    ranked = S.rank_of_gold(t, ["previous"], "p", F.lit(True))
    return ranked.groupBy(F.col("rank").cast("long").alias("rank")).agg(F.sum("n").alias("n")).where("n > 0")


@query(
    "sequence_accuracy",
    f"""WITH {TRANS}, b AS (SELECT previous, label AS guess FROM tr QUALIFY row_number() OVER (PARTITION BY previous ORDER BY p DESC, label) = 1)
    SELECT user_id, count(*) AS n, round(avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pairs JOIN b USING (previous) GROUP BY 1""",
)
def sequence_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = S.transition_table(e, "user_id", ORDER, "event_type").withColumn("p", F.round("p", 12))
    w = Window.partitionBy("previous").orderBy(F.desc("p"), "label")
    best = t.withColumn("r", F.row_number().over(w)).where("r = 1").select("previous", F.col("label").alias("guess"))
    p = S.previous_pairs(e, "user_id", ORDER, "event_type").join(best, "previous")
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("event_type") == F.col("guess")).cast("double")), 9).alias("accuracy"))


@query(
    "path_scores",
    f"WITH {TRANS} SELECT user_id, count(*) AS n, round(sum(ln(p)), 6) AS log_p FROM pairs JOIN tr USING (previous, label) GROUP BY 1",
)
def path_scores(spark, sf_dir):
    """Log probability of each user's path (SEQ9)."""
    e = table(spark, sf_dir, "events")
    t = S.transition_table(e, "user_id", ORDER, "event_type").select("previous", "label", F.round("p", 12).alias("p"))
    p = S.previous_pairs(e, "user_id", ORDER, "event_type").withColumnRenamed("event_type", "label").join(t, ["previous", "label"])
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.log("p")), 6).alias("log_p"))


@query(
    "ngram_continuations",
    f"""WITH t AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations)),
    b AS (SELECT word AS next, lag(word, 1) OVER w AS b1, lag(word, 2) OVER w AS b2 FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
    k AS (SELECT b1 AS key, next FROM b WHERE b1 IS NOT NULL UNION ALL SELECT b2 || ' ' || b1, next FROM b WHERE b2 IS NOT NULL) SELECT key, next, count(*) AS n FROM k GROUP BY 1, 2""",
)
def ngram_continuations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.struct("conv_id", "turn").alias("story"), F.posexplode(T.words("text")).alias("pos", "word"))
    return S.continuation_table(t, "story", ["pos"], "word", 2)


@query("beam_roles")
def beam_roles(spark, sf_dir):
    """Roles decoded from turn lengths and role transitions, by beam search."""
    c = table(spark, sf_dir, "conversations").where("role is not null")
    trans = {(r["previous"], r["label"]): r["p"] for r in S.transition_table(c, "conv_id", ["turn"], "role").collect()}  # labels squared
    size = F.least(F.floor(F.log2(F.length(F.coalesce("text", F.lit(""))) + 1)), F.lit(12))
    seen = c.select(size.alias("size"), "role").groupBy("size", "role").agg(F.count(F.lit(1)).alias("n"))
    total = seen.groupBy("size").agg(F.sum("n").alias("total"))
    roles = seen.select("role").distinct()
    p = total.crossJoin(roles).join(seen, ["size", "role"], "left").withColumn("p", (F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + 3))  # sizes by roles
    scores = c.select("conv_id", F.col("turn").alias("pos"), size.alias("size")).join(p.select("size", F.col("role").alias("label"), "p"), "size")
    return S.beam_decode(scores, trans, "conv_id", width=64)


@query("rule_matches")
def rule_matches(spark, sf_dir):
    """Sequence rules over the roles of each conversation (SEQ15)."""
    rules = [("answered", ["user", "assistant"]), ("opened", ["system?", "user", "assistant"]), ("asked again", ["user", "assistant", "user"])]
    return S.match_rules(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), rules, "conv_id", "turn", "role")


@query("generated_text")
def generated_text(spark, sf_dir):
    """Eight words of back-off text for each conversation's first word."""
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.struct("conv_id", "turn").alias("story"), F.posexplode(T.words("text")).alias("pos", "word"))
    model = S.continuation_table(t, "story", ["pos"], "word", 2)
    seeds = c.where("turn = 0").select(F.col("conv_id").alias("id"), F.slice(T.words("text"), 1, 1).alias("words"))
    return S.generate(model, seeds, 8, 2)
