"""Queries of sequence rules, learnt and tested over conversations.

The stream of a conversation: for each turn the speaker that a cue suggests
(``P``), how the turn is laid out (``S`` with lines, else ``T``), the turn
itself (``q!`` ends a sentence, else ``q~``) and a full stop behind short ones.
The truth: who speaks, and who spoke before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.operators import rules as R
from fabula.plans.registry import query
from fabula.session import new_folder, table, written
from fabula.sources import writers

RULES = [
    "P S Q > Q.s=P", "P T Q > Q.s=P", "P E Q > Q.s=P", "P ?V q! > q!.s=P", "Q ?. P > Q.l=P", "P1 V Q1 ?. P2 V Q2 > Q1.s=P1 Q1.l=P2 Q2.s=P2 Q2.l=P1",
    "_Q1 ?. ?P ?V Q2 > Q2.l=Q1.s", "_Q1 ?. ?P ?V Q2 ?. ?P ?V Q3 > Q3.s=Q1.s Q1.s=Q3.s", "_Q1 ?. ?P ?V q!2 > Q1.l=Q2.s", "_Q1 ?. ?P ?V q~2 > Q2.s=Q1.l",
]


def generated() -> list[str]:
    """Rules from templates: all orders of cue, layout and turn."""
    return R.generated_rules(["(P {E}|{E} P) {Q} ?. > Q.s=P", f"{R.any_order('{Q}', 'P', '{E}')} > Q.s=P", "{Q}1 ?. (P {E}|P) {Q}2 > Q1.l=P Q2.s=P"], {"Q": ["Q", "q!", "q~"], "E": ["E", "S", "T"]})


def stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, gold) of the conversations."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    text = F.coalesce("text", F.lit(""))
    cue = F.when(F.contains(text, F.lit("?")), "user").when(F.length(text) > 400, "assistant")
    one = lambda k, cls, ref: F.struct((F.col("turn").cast("long") * 4 + k).alias("pos"), cls.alias("cls"), ref.alias("ref"))
    none = F.lit(None).cast("string")
    tokens = F.array(
        one(0, F.when(cue.isNotNull(), "P"), cue),
        one(1, F.when(F.contains(text, F.lit("\n")), "S").otherwise("T"), none),
        one(2, F.when(text.rlike("[.!?]$"), "q!").otherwise("q~"), none),
        one(3, F.when(F.length(text) < 100, "."), none),
    )
    t = c.select(F.col("conv_id").alias("story"), F.explode(tokens).alias("t")).select("story", "t.*").where("cls is not null")
    w = Window.partitionBy("conv_id").orderBy("turn")
    truth = c.select(F.col("conv_id").alias("story"), (F.col("turn").cast("long") * 4 + 2).alias("pos"), F.col("role").alias("s"), F.lag("role").over(w).alias("l"))
    return t, truth.unpivot(["story", "pos"], ["s", "l"], "field", "value").where("value is not null")


TOKENS = """c AS (SELECT conv_id AS story, turn::BIGINT * 4 AS pos, role, coalesce(text, '') AS t, CASE WHEN contains(text, '?') THEN 'user' WHEN length(text) > 400 THEN 'assistant' END AS cue,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS l FROM conversations),
  t AS (SELECT story, pos, 'P' AS cls, cue AS ref FROM c WHERE cue IS NOT NULL UNION ALL SELECT story, pos + 1, CASE WHEN contains(t, chr(10)) THEN 'S' ELSE 'T' END, NULL FROM c
    UNION ALL SELECT story, pos + 2, CASE WHEN regexp_matches(t, '[.!?]$') THEN 'q!' ELSE 'q~' END, NULL FROM c UNION ALL SELECT story, pos + 3, '.', NULL FROM c WHERE length(t) < 100),
  g AS (SELECT story, pos + 2 AS pos, 's' AS field, role AS value FROM c WHERE role IS NOT NULL UNION ALL SELECT story, pos + 2, 'l', l FROM c WHERE l IS NOT NULL)"""
AHEAD = """w AS (SELECT story, cls AS c0, ref AS r0, pos AS p0, lead(cls, 1) OVER o AS c1, lead(ref, 1) OVER o AS r1, lead(pos, 1) OVER o AS p1, lead(cls, 2) OVER o AS c2, lead(ref, 2) OVER o AS r2, lead(pos, 2) OVER o AS p2
    FROM t WINDOW o AS (PARTITION BY story ORDER BY pos))"""


@query(
    "rule_weights",
    f"""WITH {TOKENS}, {AHEAD},
  v AS (SELECT DISTINCT * FROM (SELECT 'P S Q > Q.s=P' AS rule, story, p2 AS pos, 's' AS field, r0 AS value FROM w WHERE c0 = 'P' AND c1 = 'S' AND c2 IN ('q!', 'q~')
    UNION ALL SELECT 'P ?V q! > q!.s=P', story, CASE WHEN c1 = 'q!' THEN p1 ELSE p2 END, 's', r0 FROM w WHERE c0 = 'P' AND (c1 = 'q!' OR c1 IN ('S', 'T') AND c2 = 'q!')
    UNION ALL SELECT 'Q ?. P > Q.l=P', story, p0, 'l', CASE WHEN c1 = 'P' THEN r1 ELSE r2 END FROM w WHERE c0 IN ('q!', 'q~') AND (c1 = 'P' OR c1 = '.' AND c2 = 'P'))),
  o AS (SELECT rule, v.field, v.story, count(g.value) AS n, count(*) FILTER (g.value = v.value) AS h FROM v LEFT JOIN g ON g.story = v.story AND g.pos = v.pos AND g.field = v.field GROUP BY ALL),
  a AS (SELECT rule, field, sum(n) AS n, sum(h) AS h FROM o GROUP BY ALL)
  SELECT rule, field, story, (a.n - o.n)::BIGINT AS n, (a.h - o.h)::BIGINT AS hits, round((a.h - o.h + 1) / (a.n - o.n + 2), 9) AS weight FROM o JOIN a USING (rule, field)""",
)
def rule_weights(spark, sf_dir):
    """What three rules weigh in each conversation by all others (AGG17, SEQ19);
    the table goes through its JSON file (SNK17)."""
    tokens, gold = stream(spark, sf_dir)
    rules = R.rule_table(spark, ["P S Q > Q.s=P", "P ?V q! > q!.s=P", "Q ?. P > Q.l=P"])
    votes = R.proposals(R.matches(tokens, rules), rules).select("story", "pos", "field", "rule", "value")
    path = new_folder(spark, "weights")
    writers.json_lines(R.held_out_weights(votes, gold), path)
    back = spark.read.schema("rule string, field string, story long, n long, hits long, weight double").json(path)
    return back.withColumn("weight", F.round("weight", 9))


@query("rules_by_hand")
def rules_by_hand(spark, sf_dir):
    """Speakers and listeners by rules written by hand, weighed on the other
    conversations, follow-up rules until nothing changes (SEQ19, SEQ20)."""
    tokens, gold = stream(spark, sf_dir)
    out, _ = R.assigned(tokens, gold, R.rule_table(spark, RULES))
    return R.scores(out, gold)


@query("rules_generated")
def rules_generated(spark, sf_dir):
    """The same with rules made from templates, elected by summed weights."""
    tokens, gold = stream(spark, sf_dir)
    out, _ = R.assigned(tokens, gold, R.rule_table(spark, generated()), method="weight")
    return R.scores(out, gold)


@query("rules_learnt")
def rules_learnt(spark, sf_dir):
    """Rules read off the other conversations and loosened, those right more
    often than not (SEQ16, SEQ17, SEQ19)."""
    tokens, gold = stream(spark, sf_dir)
    _, taught = R.extracted(tokens, gold)
    known = written(R.loosened(taught), "taught")
    rules = written(R.table_of(known.select("rule").distinct()), "rules")
    out, _ = R.assigned(tokens, gold, rules, known=known, method="bayes", least=0.5)
    return R.scores(out, gold)
