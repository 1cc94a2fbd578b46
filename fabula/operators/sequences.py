"""Label sequences: transitions, cardinalities, automata, runs, decoding.

A sequence table has a story key, a total order and a label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "<start>"


def previous_pairs(steps: DataFrame, story: str, order: list[str], label: str) -> DataFrame:
    """(previous, label), the first after ``START`` (WIN11)."""
    w = Window.partitionBy(story).orderBy(*order)
    return steps.withColumn("previous", F.coalesce(F.lag(label).over(w), F.lit(START)))


def transition_table(steps: DataFrame, story: str, order: list[str], label: str, beta: float = 1.0) -> DataFrame:
    """Laplace-smoothed transitions for every pair of labels (SEQ1). The
    denominator adds beta * (labels - 1), so rows do not sum to one."""
    pairs = previous_pairs(steps, story, order, label)
    n = pairs.groupBy("previous", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    labels = n.select("label").distinct()
    many = labels.agg(F.count(F.lit(1)).alias("k"))
    total = n.groupBy("previous").agg(F.sum("n").alias("total"))
    grid = total.crossJoin(labels).join(n, ["previous", "label"], "left").crossJoin(F.broadcast(many))  # labels are few; one row
    n0 = F.coalesce("n", F.lit(0))
    return grid.select("previous", "label", n0.alias("n"), ((n0 + beta) / (F.col("total") + beta * (F.col("k") - 1))).alias("p"))


def cardinality_table(steps: DataFrame, story: str, label: str, cap: int = 5, beta: float = 1.0) -> DataFrame:
    """In how many stories a label occurs 0, 1, .. cap times (SEQ2); counts of
    ``cap`` and more share a row. The total is stories + stories * beta."""
    per = steps.groupBy(story, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("c"))
    stories = steps.agg(F.countDistinct(story).alias("stories"))
    some = per.groupBy("label", F.least("c", F.lit(cap)).alias("times")).agg(F.count(F.lit(1)).alias("n"))
    none = some.groupBy("label").agg(F.sum("n").alias("with")).crossJoin(F.broadcast(stories)).select("label", F.lit(0).cast("long").alias("times"), (F.col("stories") - F.col("with")).alias("n"))
    both = some.select("label", F.col("times").cast("long").alias("times"), "n").union(none.where("n > 0"))
    return both.crossJoin(F.broadcast(stories)).select("label", "times", "n", ((F.col("n") + beta) / (F.col("stories") * (1 + beta))).alias("p"))  # one row


def runs(steps: DataFrame, story: str, order: list[str], label: str) -> DataFrame:
    """Runs of equal neighbours (WIN12): number, label, first and last order
    value, length."""
    w = Window.partitionBy(story).orderBy(*order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = steps.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = order[0]
    return numbered.groupBy(story, "run", label).agg(F.min(first).alias("first"), F.max(first).alias("last"), F.count(F.lit(1)).alias("length"))


def automaton_accept(seqs: DataFrame, labels: str, edges: list[tuple[str, str, str]], start: str, accept: list[str], once_only: bool = False) -> DataFrame:
    """Follows a deterministic automaton over an array of labels as a fold
    (SEQ3): accepted, and how many labels were read before it stopped. With
    ``once_only`` a label that was met before is not allowed."""
    table = F.create_map(*[F.lit(x) for a, b, c in edges for x in (f"{a}|{b}", c)])
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).alias("read"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("|"), x))
        fine = acc["state"].isNotNull() & to.isNotNull()
        if once_only:
            fine = fine & ~F.array_contains(acc["seen"], x)
        return F.struct(
            F.when(fine, to).alias("state"),
            (acc["read"] + F.when(fine, 1).otherwise(0)).alias("read"),
            (F.array_append(acc["seen"], x) if once_only else acc["seen"]).alias("seen"),
        )

    out = seqs.withColumn("_end", F.aggregate(F.col(labels), zero, step))
    return out.withColumns({"accepted": F.coalesce(F.col("_end.state").isin(*accept), F.lit(False)), "n_read": F.col("_end.read")}).drop("_end")


def allowed_next(edges: DataFrame, state: str = "state") -> DataFrame:
    """The labels that each state allows (SEQ4)."""
    return edges.groupBy(state).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("allowed"))


def in_order(labels: Column, reference: list[str]) -> Column:
    """True if the known labels come in the order of ``reference`` (SEQ5)."""
    index = F.transform(F.filter(labels, lambda x: x.isin(*reference)), lambda x: F.array_position(F.array(*map(F.lit, reference)), x))
    return F.array_sort(index) == index


def coverage(seqs: DataFrame, label: str, terminals: DataFrame, by: list[str]) -> DataFrame:
    """Whether all labels of each group are terminals (SEQ6)."""
    known = terminals.select(F.col("label").alias("_t")).distinct()
    joined = seqs.join(known, F.col(label) == F.col("_t"), "left")
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_t").isNull()).alias("unknown")).withColumn("covered", F.col("unknown") == 0)


def rank_of_gold(scores: DataFrame, item: list[str], score: str, is_gold: Column) -> DataFrame:
    """How many distinct better scores the gold label has (WIN9)."""
    w = Window.partitionBy(*item).orderBy(F.desc(score))
    return scores.withColumn("rank", F.dense_rank().over(w) - 1).where(is_gold)


def beam_decode(scores: DataFrame, transitions: dict[tuple[str, str], float], story: str, width: int = 100, mask: int = 3) -> DataFrame:
    """Best label path of each story (SEQ7). ``scores`` has story, pos, label
    and p; mask bit 1 uses p, bit 2 the transitions. Partial paths are kept
    best first, ties by labels; ``width`` at least labels**steps is exact."""

    def decode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        beam: list[tuple[float, tuple]] = [(0.0, ())]
        for _, at in pdf.sort_values(["pos", "label"]).groupby("pos"):
            grown = []
            for value, path in beam:
                last = path[-1] if path else START
                for label, p in zip(at["label"], at["p"]):
                    gain = (np.log(p) if mask & 1 else 0.0) + (np.log(transitions.get((last, label), 1e-9)) if mask & 2 else 0.0)
                    grown.append((value + gain, (*path, label)))
            beam = sorted(grown, key=lambda x: (-round(x[0], 9), x[1]))[:width]
        value, path = beam[0]
        return pd.DataFrame({story: [key[0]], "path": [list(path)], "value": [value]})

    kind = dict(scores.dtypes)[story]
    return scores.groupBy(story).applyInPandas(decode, f"{story} {kind}, path array<string>, value double")


def continuation_table(tokens: DataFrame, story: str, order: list[str], token: str, n: int) -> DataFrame:
    """What follows each key of 1..n tokens, with counts (SEQ12). The key is
    built from lags; no list of a key's followers is collected."""
    w = Window.partitionBy(story).orderBy(*order)
    back = tokens.select(F.col(token).alias("next"), *[F.lag(token, k).over(w).alias(f"b{k}") for k in range(n, 0, -1)])
    keys = F.array(*[F.when(F.col(f"b{k}").isNotNull(), F.concat_ws(" ", *[F.col(f"b{j}") for j in range(k, 0, -1)])) for k in range(1, n + 1)])
    return back.select(F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("key"), "next").groupBy("key", "next").agg(F.count(F.lit(1)).alias("n"))


def generate(table: DataFrame, seeds: DataFrame, steps: int, n: int, least_choices: int = 2, seed: int = 1) -> DataFrame:
    """Back-off text for many seeds at once (SEQ13): each step joins the
    longest key that has enough choices and picks by hash. ``seeds`` has id
    and words (an array)."""
    choices = table.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") >= least_choices)
    w = Window.partitionBy("key").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
    spread = table.join(choices, "key").withColumn("upto", F.sum("n").over(w)).withColumn("after", F.col("upto") - F.col("n"))
    text = seeds
    for k in range(steps):
        tails = text.select("id", "words", F.explode(F.sequence(F.lit(n), F.lit(1))).alias("len")).where(F.size("words") >= F.col("len"))
        tails = tails.withColumn("key", F.array_join(F.slice("words", -F.col("len"), F.col("len")), " "))
        best = tails.join(choices.select("key", "total"), "key").groupBy("id").agg(F.max_by(F.struct("key", "total"), "len").alias("b")).select("id", "b.*")
        pick = best.withColumn("at", F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.col("total")))
        drawn = pick.join(spread.select("key", "next", "after", "upto"), "key").where("at >= after and at < upto").select("id", "next")
        text = text.join(drawn, "id", "left").select("id", F.when(F.col("next").isNotNull(), F.array_append("words", F.col("next"))).otherwise(F.col("words")).alias("words"))
    return text


def match_rules(tokens: DataFrame, rules: list[tuple[str, list[str]]], story: str, pos: str, cls: str) -> DataFrame:
    """Where sequence rules match (SEQ15): a rule is a list of classes, an item
    ending in ``?`` may be missing, ``*`` is any class. One pass over each
    story with a set of live matchers; leftmost starts, longest match each."""

    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        found = list(live_matches(zip(pdf[pos], pdf[cls]), rules))
        return pd.DataFrame([(key[0], r, a, b) for r, a, b in found], columns=[story, "rule", "first", "last"])

    kind, p = dict(tokens.dtypes)[story], dict(tokens.dtypes)[pos]
    return tokens.groupBy(story).applyInPandas(step, f"{story} {kind}, rule string, first {p}, last {p}")


def live_matches(tokens, rules: list[tuple[str, list[str]]]) -> Iterator[tuple]:
    """Matches (rule, first, last) of ordered (position, class) tokens."""

    def closed(rule: list[str], k: int) -> set[int]:
        states = {k}
        while k < len(rule) and rule[k].endswith("?"):
            k += 1
            states.add(k)
        return states

    live: dict[tuple, set[int]] = {}
    ends: dict[tuple, object] = {}
    for at, c in tokens:
        for name, _ in rules:
            live[name, at] = set()
        for (name, first), states in list(live.items()):
            rule = dict(rules)[name]
            now = closed(rule, 0) if first == at else states
            moved = {s for k in now if k < len(rule) and rule[k].rstrip("?") in (c, "*") for s in closed(rule, k + 1)}
            if len(rule) in moved:
                ends[name, first] = at
            if moved - {len(rule)}:
                live[name, first] = moved
            else:
                del live[name, first]
                if (name, first) in ends:
                    yield name, first, ends.pop((name, first))
    for (name, first), last in ends.items():
        yield name, first, last
