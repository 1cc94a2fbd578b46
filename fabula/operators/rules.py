"""Sequence rules that assign values: matched, learnt and tested story by story.

A rule is a pattern over the classes of neighbouring tokens and a list of
actions: ``Q1 ?V P2 > Q1.s=P2`` gives field ``s`` of the token that matches
``Q1`` what the token of ``P2`` stands for; ``_Q1 Q2 > Q2.l=Q1.s`` copies what
was assigned to another token before (a follow-up rule). Items: a class and
perhaps a number; ``?`` in front: the item takes a token if it can, else none.
``q~`` and ``q!`` may be called ``Q`` in actions.

Token tables have a story, a position, a class symbol and ``ref``, what the
token stands for. All rules share one automaton, whose states are prefixes of
patterns; a level of it is a join of the live matches with the edges, so its
cost does not depend on how many rules share a prefix. It reads each sequence
of classes once, however many tokens begin one.

Weights are those of the other stories: totals of a rule over all stories less
its own counts in the story, so leaving out each story in turn takes one plan.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.operators import tiles as tiling
from fabula.session import written

#: Votes of the stories that a task elects by; a story is not split.
VOTES = 400_000

#: Classes that stand for several symbols. The rule language.
CLASSES = {"Q": ["q~", "q!"], "E": ["E", "S", "A", "R", "T"], "V": ["V", "E", "S", "A", "R", "T"]}

RULES = "rule string, follows boolean, items array<struct<cls:string,optional:boolean>>, actions array<struct<target:int,field:string,source:int,of:string>>"


def parsed(text: str) -> tuple[str, bool, list[tuple[str, bool]], list[tuple[int, str, int, str | None]]]:
    """A rule's text, whether it follows up, its items and its actions."""
    pattern, _, actions = text.partition(">")
    follows = pattern.strip().startswith("_")
    names = pattern.strip().removeprefix("_").split()
    items = [(re.sub(r"\d+$", "", n.removeprefix("?")), n.startswith("?")) for n in names]
    place = {re.sub("^q[~!]", "Q", n.removeprefix("?")): k for k, n in enumerate(names)} | {n.removeprefix("?"): k for k, n in enumerate(names)}
    out = []
    for action in actions.split():
        m = re.fullmatch(r"([^.=]+)\.([sl])[=.]([^.=]+)(?:\.([sl]))?", action)
        if not m or m[1] not in place or m[3] not in place:
            raise ValueError(f"rule {text!r}: action {action!r} names no item of the pattern")
        out.append((place[m[1]], m[2], place[m[3]], m[4]))
    if not items or not out or all(optional for _, optional in items):
        raise ValueError(f"rule {text!r} needs an item that is not optional, and an action")
    return text, follows, items, out


def rule_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Rules from their texts, as a table (SEQ20, lists written by hand)."""
    return spark.createDataFrame([parsed(t) for t in dict.fromkeys(texts)], RULES)


def alternatives(template: str) -> list[str]:
    """All texts of a template with ``(a|b)`` groups, which may be nested."""
    inner = re.search(r"\(([^()]*)\)", template)
    if not inner:
        return [" ".join(template.split())]
    return list(dict.fromkeys(x for part in inner[1].split("|") for x in alternatives(f"{template[: inner.start()]}{part}{template[inner.end() :]}")))


def any_order(*parts: str) -> str:
    """A group of all orders of ``parts``."""
    return f"({'|'.join(' '.join(p) for p in itertools.permutations(parts))})"


def generated_rules(templates: list[str], options: dict[str, list[str]]) -> list[str]:
    """Rule texts from templates with groups and ``{name}`` slots, whose
    occurrences are filled apart (SEQ20, generated lists). In actions items go
    by the name ``Q`` whatever kind of quote they are."""
    out = []
    for t in itertools.chain.from_iterable(map(alternatives, templates)):
        slots = re.findall(r"\{(\w+)\}", t)
        for values in itertools.product(*[options[s] for s in slots]):
            filled = iter(values)
            out.append(re.sub(r"\{\w+\}", lambda _: next(filled), t))
    return list(dict.fromkeys(out))


def automaton(rules: DataFrame, classes: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (node, symbol, next) and ends (node, rule, taken) of the automaton
    that all rules share. A node is the list of symbol sets read so far. An
    optional item is passed over only if the next token is not of its class,
    so its symbols are taken out of the edge that skips it. ``taken``: the
    items that took the tokens, in order. A rule of k optional items has 2**k
    ways at most."""
    classes = CLASSES if classes is None else classes

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for rule, items in zip(pdf["rule"], pdf["items"]):
                stack = [("", 0, ())]
                while stack:
                    node, at, taken = stack.pop()
                    skipped: set[str] = set()
                    for k in range(at, len(items)):
                        own = set(classes.get(items[k]["cls"], [items[k]["cls"]]))
                        symbols = sorted(own - skipped)
                        if symbols:
                            further = f"{node} {','.join(symbols)}"
                            found += [(node, s, further, None, None) for s in symbols]
                            stack.append((further, k + 1, (*taken, k)))
                        if not items[k]["optional"]:
                            break
                        skipped |= own
                    else:
                        found.append((node, None, None, rule, list(taken)))
            yield pd.DataFrame(found, columns=["node", "symbol", "next", "rule", "taken"])

    every = written(rules.select("rule", "items").mapInPandas(ways, "node string, symbol string, next string, rule string, taken array<int>").distinct(), "automaton")
    return every.where("symbol is not null").select("node", "symbol", "next"), every.where("rule is not null").select("node", "rule", "taken")


def shapes(tokens: DataFrame, rules: DataFrame, *, story: str = "story", pos: str = "pos", cls: str = "cls", ref: str = "ref", classes: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(story, start, ahead, shape) of each token, where ``ahead`` has as many
    tokens as the longest rule can take and ``shape`` their classes; and (shape,
    rule, taken) of the matches that begin such a sequence of classes."""
    edges, ends = automaton(rules, classes)
    most = rules.agg(F.max(F.size("items"))).first()[0] or 0
    w = Window.partitionBy(story).orderBy(pos, cls, ref)
    each = tokens.where(F.col(cls).isNotNull() & F.col(pos).isNotNull() & F.col(story).isNotNull()).select(
        F.col(story).alias("story"),
        F.row_number().over(w).alias("start"),
        F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(cls).alias("cls"), F.col(ref).alias("ref"))).over(w.rowsBetween(0, max(most - 1, 0))).alias("ahead"),
    )
    each = written(each.withColumn("shape", F.transform("ahead", lambda x: x["cls"])), "ahead")
    live = each.select("shape").distinct().withColumn("node", F.lit(""))
    found = None
    for k in range(most):
        live = written(live.withColumn("symbol", F.get("shape", F.lit(k))).join(edges, ["node", "symbol"]).select("shape", F.col("next").alias("node")), "live")
        hits = live.join(ends, "node").select("shape", "rule", "taken")
        found = hits if found is None else found.union(hits)
        if live.isEmpty():
            break
    return each, (live.where("false").join(ends, "node").select("shape", "rule", "taken") if found is None else found.distinct())


def matches(tokens: DataFrame, rules: DataFrame, *, story: str = "story", pos: str = "pos", cls: str = "cls", ref: str = "ref", classes: dict[str, list[str]] | None = None) -> DataFrame:
    """story, start, rule, taken and ``ahead``, the tokens that were read
    (SEQ15). Tokens without a class or a position are left out before; equal
    positions come in the order of class and ref."""
    each, found = shapes(tokens, rules, story=story, pos=pos, cls=cls, ref=ref, classes=classes)
    return each.join(found, "shape").select("story", "start", "rule", "taken", "ahead")


def proposals(found: DataFrame, rules: DataFrame) -> DataFrame:
    """What the matches' actions say: story, pos, field, rule and either value
    or, for follow-up actions, from_pos and of. An action of which an item was
    passed over says nothing."""
    each = found.join(rules.select("rule", F.explode("actions").alias("a")), "rule")

    def token(item: Column) -> Column:
        place = F.array_position("taken", item)
        return F.when(place > 0, F.get("ahead", (place - 1).cast("int")))

    said = each.withColumn("to", token(F.col("a.target"))).withColumn("from", token(F.col("a.source")))
    return said.where("to is not null and from is not null").select(
        "story", F.col("to.pos").alias("pos"), F.col("a.field").alias("field"), "rule", F.when(F.col("a.of").isNull(), F.col("from.ref")).alias("value"), F.when(F.col("a.of").isNotNull(), F.col("from.pos")).alias("from_pos"), F.col("a.of").alias("of")
    ).where("value is not null or of is not null").distinct()


def held_out_weights(votes: DataFrame, gold: DataFrame) -> DataFrame:
    """rule, field, story, n, hits and weight: of all other stories' votes that
    can be checked the share that is right, one of two assumed (AGG16, AGG17)."""
    checked = votes.join(gold.select("story", "pos", "field", F.col("value").alias("gold")), ["story", "pos", "field"], "left")
    own = checked.groupBy("rule", "field", "story").agg(F.count("gold").alias("own_n"), F.count_if(F.col("gold") == F.col("value")).alias("own_hits"))
    total = own.groupBy("rule", "field").agg(F.sum("own_n").alias("all_n"), F.sum("own_hits").alias("all_hits"))
    n, hits = F.col("all_n") - F.col("own_n"), F.col("all_hits") - F.col("own_hits")
    return own.join(total, ["rule", "field"]).select("rule", "field", "story", n.alias("n"), hits.alias("hits"), ((hits + 1) / (n + 2)).alias("weight"))


METHODS = ("top", "weight", "bayes", "counter")


def elected(votes: DataFrame, method: str = "top") -> DataFrame:
    """story, pos, field and the value with the best score (SEQ18), ties to the
    least value. votes: also value and weight. ``top``: the best single weight;
    ``weight``: their sum; ``bayes``: that, and for each vote of another value
    what its weight leaves, shared among the other votes; ``counter``: votes."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    at = ["story", "pos", "field"]
    per = votes.groupBy(*at, "value").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.max("weight").alias("best"))
    whole = Window.partitionBy(*at)
    m, total = F.sum("n").over(whole), F.sum("w").over(whole)
    others = F.when(m > 1, F.col("n") / (m - 1) * ((m - F.col("n")) - (total - F.col("w")))).otherwise(0.0)
    score = {"top": F.col("best"), "weight": F.col("w"), "bayes": F.col("w") + others, "counter": F.col("n").cast("double")}[method]
    ranked = per.withColumn("score", F.round(score, 9)).withColumn("r", F.row_number().over(whole.orderBy(F.desc("score"), "value")))
    return ranked.where("r = 1").select(*at, "value", "score")


def sayings(tokens: DataFrame, rules: DataFrame, known: DataFrame | None, classes: dict[str, list[str]] | None) -> tuple[DataFrame, DataFrame, int]:
    """What ``proposals`` says, repeats included, with a number ``rid`` for each
    rule; (rule, rid); and at most how many rows. What a rule says of a sequence
    of classes is worked out once for all tokens that begin one. A rule that one
    story alone has taught is not used there."""
    names = rules.select("rule", "actions")
    if known is not None:
        by = known.groupBy("rule").agg(F.count_distinct("story").alias("many"), F.min("story").alias("only")).where("many > 0")
        names = names.join(by, "rule").withColumn("only", F.when(F.col("many") == 1, F.col("only")))
    names = written(names.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    each, found = shapes(tokens, rules, classes=classes)
    place = lambda item: (F.array_position("taken", item) - 1).cast("int")
    said = found.join(names, "rule").select("*", F.explode("actions").alias("a")).select("shape", F.struct("rid", *(["only"] if known is not None else []), place(F.col("a.target")).alias("to"), F.col("a.field").alias("field"), place(F.col("a.source")).alias("from"), F.col("a.of").alias("of")).alias("x"))
    said = written(said.where("x.to >= 0 and x.from >= 0").groupBy("shape").agg(F.collect_set("x").alias("said")), "said")
    held = each.join(said, "shape")
    x, source = F.col("x"), F.get("ahead", F.col("x.from"))
    rows = held.select("story", "ahead", F.explode("said").alias("x"))
    if known is not None:
        rows = rows.where(x["only"].isNull() | (x["only"] != F.col("story")))
    rows = rows.select("story", F.get("ahead", x["to"])["pos"].alias("pos"), x["field"].alias("field"), x["rid"].alias("rid"), F.when(x["of"].isNull(), source["ref"]).alias("value"), F.when(x["of"].isNotNull(), source["pos"]).alias("from_pos"), x["of"].alias("of"))
    return rows.where("value is not null or of is not null"), names.select("rule", "rid"), held.agg(F.sum(F.size("said"))).first()[0] or 0


def codes(*columns: np.ndarray) -> np.ndarray:
    """One number for each combination."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own, kinds = pd.factorize(c)
        out = pd.factorize(out * max(len(kinds), 1) + own)[0]
    return out


class Votes:
    """The votes of some stories by the assignments before, each once: numbers
    of cells (story, pos and field) and values, and of groups (rule, field and
    story), and what of a group's votes can be checked and is right."""

    def __init__(self, said: pa.Table, gold: pa.Table | None, before: pa.Table | None):
        tables = [t for t in (gold, before) if t is not None]
        of = said["of"].to_pandas().to_numpy(object)
        follow = np.flatnonzero(said["of"].is_valid().to_numpy())
        array = lambda t, c: t[c].to_pandas().to_numpy()
        whole = lambda c: said[c].fill_null(0).to_numpy() if pa.types.is_integer(said[c].type) else array(said, c)
        joined = lambda c, source: np.concatenate([array(said, c), source[follow], *[array(t, c) for t in tables]])
        self.story, self.pos, self.field = joined("story", array(said, "story")), joined("pos", whole("from_pos")), joined("field", of)
        cell = codes(self.story, self.pos, self.field)
        value, self.values = pd.factorize(np.concatenate([said["value"].to_pandas().to_numpy(object), *[t["value"].to_pandas().to_numpy(object) for t in tables]]), sort=True)
        self.cells, n = int(cell.max()) + 1, said.num_rows
        known, first, source = [], n, cell[n : n + len(follow)]
        for t in (gold, before):
            at = np.full(self.cells, -1)
            if t is not None:
                at[cell[first + len(follow) :][: t.num_rows]] = value[first : first + t.num_rows]
                first += t.num_rows
            known.append(at)
        value = value[:n].copy()
        value[follow] = known[1][source]
        rid = said["rid"].to_numpy()
        row = np.flatnonzero(value >= 0)
        row = row[~pd.Series(codes(cell[row], rid[row], value[row])).duplicated().to_numpy()]
        self.row, self.cell, self.value, self.rid = row, cell[row], value[row], rid[row]
        self.group = codes(self.rid, self.field[row], self.story[row])
        truth = known[0][self.cell]
        self.groups = int(self.group.max(initial=-1)) + 1
        self.n, self.hits = np.bincount(self.group, truth >= 0, self.groups), np.bincount(self.group, truth == self.value, self.groups)
        at = np.zeros(self.groups, np.int64)
        at[self.group] = np.arange(len(row))
        self.kinds = pd.DataFrame({"rid": self.rid[at], "field": self.field[row][at], "story": self.story[row][at]})

    def totals(self) -> pd.DataFrame:
        return self.kinds.assign(n=self.n.astype(np.int64), hits=self.hits.astype(np.int64)).groupby(["rid", "field"], as_index=False)[["n", "hits"]].sum()

    def weights(self, totals: pd.DataFrame) -> pd.DataFrame:
        """Of each group, by the votes of all other stories."""
        both = self.kinds.merge(totals, "left", ["rid", "field"])
        n, hits = both["n"].to_numpy() - self.n, both["hits"].to_numpy() - self.hits
        return self.kinds.assign(n=n.astype(np.int64), hits=hits.astype(np.int64), weight=(hits + 1) / (n + 2))

    def elected(self, totals: pd.DataFrame, method: str, least: float) -> pd.DataFrame:
        """``elected`` of these stories."""
        weight = self.weights(totals)["weight"].to_numpy()[self.group]
        heard = weight > least
        cell, value, row, weight = self.cell[heard], self.value[heard], self.row[heard], weight[heard]
        per = codes(cell, value)
        size = int(per.max(initial=-1)) + 1
        one = np.zeros(size, np.int64)
        one[per] = np.arange(len(per))
        n, w, best = np.bincount(per, minlength=size), np.bincount(per, weight, size), np.zeros(size)
        np.maximum.at(best, per, weight)
        at = cell[one]
        m, total = np.bincount(at, n, self.cells)[at], np.bincount(at, w, self.cells)[at]
        others = np.where(m > 1, n / np.maximum(m - 1, 1) * ((m - n) - (total - w)), 0.0)
        score = np.round({"top": best, "weight": w, "bayes": w + others, "counter": n.astype(float)}[method], 9)
        order = np.lexsort((value[one], -score, at))
        order = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])] if size else order
        row = row[one[order]]
        return pd.DataFrame({"story": self.story[row], "pos": self.pos[row], "field": self.field[row], "value": self.values[value[one[order]]], "score": score[order]})


def assigned(
    tokens: DataFrame, gold: DataFrame, rules: DataFrame, *, method: str = "top", passes: int = 5, least: float = 0.0,
    known: DataFrame | None = None, classes: dict[str, list[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Assignments of all stories, each by what the other stories teach, and
    the weights that made them (SEQ19).

    The first pass has the rules that take values from tokens; each further one
    lets follow-up rules read the assignments of the pass before, weighs them
    on these and elects again, until nothing changes or ``passes`` are over.
    So a story's own gold is never among what its assignments are elected by.
    ``least``: rules that weigh no more than that have no vote. ``known``
    (rule, story): the stories that taught a rule; it is then used only where
    another story has taught it. Null values, stories and positions say
    nothing; a gold value given twice is the lesser one.

    What rules say is written once, story by story in parts. A pass takes the
    parts twice: for the counts of the rules, which are summed over all of them
    and read by every task (a row for each rule and field), and for the election.
    Nothing else is shuffled in a pass but the assignments.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    spark = tokens.sparkSession
    said, names, rows = sayings(tokens, rules, known, classes)
    kinds = dict(said.dtypes)
    parts = tiling.tiles_for(rows, VOTES, 1, VOTES)
    part = F.pmod(F.xxhash64(F.col("story").cast(kinds["story"])), F.lit(parts)).cast("int")
    at = {"said": tiling.in_tiles(said, part, parts), "before": None, "totals": None}
    truth = gold.where("value is not null").groupBy("story", "pos", "field").agg(F.min("value").alias("value"))
    at["gold"] = tiling.in_tiles(truth.select(F.col("story").cast(kinds["story"]), F.col("pos").cast(kinds["pos"]), "field", "value"), part, parts)
    at_least = ["story", "pos", "field", "value"]

    def taken(what: str, schema: str, at: dict) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k in pdf["id"].tolist():
                    rows = tiling.read_tile(at["said"], k, ["story", "pos", "field", "rid", "value", "from_pos", "of"])
                    if rows is None:
                        continue
                    votes = Votes(rows, tiling.read_tile(at["gold"], k, at_least), at["before"] and tiling.read_tile(at["before"], k, at_least))
                    totals = None if what == "totals" else tiling.read_tile(at["totals"], 0, ["rid", "field", "n", "hits"])
                    if what == "totals":
                        yield votes.totals()
                    elif totals is not None:
                        yield votes.weights(totals.to_pandas()) if what == "weights" else votes.elected(totals.to_pandas(), method, least)

        return spark.range(0, parts, 1, min(parts, tiling.TASKS)).mapInPandas(run, schema)

    form, last = f"story {kinds['story']}, pos {kinds['pos']}, field string, value string, score double", None
    for _ in range(1 + passes):
        counts = taken("totals", "rid long, field string, n long, hits long", dict(at)).groupBy("rid", "field").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        at["totals"] = tiling.in_tiles(counts, F.lit(0), 1)
        by = dict(at)
        at["before"] = tiling.in_tiles(taken("elected", form, by), part, parts)
        out = spark.read.schema(form).parquet(at["before"]).select("story", "pos", "field", "value", "score")
        # One row: how many assignments, and a checksum of them.
        now = tuple(out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("story", "pos", "field", "value").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    weights = taken("weights", f"rid long, field string, story {kinds['story']}, n long, hits long, weight double", by)
    return out, weights.join(names, "rid").select("rule", "field", "story", "n", "hits", "weight")


def scores(out: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per story or other group, and field: gold values, those with an
    assignment, right ones, accuracy and coverage (AGG16)."""
    by = ["story", "field"] if by is None else by
    g = gold.where("value is not null").groupBy("story", "pos", "field").agg(F.min("value").alias("gold"))
    j = g.join(out.select("story", "pos", "field", "value"), ["story", "pos", "field"], "left")
    n, met, hit = F.count(F.lit(1)), F.count("value"), F.count_if(F.col("value") == F.col("gold"))
    return j.groupBy(*by).agg(n.alias("n"), met.alias("assigned"), hit.alias("hits"), F.round(hit / F.when(met > 0, met), 9).alias("accuracy"), F.round(met / n, 9).alias("coverage"))


def extracted(tokens: DataFrame, gold: DataFrame, *, before: int = 2, after: int = 2, cls: str = "cls", ref: str = "ref") -> tuple[DataFrame, DataFrame]:
    """Rules read off stories with gold values (SEQ16), and (rule, story): who
    taught which. Around each token with a gold value every window of up to
    ``before`` and ``after`` tokens is a pattern. Tokens that stand for the gold
    value give a rule of their own; other tokens of which a gold value is the
    same give follow-up rules."""
    one_each = gold.where("value is not null").groupBy("story", "pos", "field").agg(F.min("value").alias("value"))
    known = one_each.groupBy("story", "pos").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("truth"))  # fields are two
    w = Window.partitionBy("story").orderBy("pos", cls, ref)
    t = tokens.where(F.col(cls).isNotNull() & F.col("pos").isNotNull() & F.col("story").isNotNull()).join(known, ["story", "pos"], "left")
    one = F.struct(F.col(cls).alias("cls"), F.col(ref).alias("ref"), F.map_entries(F.coalesce("truth", F.create_map().cast("map<string,string>"))).alias("truth"))
    around = t.select(
        "story", "truth",
        F.collect_list(one).over(w.rowsBetween(-before, after)).alias("near"),
        F.least(F.row_number().over(w) - 1, F.lit(before)).alias("own"),
    ).where("truth is not null").withColumn("truth", F.map_entries("truth"))
    # What is alike about the tokens, without the values: few kinds, from which the rules are made once.
    same = lambda x: F.transform(F.filter("truth", lambda f: f["value"] == x["ref"]), lambda f: f["key"])
    both = lambda x: F.flatten(F.transform("truth", lambda f: F.transform(F.filter(x["truth"], lambda g: g["value"] == f["value"]), lambda g: F.struct(f["key"].alias("own"), g["key"].alias("other")))))
    held = written(around.select("story", "own", F.transform("near", lambda x: F.struct(x["cls"].alias("cls"), same(x).alias("same"), both(x).alias("both"))).alias("near")).distinct(), "kinds")
    spans = held.select("near", "own").distinct().select(
        "near", "own",
        F.explode(F.sequence(F.lit(0), "own")).alias("first"),
    ).select("*", F.explode(F.sequence("own", F.size("near") - 1)).alias("last"))
    kind = [F.col("near").alias("_near"), F.col("own").alias("_own")]
    cut = spans.where("last > first").select(*kind, (F.col("own") - F.col("first")).alias("at"), F.slice("near", F.col("first") + 1, F.col("last") - F.col("first") + 1).alias("near"))
    name = lambda x, k: F.concat(x["cls"], k.cast("string"))
    pattern = F.array_join(F.transform("near", lambda x, k: name(x, k)), " ")
    own = F.concat(F.get("near", F.col("at"))["cls"], F.col("at").cast("string"))
    others = lambda action: F.flatten(F.transform("near", lambda x, k: F.when(k != F.col("at"), action(x, k)).otherwise(F.array().cast("array<string>"))))
    plain = others(lambda x, k: F.transform(x["same"], lambda f: F.concat(own, F.lit("."), f, F.lit("="), name(x, k))))
    pairs = others(lambda x, k: F.transform(x["both"], lambda f: F.concat(own, F.lit("."), f["own"], F.lit("="), name(x, k), F.lit("."), f["other"])))
    made = cut.select("_near", "_own", pattern.alias("p"), F.array_sort(plain).alias("plain"), F.array_sort(pairs).alias("pairs"))
    text = lambda mark, c: F.when(F.size(c) > 0, F.concat(F.lit(mark), "p", F.lit(" > "), F.array_join(c, " ")))
    made = made.select("_near", "_own", F.explode(F.array(text("", "plain"), text("_", "pairs"))).alias("rule")).where("rule is not null").distinct()
    taught = held.join(made, (F.col("near") == F.col("_near")) & (F.col("own") == F.col("_own"))).select("story", "rule").distinct()
    return table_of(taught.select("rule").distinct()), taught


def table_of(texts: DataFrame) -> DataFrame:
    """The rule table of a column ``rule`` of texts, parsed in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parsed(t) for t in pdf["rule"]]
            yield pd.DataFrame(
                {
                    "rule": [r[0] for r in rows], "follows": [r[1] for r in rows],
                    "items": [[{"cls": c, "optional": o} for c, o in r[2]] for r in rows],
                    "actions": [[{"target": t, "field": f, "source": s, "of": of} for t, f, s, of in r[3]] for r in rows],
                }
            )

    return texts.select("rule").mapInPandas(run, RULES)


def loosened(taught: DataFrame) -> DataFrame:
    """(rule, story) with the variants of each rule in which items that no
    action names are optional, in all combinations (SEQ17)."""
    text = F.split("rule", " > ")
    items = F.split(F.ltrim(text[0], F.lit("_")), " ")
    named = F.split(F.regexp_replace(text[1], r"[ =]|\.[sl](?=[ =]|$)", " "), " +")

    def grown(acc: Column, x: Column) -> Column:
        plain = F.transform(acc, lambda a: F.concat(a, F.lit(" "), x))
        loose = F.transform(acc, lambda a: F.concat(a, F.lit(" ?"), x))
        return F.when(F.array_contains(named, x), plain).otherwise(F.concat(plain, loose))

    variants = F.aggregate(items, F.array(F.lit("")), grown)
    mark = F.when(F.startswith(F.col("rule"), F.lit("_")), "_").otherwise("")
    loose = taught.select("rule").distinct().select("rule", F.explode(F.transform(variants, lambda v: F.concat(mark, F.ltrim(v), F.lit(" > "), text[1]))).alias("loose"))
    return taught.join(loose, "rule").select("story", F.col("loose").alias("rule")).distinct()
