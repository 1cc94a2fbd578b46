"""Word patterns over tagged tokens: leftmost-longest matches with groups.

    search(tokens, "(DT) {JJ+ NN|NNS} !of", by=["doc_id", "sent"], order="idx")

Items stand between blanks: a word, a tag (capitals) or alternatives ``a|b``,
wildcards ``*ing``; ``!x`` is anything but x; ``(x)`` may be missing; ``x+`` may
repeat; ``(x)+`` both; ``{ .. }`` is a group. A sentence is folded twice inside
Spark: from its end, how far each item can reach from each token; from its
start, which item takes which token. Both folds read a bit mask per token, whose
bits say which items fit; work is sentence length times items.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.operators.filters import constraint

MOST_ITEMS = 30


@dataclass
class Item:
    words: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    negated: bool = False
    optional: bool = False
    multiple: bool = False

    def fits(self) -> Column:
        any_of = F.lit(False)
        if self.words:
            any_of = any_of | constraint(words=self.words)
        if self.tags:
            any_of = any_of | constraint(tags=self.tags)
        return ~any_of if self.negated else any_of


@dataclass
class Pattern:
    items: list[Item]
    #: (first item, last item) of each group, as its brace opened.
    groups: list[tuple[int, int]]


def compiled(text: str) -> Pattern:
    """A pattern from its notation."""
    items, opened, groups = [], [], []
    for part in re.sub(r"([{}])", r" \1 ", text).split():
        if part == "{":
            opened.append(len(groups))
            groups.append((len(items), -1))
        elif part == "}":
            if not opened:
                raise ValueError(f"pattern {text!r} closes a group that is not open")
            k = opened.pop()
            groups[k] = (groups[k][0], len(items) - 1)
        else:
            multiple = len(part) > 1 and part.endswith("+")
            part = part[:-1] if multiple else part
            optional = part.startswith("(") and part.endswith(")")
            part = part[1:-1] if optional else part
            negated = part.startswith("!") and len(part) > 1
            names = [n for n in part.removeprefix("!" if negated else "").split("|") if n]
            if not names:
                raise ValueError(f"pattern {text!r} has an empty item")
            is_tag = lambda n: n == n.upper() and any(c.isalpha() for c in n)
            items.append(Item([n for n in names if not is_tag(n)], [n for n in names if is_tag(n)], negated, optional, multiple))
    if opened or not items or all(i.optional for i in items) or len(items) > MOST_ITEMS:
        raise ValueError(f"pattern {text!r} needs closed groups and 1 to {MOST_ITEMS} items, not all of them optional")
    return Pattern(items, groups)


def reach(masks: Column, items: list[Item]) -> Column:
    """For each place 0..n of a sentence an array: the farthest end of a match
    that has come to item j there; the last entry is the place itself, -1: none.
    Folded from the end, so the array comes in reverse order."""
    n = len(items)

    def at(place: Column, mask: Column | None, after: Column | None) -> Column:
        row: list[Column] = [place]
        for j in range(n - 1, -1, -1):
            best = F.lit(-1)
            if mask is not None:
                go = F.get(after, F.lit(j + 1))
                if items[j].multiple:
                    go = F.greatest(go, F.get(after, F.lit(j)))
                best = F.when(mask.bitwiseAND(F.lit(1 << j)) != 0, go).otherwise(-1)
            row.insert(0, F.greatest(best, row[0]) if items[j].optional else best)
        return F.array(*[x.cast("int") for x in row])

    size = F.size(masks)
    zero = F.array(at(size, None, None))
    # Each step appends the array of the place before.
    return F.aggregate(F.reverse(masks), zero, lambda acc, m: F.array_append(acc, at(size - F.size(acc), m, F.element_at(acc, -1))))


def taken_items(masks: Column, far: Column, items: list[Item]) -> Column:
    """For each token (match start, item), or null where no match has it. At a
    start the longest match is followed; an item takes a token before it is
    passed over, and keeps taking before the next one does."""
    n, size = len(items), F.size(masks)
    score = lambda place, j: F.get(F.get(far, size - place), F.lit(j))
    state = "struct<start:int,end:int,item:int,out:array<struct<start:int,item:int>>>"
    zero = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("item"), F.array().cast("array<struct<start:int,item:int>>").alias("out")).cast(state)

    def step(acc: Column, place: Column) -> Column:
        fresh = acc["end"] <= place
        end = F.when(fresh, score(place, 0)).otherwise(acc["end"])
        on = end > place
        item = F.when(fresh, F.lit(0)).otherwise(acc["item"])
        start = F.when(fresh, place).otherwise(acc["start"])
        mask = F.get(masks, place)

        def leads(j: int) -> Column:
            go = score(place + 1, j + 1) == end
            if items[j].multiple:
                go = go | (score(place + 1, j) == end)
            return (mask.bitwiseAND(F.lit(1 << j)) != 0) & go

        taker = F.lit(None).cast("int")
        for j in range(n - 1, -1, -1):
            # From an item at or before j, all between may be missing.
            first = j
            while first > 0 and items[first - 1].optional:
                first -= 1
            taker = F.when((item >= first) & (item <= j) & leads(j), F.lit(j)).otherwise(taker)
        again = F.lit(False)
        for j in range(n):
            if items[j].multiple:
                again = again | ((taker == j) & (score(place + 1, j) == end))
        shown = F.when(on, F.struct(start.cast("int").alias("start"), taker.alias("item")))
        return F.struct(
            start.cast("int").alias("start"), F.when(on, end).otherwise(place).cast("int").alias("end"),
            F.when(on, F.when(again, taker).otherwise(taker + 1)).otherwise(0).cast("int").alias("item"),
            F.array_append(acc["out"], shown).alias("out"),
        ).cast(state)

    return F.aggregate(F.sequence(F.lit(0), size - 1), zero, step)["out"]


def search(tokens: DataFrame, pattern: str, by: list[str], order: str) -> DataFrame:
    """Leftmost-longest matches that don't overlap (SEQ22): ``by``, match (from
    0), first, last (values of ``order``), items (one per token) and groups, an
    array of (first, last) or nulls for a group without a token. Tokens need the
    columns token and tag, null ones fit no name; a null ``order`` is left out,
    tokens with the same one come in the order of token and tag. A sentence's
    tokens are in one row."""
    p = compiled(pattern)
    columns = set(tokens.columns)
    full = tokens.withColumns({c: F.lit(None).cast("string") for c in ("token", "tag", "chunk", "role") if c not in columns})
    mask = sum((F.when(F.coalesce(i.fits(), F.lit(i.negated)), F.lit(1 << j)).otherwise(F.lit(0)) for j, i in enumerate(p.items)), F.lit(0))
    s = full.where(F.col(order).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce("token", F.lit("")).alias("token"), F.coalesce("tag", F.lit("")).alias("tag"), mask.alias("mask")))).alias("_s"))
    s = s.select(*by, F.transform("_s", lambda x: x["at"]).alias("_at"), F.transform("_s", lambda x: x["mask"]).alias("_m"))
    # No filter here, and an outer explode below: Spark would push a filter (also
    # the one it infers of an explode) below the folds and so run one in the other.
    s = s.withColumn("_far", reach(F.col("_m"), p.items))
    s = s.withColumn("_t", taken_items(F.col("_m"), F.col("_far"), p.items))
    each = s.select(*by, "_at", F.posexplode_outer("_t").alias("_k", "_x")).where("_x is not null").select(*by, F.get("_at", F.col("_k")).alias("at"), "_k", "_x.start", "_x.item")
    m = each.groupBy(*by, "start").agg(F.array_sort(F.collect_list(F.struct("_k", "at", "item"))).alias("x"))  # a match's tokens
    inside = lambda g: F.filter("x", lambda t: (t["item"] >= g[0]) & (t["item"] <= g[1]))
    group = lambda g: F.struct(F.get(inside(g), F.lit(0))["at"].alias("first"), F.get(inside(g), F.size(inside(g)) - 1)["at"].alias("last"))
    groups = F.array(*[group(g) for g in p.groups]) if p.groups else F.array()
    return m.select(
        *by, (F.row_number().over(Window.partitionBy(*by).orderBy("start")) - 1).alias("match"),
        F.col("x")[0]["at"].alias("first"), F.element_at("x", -1)["at"].alias("last"), F.transform("x", lambda t: t["item"]).alias("items"), groups.alias("groups"),
    )
