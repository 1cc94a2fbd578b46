"""Sequence rules against a plain version that reads token by token."""

import random
import re
from collections import Counter, defaultdict

import pytest

from fabula.operators import rules as R
from fabula.plans import rules as P

CLASSES = {"Q": ["q~", "q!"], "E": ["E", "S", "A", "R", "T"], "V": ["V", "E", "S", "A", "R", "T"]}


def fits(item, symbol):
    cls = re.sub(r"\d+$", "", item.lstrip("?"))
    return symbol in CLASSES.get(cls, [cls])


def read(names, tokens, start):
    """Tokens that the items take from ``start`` on, greedily; None: no match."""
    taken, at = {}, start
    for k, name in enumerate(names):
        if at < len(tokens) and fits(name, tokens[at][1]):
            taken[k] = at
            at += 1
        elif not name.startswith("?"):
            return None
    return taken


def votes_of(rule, stories, out):
    """(story, pos, field, value) of one rule by the assignments ``out``."""
    text, follows, items, actions = R.parsed(rule)
    names = rule.partition(">")[0].strip().removeprefix("_").split()
    said = set()
    for story, tokens in stories.items():
        for start in range(len(tokens)):
            taken = read(names, tokens, start)
            # A story's first token must be taken by the match that starts there.
            if not taken or min(taken.values()) != start:
                continue
            for target, field, source, of in actions:
                if target in taken and source in taken:
                    t, s = tokens[taken[target]], tokens[taken[source]]
                    value = s[2] if of is None else out.get((story, s[0], of))
                    if value is not None:
                        said.add((story, t[0], field, value))
    return said


def plain(stories, gold, rules, method="top", passes=5, least=0.0, known=None):
    out, before = {}, None
    for turn in range(1 + passes):
        votes = {r: votes_of(r, stories, out) for r in rules if turn or not R.parsed(r)[1]}
        if turn:
            votes |= {r: votes_of(r, stories, out) for r in rules}
        if known is not None:
            votes = {r: {v for v in vs if len(known[r] - {v[0]}) > 0} for r, vs in votes.items()}
        heard = defaultdict(list)
        for r, vs in votes.items():
            for story, pos, field, value in vs:
                others = [(p, v) for s, p, f, v in vs if s != story and f == field for p in [(s, p, f)]]
                n = sum(p in gold for p, _ in others)
                hits = sum(gold.get(p) == v for p, v in others)
                w = (hits + 1) / (n + 2)
                if w > least:
                    heard[story, pos, field].append((value, w))
        out = {}
        for at, vs in heard.items():
            score = {}
            for value in sorted({v for v, _ in vs}):
                mine = [w for v, w in vs if v == value]
                rest = [1 - w for v, w in vs if v != value]
                shared = len(mine) * sum(rest) / (len(vs) - 1) if len(vs) > 1 else 0
                score[value] = round({"top": max(mine), "weight": sum(mine), "bayes": sum(mine) + shared, "counter": len(mine)}[method], 9)
            out[at] = max(sorted(score), key=score.get)
        if out == before:
            break
        before = out
    return out


def held(spark, stories, gold):
    t = spark.createDataFrame([(s, p, c, r) for s, ts in stories.items() for p, c, r in ts], "story long, pos long, cls string, ref string")
    g = spark.createDataFrame([(*k, v) for k, v in gold.items()], "story long, pos long, field string, value string")
    return t.repartition(3), g


def corpus(seed, stories=6, length=14):
    r = random.Random(seed)
    out, gold = {}, {}
    for s in range(stories):
        out[s] = [(3 * k, c, r.choice("abc") if c == "P" else None) for k in range(length) for c in [r.choice(["P", "P", "S", "T", "q!", "q~", "q!", "."])]]
        for pos, c, _ in out[s]:
            if c[0] == "q":
                near = [x for p, d, x in out[s] if d == "P" and abs(p - pos) < 7]
                gold[s, pos, "s"] = r.choice(near) if near and r.random() < 0.8 else r.choice("abc")
                if r.random() < 0.7:
                    gold[s, pos, "l"] = r.choice("abc")
    return out, gold


def result(df):
    return {(r.story, r.pos, r.field): r.value for r in df.collect()}


@pytest.mark.parametrize("method", R.METHODS)
def test_assignments_equal_plain_version(spark, method):
    stories, gold = corpus(1)
    t, g = held(spark, stories, gold)
    want = plain(stories, gold, P.RULES, method)
    assert want and result(R.assigned(t, g, R.rule_table(spark, P.RULES), method=method)[0]) == want


def test_learnt_rules_equal_plain_version(spark):
    stories, gold = corpus(2, stories=8, length=9)
    t, g = held(spark, stories, gold)
    rules, taught = R.extracted(t, g, before=1, after=2)
    assert {(r.rule, r.story) for r in taught.collect()} == read_off(stories, gold, 1, 2)
    loose = R.loosened(taught)
    known = defaultdict(set)
    for rule, story in read_off(stories, gold, 1, 2):
        for v in loose_plain(rule):
            known[v].add(story)
    assert {(r.rule, r.story) for r in loose.collect()} == {(r, s) for r, ss in known.items() for s in ss}
    want = plain(stories, gold, list(known), "bayes", 3, 0.45, known)
    got = R.assigned(t, g, R.table_of(loose.select("rule").distinct()), known=loose, method="bayes", least=0.45, passes=3)[0]
    assert want and result(got) == want


def read_off(stories, gold, before, after):
    found = set()
    for story, tokens in stories.items():
        truth = lambda k: {f: gold[story, tokens[k][0], f] for f in "sl" if (story, tokens[k][0], f) in gold}  # noqa: E731, B023
        for k in range(len(tokens)):
            for a in range(before + 1):
                for b in range(after + 1):
                    if not truth(k) or k - a < 0 or k + b >= len(tokens) or a + b == 0:
                        continue
                    span = list(range(k - a, k + b + 1))
                    name = {i: f"{tokens[i][1]}{n}" for n, i in enumerate(span)}
                    pattern = " ".join(name[i] for i in span)
                    one = sorted(f"{name[k]}.{f}={name[i]}" for i in span if i != k for f, v in truth(k).items() if tokens[i][2] == v)
                    two = sorted(f"{name[k]}.{f}={name[i]}.{h}" for i in span if i != k for f, v in truth(k).items() for h, x in truth(i).items() if x == v)
                    found |= {(f"{pattern} > {' '.join(one)}", story)} if one else set()
                    found |= {(f"_{pattern} > {' '.join(two)}", story)} if two else set()
    return found


def loose_plain(rule):
    text, actions = rule.split(" > ")
    named = set(re.split(r"[ =]", re.sub(r"\.[sl](?=[ =]|$)", "", actions)))
    out = [[]]
    for x in text.lstrip("_").split():
        out = [[*o, y] for o in out for y in ([x] if x in named else [x, "?" + x])]
    return [("_" if rule[0] == "_" else "") + " ".join(o) + " > " + actions for o in out]


@pytest.mark.parametrize("name", ["rules_by_hand", "rules_generated", "rules_learnt"])
def test_queries_equal_plain_version(spark, sf, name):
    t, g = P.stream(spark, sf)
    stories, gold = defaultdict(list), {}
    for r in sorted(t.collect(), key=lambda r: (r.story, r.pos)):
        stories[r.story].append((r.pos, r.cls, r.ref))
    for r in g.collect():
        gold[r.story, r.pos, r.field] = r.value
    if name == "rules_learnt":
        known = defaultdict(set)
        for rule, story in read_off(stories, gold, 2, 2):
            for v in loose_plain(rule):
                known[v].add(story)
        want = plain(stories, gold, list(known), "bayes", 5, 0.5, known)
    else:
        want = plain(stories, gold, P.RULES if name == "rules_by_hand" else P.generated(), "top" if name == "rules_by_hand" else "weight")
    n, met, hits = Counter(), Counter(), Counter()
    for (story, pos, field), value in gold.items():
        n[story, field] += 1
        met[story, field] += (story, pos, field) in want
        hits[story, field] += want.get((story, pos, field)) == value
    got = {(r.story, r.field): (r.n, r.assigned, r.hits) for r in getattr(P, name)(spark, sf).collect()}
    assert got == {k: (n[k], met[k], hits[k]) for k in n} and sum(hits.values())


def test_rule_texts(spark):
    assert R.parsed("_q~1 ?V q!2 > Q2.s=Q1.s") == ("_q~1 ?V q!2 > Q2.s=Q1.s", True, [("q~", False), ("V", True), ("q!", False)], [(2, "s", 0, "s")])
    for bad in ["P Q", "P Q > Q.s=R", "?P > P.s=P", "P Q > Q.x=P"]:
        with pytest.raises(ValueError):
            R.parsed(bad)
    assert R.alternatives("a (b|(c|d) e) f") == ["a b f", "a c e f", "a d e f"]
    assert R.any_order("a", "b") == "(a b|b a)"
    assert R.generated_rules(["(P|{E}) {Q} > Q.s=Q"], {"Q": ["Q", "q!"], "E": ["S", "T"]}) == [f"{x} {q} > Q.s=Q" for x in ("P", "S", "T") for q in ("Q", "q!")]


def test_odd_rows(spark):
    """Nulls, no tokens, no rules' matches, equal positions, a story of one token."""
    schema = "story long, pos long, cls string, ref string"
    rules = R.rule_table(spark, ["P Q > Q.s=P", "_Q1 Q2 > Q2.s=Q1.s"])
    gold = spark.createDataFrame([(1, 1, "s", "a"), (1, 1, "s", None), (1, 1, "s", "b"), (2, 0, "s", "a")], "story long, pos long, field string, value string")
    t = spark.createDataFrame([(1, 0, "P", "a"), (1, 1, "q!", None), (1, 2, None, "x"), (1, None, "P", "x"), (None, 1, "P", "x"), (2, 0, "q!", None), (1, 3, "q~", None), (1, 0, "P", "a")], schema)
    assert result(R.assigned(t, gold, rules)[0]) == {(1, 1, "s"): "a", (1, 3, "s"): "a"}
    assert result(R.assigned(t.limit(0), gold, rules)[0]) == {}
    assert result(R.assigned(t, gold.limit(0), rules)[0]) == {(1, 1, "s"): "a", (1, 3, "s"): "a"}
    assert R.matches(t, R.rule_table(spark, ["X Y > X.s=Y"])).count() == 0
    _, taught = R.extracted(t, gold)
    assert {r.rule for r in taught.collect()} >= {"P0 q!1 > q!1.s=P0"}
