"""The gain-ordered tree against a recursive version."""

import math
import random
from collections import Counter

import pytest

from fabula.operators import trees


def gain_ratio(rows, f):
    h = lambda c: -sum(n / sum(c.values()) * math.log2(n / sum(c.values())) for n in c.values() if n)
    have, lack = [y for y, x in rows if f in x], [y for y, x in rows if f not in x]
    given = sum(len(s) / len(rows) * h(Counter(s)) for s in (have, lack) if s)
    return round((h(Counter(y for y, _ in rows)) - given) / h(Counter(f in x for _, x in rows)), 9)


def plain(train, rows, least, depth):
    names = {f for _, x in train for f in x}
    usable = [f for f in names if least <= sum(f in x for _, x in train) <= len(train) - least]
    ranked = sorted(usable, key=lambda f: (-gain_ratio(train, f), f))[:depth]

    def grow(part, k):
        c = Counter(y for y, _ in part)
        best = min(c, key=lambda y: (-c[y], y))
        node = {"class": best}
        if len(c) > 1 and k < len(ranked) - 1:
            for x in (True, False):
                inside = [r for r in part if (ranked[k] in r[1]) == x]
                if any(y != best for y, _ in inside):
                    node[x] = grow(inside, k + 1)
        return node

    root = grow(train, 0)

    def classify(x):
        node, k = root, 0
        while (ranked[k] in x) in node if k < len(ranked) else False:
            node, k = node[ranked[k] in x], k + 1
        return node["class"]

    return [classify(x) for _, x in rows]


@pytest.mark.parametrize("seed", range(4))
def test_equals_recursive_version(spark, seed):
    r = random.Random(seed)
    made = []
    for _ in range(150):
        x = {f for f in "abcdefgh" if r.random() < 0.45}
        made.append(("xyz"[(("a" in x) + ("b" in x) * ("c" in x)) % 3] if r.random() < 0.85 else r.choice("xyz"), x))
    df = spark.createDataFrame([(k, y, sorted(x) + sorted(x)[:1]) for k, (y, x) in enumerate(made)], "k int, y string, f array<string>")
    nodes, got = trees.gain_tree(df.where("k < 110"), df, "y", "f", least=5, depth=4 + seed)
    want = plain(made[:110], made, 5, 4 + seed)
    assert [q.predicted for q in got.orderBy("k").collect()] == want and nodes.count() > 3
    assert got.columns == ["k", "y", "f", "predicted"]


def test_odd_rows(spark):
    df = spark.createDataFrame([("x", None), ("x", []), (None, ["a"]), ("y", ["a"]), ("y", ["a"])], "y string, f array<string>")
    nodes, got = trees.gain_tree(df, df, "y", "f", least=1, depth=3)
    assert {q.predicted for q in got.collect()} == {"x"} and [tuple(n) for n in nodes.collect()] == [("", "x", 4)]
    nodes, got = trees.gain_tree(df.limit(0), df, "y", "f")
    assert nodes.count() == 0 and {q.predicted for q in got.collect()} == {None}
    assert trees.gain_tree(df, df.limit(0), "y", "f", least=1)[1].count() == 0
