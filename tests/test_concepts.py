"""Concept flags and likeness to clouds against plain versions."""

import random

import pytest

from fabula.operators import concepts as C


def reach(edges, node):
    seen, todo = {node}, [node]
    while todo:
        x = todo.pop()
        new = {c for w, r, c in edges if w == x and r == "isa"} - seen
        seen |= new
        todo += new
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_flags_equal_reachability(spark, seed):
    r = random.Random(seed)
    names = [f"n{k}" for k in range(30)]
    edges = sorted({(r.choice(names), r.choice(["isa", "isa", "can", "partof"]), r.choice(names)) for _ in range(45)})
    rules = [("one", ["isa"], ["n1", "n2"]), ("two", ["can", "partof"], ["n3"]), ("three", ["can"], ["n4", "n5", "nowhere"])]
    df = spark.createDataFrame([*edges, (None, "isa", "n1"), ("n1", None, "n2"), ("n2", "isa", None)], "word string, relation string, concept string")
    words = spark.createDataFrame([(n,) for n in [*names, "n1", None]], "word string")
    got = {x.word: (x.one, x.two, x.three) for x in C.concept_flags(words, df, rules).collect()}
    want = {n: tuple(float(any(rel in rs and reach(edges, c) & set(cs) for w, rel, c in edges if w == n)) for _, rs, cs in rules) for n in names}
    assert got == want | {None: (0.0, 0.0, 0.0)} and any(sum(v) for v in want.values())
    with pytest.raises(ValueError):
        C.concept_flags(words, df, [(f"f{k}", ["isa"], ["n1"]) for k in range(64)])


def test_clouds_equal_all_pairs(spark):
    r = random.Random(3)
    edges = sorted({(f"s{k}", f"s{r.randrange(k)}") for k in range(1, 40) for _ in range(2)}) + [("t1", "t0")]
    parents = {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
    depth = lambda n: 1 + max((depth(p) for p in parents.get(n, ())), default=0)

    def above(n):
        return {n}.union(*[above(p) for p in parents.get(n, ())])

    nodes = sorted({x for e in edges for x in e})
    senses = [(f"w{k % 12}", r.choice(nodes)) for k in range(25)] + [("w0", "unknown")]
    clouds = [(c, r.choice(nodes)) for c in ("x", "x", "x", "y", "y", "z")]
    want = {}
    for w, a in senses:
        for c, b in clouds:
            common = above(a) & above(b) if a in nodes else set()
            if common:
                want[w, c] = max(want.get((w, c), 0), max(2 * depth(n) / (depth(a) + depth(b)) for n in common))
    f = spark.createDataFrame
    sim = C.cloud_similarity(f(senses, "word string, sense string"), f(clouds, "cloud string, sense string"), f(edges, "child string, parent string"))
    got = {(x.word, x.cloud): x.similarity for x in sim.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    tokens = f([(1, "w1"), (1, "w2"), (2, "none"), (3, None), (1, "w1")], "m int, word string")
    feats = {x.m: (x.x, x.y) for x in C.cloud_features(tokens, sim, ["m"], ["x", "y"], least=0.3).collect()}
    mean = lambda c, ws: (lambda v: round(sum(v) / len(v), 9) if v else 0.0)([want[w, c] for w in ws if want.get((w, c), 0) > 0.3])
    assert feats == {1: (mean("x", ["w1", "w2", "w1"]), mean("y", ["w1", "w2", "w1"])), 2: (0.0, 0.0), 3: (0.0, 0.0)}
