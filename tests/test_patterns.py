"""Word patterns and tag repair against plain versions."""

import random
import re

import pytest

from fabula.operators import patterns as P
from fabula.operators import tagging as T

SCHEMA = "s int, idx int, token string, tag string"


def sentences(seed, n=60):
    r = random.Random(seed)
    return {s: [(r.choice(["a", "the", "big", "dog", "dogs", "of", "ran"]), r.choice(["DT", "JJ", "NN", "NNS", "VBD", "IN"])) for _ in range(r.randrange(0, 12))] for s in range(n)}


def frame(spark, data):
    return spark.createDataFrame([(s, 3 * k, w, t) for s, x in data.items() for k, (w, t) in enumerate(x)], SCHEMA).repartition(3)


def fits(item, token):
    w, t = (x or "" for x in token)
    wild = lambda p, x: re.fullmatch(".*".join(map(re.escape, p.lower().split("*"))), x.lower()) is not None
    return (any(wild(p, w) for p in item.words) or any(wild(p, t) for p in item.tags)) != item.negated


def ends(items, tokens, j, k):
    """(end, items taken) of all matches from item j at token k, in order of preference."""
    if j == len(items):
        yield k, ()
        return
    if k < len(tokens) and fits(items[j], tokens[k]):
        for further in ([j] if items[j].multiple else []) + [j + 1]:
            for e, rest in ends(items, tokens, further, k + 1):
                yield e, (j, *rest)
    if items[j].optional:
        yield from ends(items, tokens, j + 1, k)


def plain(pattern, data):
    """All starts, all ways: the leftmost start, of its ways the longest, of
    these the one that is preferred first."""
    p, out = P.compiled(pattern), []
    for s, tokens in data.items():
        k, m = 0, 0
        while k < len(tokens):
            ways = [w for w in every(p.items, tokens, k) if w[0] > k]
            if not ways:
                k += 1
                continue
            e = max(w[0] for w in ways)
            taken = next(w[1] for w in ways if w[0] == e)
            at = {j: [k + n for n, x in enumerate(taken) if x == j] for j in set(taken)}
            groups = [sorted(x for j in range(a, b + 1) for x in at.get(j, [])) for a, b in p.groups]
            out.append((s, m, 3 * k, 3 * (e - 1), list(taken), [(3 * g[0], 3 * g[-1]) if g else (None, None) for g in groups]))
            k, m = e, m + 1
    return sorted(out)


def every(items, tokens, k):
    # After a repeating item, its further turns are optional.
    def from_(j, k, again):
        if j == len(items):
            yield k, ()
            return
        if k < len(tokens) and fits(items[j], tokens[k]):
            if items[j].multiple:
                for e, rest in from_(j, k + 1, True):
                    yield e, (j, *rest)
            for e, rest in from_(j + 1, k + 1, False):
                yield e, (j, *rest)
        if items[j].optional and not again:
            yield from from_(j + 1, k, False)

    return from_(0, k, False)


@pytest.mark.parametrize("pattern", ["NN", "DT NN|NNS", "(DT) {JJ+} {NN|NNS}", "(DT) (JJ)+ NN|NNS (of {(DT) NN})", "dog|*s !IN", "!DT+ of", "{(JJ)+ {NN+}} (VBD)", "(a) (a) a", "JJ+ JJ"])
def test_matches_equal_plain_search(spark, pattern):
    if "(of" in pattern:
        with pytest.raises(ValueError):
            P.compiled("(DT) } x")
        pattern = "(DT) (JJ)+ NN|NNS (of) {(DT) NN}"
    data = sentences(len(pattern)) | {99: [], 100: [(None, "NN"), ("dog", None), (None, None)]}
    got = sorted((r.s, r.match, r.first, r.last, list(r["items"]), [tuple(g) for g in r.groups]) for r in P.search(frame(spark, data), pattern, ["s"], "idx").collect())
    want = plain(pattern, data)
    assert want and got == want


def test_bad_patterns():
    for bad in ["", "(a) (b)", "{a", "a }", "|", "()"]:
        with pytest.raises(ValueError):
            P.compiled(bad)


LEXICAL = ["ly hassuf 2 RB x", "NN s fhassuf 1 NNS x", "NNS ss fhassuf 2 NN x", "un deletepref 2 JJ x", "ed deletesuf 2 VBD x", "re addpref 2 VB x", "s addsuf 1 NN x", "big word 3 JJ x", "- char 1 JJ x", "NN the fgoodright 3 NNP x", "RB of fgoodleft 2 IN x", "pre haspref 3 XX x"]
CONTEXT = ["NN VB PREVTAG TO", "VB NN PREV1OR2TAG DT", "* JJ SURROUNDTAG DT NN", "NN NNS CURWD dogs", "JJ RB NEXTWD ran", "* IN WDPREVTAG NN of", "VBD VBN PREV1OR2OR3TAG VBZ", "NNS NN RBIGRAM dogs ran", "JJ NN NEXTBIGRAM IN DT", "DT X WDAND2AFT a big", "NN Y WDAND2TAGBFR JJ dog", "Y Z PREVBIGRAM DT JJ", "* Q NEXT1OR2WD the", "Q R LBIGRAM big dog", "IN S WDAND2TAGAFT of NN", "NN U NEXT1OR2OR3WD of", "U V PREV1OR2OR3WD a"]


def plain_lexical(rules, words, known):
    out = []
    for k, (w, tag) in enumerate(words):
        prev, nxt = words[k - 1][0] if k else None, words[k + 1][0] if k + 1 < len(words) else None
        for line in rules:
            p = line.split()
            f = p[2].startswith("f") and p[2][1:] in T.LEXICAL and p[1] not in T.LEXICAL
            only, x, cmd = (p[0], p[1], p[2][1:]) if f else (None, p[0], p[1])
            if only and only != tag:
                continue
            hit = {"word": w == x, "char": x in w, "haspref": w.startswith(x), "hassuf": w.endswith(x), "addpref": x + w in known, "addsuf": w + x in known, "deletepref": w.startswith(x) and w[len(x) :] in known, "deletesuf": w.endswith(x) and w[: -len(x)] in known, "goodleft": nxt == x, "goodright": prev == x}[cmd]
            tag = p[-2] if hit else tag
        out.append(tag)
    return out


def plain_context(rules, words):
    t = [("", "")] * 3 + [list(x) for x in words] + [("", "")] * 3
    for i in range(3, len(t) - 3):
        for line in rules:
            only, new, cmd, x, y = (line.split() + [""])[:5]
            if t[i][1] != only and only != "*":
                continue
            look = lambda spec: t[i + int(spec[:-1])][0 if spec[-1] == "w" else 1]  # noqa: E731, B023
            xs, _, ys = T.CONTEXT[cmd.lower()].partition(",")
            if any(look(s) == x for s in xs.split()) and (not ys or look(ys) == y):
                t[i] = (t[i][0], new)
    return [tag for _, tag in t[3:-3]]


def words_of(seed):
    r = random.Random(seed)
    vocabulary = ["dog", "dogs", "of", "the", "a", "big", "ran", "happily", "glass", "unhappy", "walked", "do", "well-known", "prefix", "to"]
    return {s: [(r.choice(vocabulary), r.choice(["NN", "NN", "VB", "DT", "JJ", "TO", "IN", "VBD", "VBZ", "NNS", "RB"])) for _ in range(r.randrange(1, 11))] for s in range(50)}


def tags(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.s, r.idx)):
        out.setdefault(r.s, []).append(r.tag)
    return out


def test_lexical_rules_in_order(spark):
    data, known = words_of(1), ["happy", "walk", "redo", "dogs"]
    lexicon = spark.createDataFrame([(w,) for w in known], "word string")
    got = tags(T.by_morphology(frame(spark, data), LEXICAL, ["s"], "idx", lexicon))
    assert got == {s: plain_lexical(LEXICAL, x, set(known)) for s, x in data.items()}
    got = tags(T.by_morphology(frame(spark, data), LEXICAL, ["s"], "idx"))
    assert got == {s: plain_lexical(LEXICAL, x, set()) for s, x in data.items()}


def test_context_rules_see_repaired_tags_on_the_left(spark):
    data = words_of(2)
    df = frame(spark, data)
    out = T.by_context(df, CONTEXT, ["s"], "idx")
    assert out.columns == df.columns
    got, want = tags(out), {s: plain_context(CONTEXT, x) for s, x in data.items()}
    assert got == want and want != {s: [t for _, t in x] for s, x in data.items()}


def test_bad_rules():
    for bad in ["x", "ly nosuch 2 RB x"]:
        with pytest.raises(ValueError):
            T.lexical_rules([bad])
    with pytest.raises(ValueError):
        T.context_rules(["NN VB NOSUCH TO"])


def test_entities_longest_first_without_overlap(spark):
    names = [("Alexander the Great", "pers"), ("Alexander", "pers"), ("the Great Wall", "loc"), ("great wall", None), ("Acme", "org"), ("Acme", "loc"), ("  ", "x")]
    entities = spark.createDataFrame(names, "name string, kind string")
    text = "Alexander the Great Wall saw ALEXANDER at the Great Wall of acme mail a.b@cd.org http://x great wall Alexander the"
    data = {1: [(w, "NNP-X" if w == "acme" else "NN") for w in text.split()], 2: [("x", None), ("alexander", None)]}
    got = tags(T.with_entities(frame(spark, data), entities, ["s"], "idx"))
    assert got[2] == [None, "NNP-PERS"]
    assert got[1] == ["NNP-PERS"] * 3 + ["NN", "NN", "NNP-PERS", "NN", "NNP-LOC", "NNP-LOC", "NNP-LOC", "NN", "NNP-X-LOC", "NN", "NNP", "NNP", "NNP", "NNP", "NNP-PERS", "NN"]
    assert T.with_entities(frame(spark, data), entities.limit(0), ["s"], "idx").count() == len(data[1]) + 2


def test_names_of_many_sizes(spark, monkeypatch):
    """Names meet their places as a whole: the first word can be a common one."""
    text = "the a b the a the a b c d the x the a b c".split()
    rows = spark.createDataFrame([(1, i, w, "LOW") for i, w in enumerate(text)], "s long, idx int, token string, tag string")
    names = ["the a", "the a b c", "the a b c d e", "the x", "c", "the a b c d"]
    entities = spark.createDataFrame([(n, "loc") for n in names], "name string, kind string")
    named = []
    for few in (0, 10):
        monkeypatch.setattr(T, "FEW_SIZES", few)
        got = T.with_entities(rows, entities, ["s"], "idx")
        named.append([r.idx for r in got.where("tag = 'NNP-LOC'").orderBy("idx").collect()])
    assert named[0] == named[1] == [0, 1, *range(3, 5), *range(5, 10), *range(10, 12), *range(12, 16)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (_e" in plan and "[0] = _first" not in plan
