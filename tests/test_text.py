import pytest
from pyspark.sql import functions as F

from fabula.functions import shallow
from fabula.functions import text as T


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'array<string>' if isinstance(values[n], list) else 'double'}" for n in names))
    return row.select(column.alias("x")).first()["x"]


def test_tokens_and_words(spark):
    assert one(spark, T.tokens("t"), t="Hello, this is dog.\nHow are you?") == ["Hello", ",", "this", "is", "dog", ".", "How", "are", "you", "?"]
    assert one(spark, T.words("t"), t="L'Été, 2 x!") == ["l", "été", "2", "x"] and one(spark, T.words("t"), t=None) == []


def test_repeats_and_shapes(spark):
    assert one(spark, T.limit_repeats(F.col("t")), t="NIIIICE!!") == "NICE!"
    assert one(spark, T.normalise_spacing(F.col("t")), t="  A \n b ") == "a b" and one(spark, T.normalise_letters(F.col("t")), t="A-b. C1") == "abc1"
    assert one(spark, T.letter_count(F.col("t")), t="a, b!") == 2


def test_ngrams_and_distances(spark):
    assert one(spark, T.ngrams(F.col("w"), 2), w=["a", "b", "c"]) == ["a b", "b c"] and one(spark, T.ngrams(F.col("w"), 4), w=["a", "b"]) == []
    assert one(spark, T.character_ngrams(F.col("t"), 2), t="abc") == ["ab", "bc"] and one(spark, T.character_ngrams(F.col("t"), 4), t="abc") == []
    assert one(spark, T.edit_similarity(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, T.edit_similarity(F.col("a"), F.col("b")), a="", b="") == 1
    assert one(spark, T.dice(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == 0.5


@pytest.mark.parametrize("pattern, hit, miss", [("x*", "xyz", "yx"), ("*x", "yx", "xy"), ("*x*", "axb", "ab"), ("a*b", "a.b", "ab.")])
def test_wildcards(spark, pattern, hit, miss):
    assert one(spark, T.wildcard(F.col("t"), pattern), t=hit) and not one(spark, T.wildcard(F.col("t"), pattern), t=miss)


@pytest.mark.parametrize("one_, many", [("cat", "cats"), ("box", "boxes"), ("city", "cities"), ("wolf", "wolves"), ("mouse", "mice"), ("child", "children"), ("woman", "women"), ("workman", "workmen"), ("knife", "knives"), ("basis", "bases"), ("day", "days"), ("fish", "fish"), ("glass", "glasses"), ("church", "churches"), ("person", "people"), ("human", "humans"), ("ox", "oxen")])
def test_number_of_nouns(spark, one_, many):
    assert one(spark, shallow.plural(F.col("t")), t=one_) == many and one(spark, shallow.singular(F.col("t")), t=many) == one_


@pytest.mark.parametrize("text, value", [("forty-two", 42), ("three hundred and five", 305), ("two thousand ten", 2010), ("7", 7), ("seven cats", None), ("", None)])
def test_number_words(spark, text, value):
    assert one(spark, shallow.number(F.col("t")), t=text) == value


def test_lemma_mood_modality(spark):
    assert one(spark, shallow.lemma(F.col("t"), F.lit("VBG")), t="running") == "run" and one(spark, shallow.lemma(F.col("t"), F.lit("NNS")), t="Houses") == "house"
    assert one(spark, shallow.mood(F.col("t")), t="Please come in.") == "imperative" and one(spark, shallow.mood(F.col("t")), t="It could rain.") == "conditional"
    assert one(spark, shallow.modality(F.col("t")), t="Maybe it is.") == 0 and one(spark, shallow.modality(F.col("t")), t="It must.") == 1


def test_relations(spark):
    rows = [(1, k, w) for k, w in enumerate("the king will give a horse to her".split())]
    tags = shallow.tagged(spark.createDataFrame(rows, "s int, pos int, token string"), "token", ["pos"], ["s"])
    got = shallow.relations(shallow.chunks(tags, ["s"], "pos"), ["s"]).collect()
    assert [(r.verb, r.subject, r.object) for r in got] == [("give", "king", "horse")]


def test_sentiment(spark):
    lexicon = spark.createDataFrame([("good", 0.5, 0.6, 1.0), ("very", None, None, 1.5), ("bad", -0.6, 0.5, 1.0)], "word string, polarity double, subjectivity double, intensity double")
    rows = [(s, k, w) for s, t in ((1, "very good"), (2, "not good"), (3, "bad")) for k, w in enumerate(t.split())]
    got = {r.s: round(r.polarity, 3) for r in shallow.sentiment(spark.createDataFrame(rows, "s int, pos int, token string"), lexicon, ["s"], "pos").collect()}
    assert got == {1: 0.75, 2: -0.25, 3: -0.6}


@pytest.mark.parametrize(
    "word, want",
    [tuple(p.split(":")) for p in "caresses:caress ponies:poni ties:tie cats:cat gas:gas this:this agreed:agre plastered:plaster motoring:motor conflated:conflat hopping:hop hoping:hope happy:happi by:by say:say relational:relat generously:generous communism:communism consistency:consist knightly:knight skies:sky national:nation controlled:control rate:rate fitness:fit vietnamization:vietnam".split()],
)
def test_stems(word, want):
    from fabula.functions.stem import stem

    assert stem(word) == want


def test_probabilities(spark):
    from fabula.functions import probability as P

    assert P.chi_squared_p(1.44, 1) == pytest.approx(0.2301, abs=1e-4) and P.chi_squared_p(6.72, 5) == pytest.approx(0.2423, abs=1e-3)
    assert P.student_p(2.0, 10) == pytest.approx(0.07339, abs=1e-5) and P.normal_cdf(1.96) == pytest.approx(0.975, abs=1e-4)
    assert P.kolmogorov_p(0.5, 100, 100) < 1e-8 and P.kolmogorov_p(0.01, 100, 100) == 1.0
    d = spark.createDataFrame([(1.44, 1), (None, 1)], "x double, df int")
    assert [r.p for r in d.select(P.p_value(P.chi_squared_p, "x", "df").alias("p")).collect()] == [pytest.approx(0.2301, abs=1e-4), None]


def test_fisher_p():
    from math import comb

    from fabula.functions import probability as P

    def exact(a, b, c, d):
        ways = [(k, comb(a + b, k) * comb(c + d, a + c - k)) for k in range(max(0, a - d), min(a + b, a + c) + 1)]
        own = dict(ways)[a]
        return sum(w for _, w in ways if w <= own) / sum(w for _, w in ways)

    for t in [(1, 9, 11, 3), (0, 0, 0, 0), (5, 0, 0, 5), (0, 7, 2, 3), (300, 310, 290, 330), (40, 2, 3, 60)]:
        assert P.fisher_p(*map(float, t)) == pytest.approx(exact(*t), rel=1e-9)
    # Margins of millions: few tables count, and mirrored ones are as likely.
    assert P.fisher_p(3e6, 3e6, 3e6, 3e6) == 1.0
    assert P.fisher_p(3_001_000.0, 2_999_000.0, 2_999_000.0, 3_001_000.0) == pytest.approx(0.2483, abs=1e-3)
