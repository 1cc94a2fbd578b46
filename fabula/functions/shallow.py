"""Shallow linguistics as table work: tags by lexicon and suffix, chunks as
runs of tags, subjects and objects by neighbouring chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Closed-class words, suffixes and the tags they point to.
CLOSED = {
    "DT": "the a an this that these those every each some any no",
    "IN": "of in for on with at by from into about over after under between through during without against",
    "PRP": "i you he she it we they me him her us them",
    "PRP$": "my your his its our their",
    "CC": "and or but nor",
    "MD": "can could may might must shall should will would",
    "TO": "to",
    "VBZ": "is has does",
    "VBD": "was were had did",
    "VBP": "are am have do",
    "VB": "be",
    "WP": "who what which whom",
    "RB": "not never always often very too also only here there then now",
    "CD": "one two three four five six seven eight nine ten",
}
SUFFIXES = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ive", "JJ"), ("al", "JJ"), ("est", "JJS"), ("tion", "NN"), ("ness", "NN"), ("ment", "NN"), ("ss", "NN"), ("s", "NNS")]
NOUN, VERB = "NN|NNS|NNP|PRP|CD", "VB|VBZ|VBD|VBG|VBN|VBP|MD"


def universal(tag: Column) -> Column:
    """Coarse part of speech of a tag (LEX1)."""
    return (
        F.when(tag.rlike("^NN"), "noun").when(tag.rlike("^(VB|MD)"), "verb").when(tag.rlike("^JJ"), "adjective").when(tag.rlike("^(RB|WRB)"), "adverb")
        .when(tag.rlike("^(PRP|WP)"), "pronoun").when(tag == "IN", "preposition").when(tag == "DT", "determiner").when(tag == "CC", "conjunction").otherwise("other")
    )


def lexical_tag(word: str) -> Column:
    """Tag of a word on its own."""
    w = F.col(word)
    low = F.lower(w)
    guess = F.lit(None).cast("string")
    for suffix, tag in reversed(SUFFIXES):
        guess = F.when(F.endswith(low, F.lit(suffix)) & (F.length(w) > len(suffix) + 1), tag).otherwise(guess)
    for tag, listed in CLOSED.items():
        guess = F.when(low.isin(*listed.split()), tag).otherwise(guess)
    return F.when(w.rlike(r"^\d"), "CD").when(~w.rlike(r"[\p{L}\p{N}]"), ".").otherwise(F.coalesce(guess, F.when(w.rlike(r"^\p{Lu}"), "NNP").otherwise("NN")))


def tagged(words: DataFrame, word: str, order: list[str], by: list[str], lexicon: DataFrame | None = None) -> DataFrame:
    """Adds ``tag`` (STR11): lexicon, closed classes, capitals, suffixes, noun;
    then a noun after ``to`` or a modal is a verb, and a verb after a
    determiner a noun."""
    guess = lexical_tag(word)
    t = words
    if lexicon is not None:
        t = t.join(lexicon.select(F.col("word").alias("_lw"), F.col("tag").alias("_lt")), F.lower(word) == F.col("_lw"), "left").drop("_lw")
        guess = F.coalesce("_lt", guess)
    t = t.withColumn("_tag", guess)
    before = F.lag("_tag").over(Window.partitionBy(*by).orderBy(*order))
    fixed = F.when(before.isin("TO", "MD") & F.col("_tag").isin("NN", "NNP"), "VB").when((before == "DT") & F.col("_tag").isin("VB", "VBG", "VBD"), "NN")
    return t.withColumn("tag", F.coalesce(fixed, F.col("_tag"))).drop("_tag", "_lt")


def chunks(tokens: DataFrame, by: list[str], order: str) -> DataFrame:
    """Runs of noun-phrase, verb-phrase and preposition tags (STR12): chunk
    number, kind, first and last token, head (the last word)."""
    kind = F.when(F.col("tag").rlike("^(DT|PRP|JJ|NN|CD)"), "NP").when(F.col("tag").rlike("^(MD|VB|RB)"), "VP").when(F.col("tag").isin("IN", "TO"), "PP").otherwise("O")
    w = Window.partitionBy(*by).orderBy(order)
    k = tokens.withColumn("kind", kind)
    starts = (F.lag("kind").over(w).isNull()) | (F.lag("kind").over(w) != F.col("kind")) | ((F.col("tag") == "DT") & (F.col("kind") == "NP"))
    k = k.withColumn("_s", starts.cast("int")).withColumn("chunk", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = k.groupBy(*by, "chunk", "kind").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.max_by("token", order).alias("head"))
    return c.where("kind <> 'O'")


def relations(chunked: DataFrame, by: list[str]) -> DataFrame:
    """The noun phrase right before a verb phrase is its subject, the one right
    after it its object (STR13)."""
    w = Window.partitionBy(*by).orderBy("chunk")
    n = lambda f, c: f(c).over(w)
    v = chunked.withColumns({"pk": n(F.lag, "kind"), "ph": n(F.lag, "head"), "nk": n(F.lead, "kind"), "nh": n(F.lead, "head")}).where("kind = 'VP'")
    return v.select(*by, "chunk", F.col("head").alias("verb"), F.when(F.col("pk") == "NP", F.col("ph")).alias("subject"), F.when(F.col("nk") == "NP", F.col("nh")).alias("object"))


#: Irregular nouns, and nouns in -f or -fe that take -ves; both can be given.
IRREGULAR = {"child": "children", "foot": "feet", "goose": "geese", "louse": "lice", "man": "men", "mouse": "mice", "ox": "oxen", "person": "people", "quiz": "quizzes", "tooth": "teeth", "woman": "women"}
VES = ("calf", "elf", "half", "knife", "leaf", "life", "loaf", "self", "shelf", "thief", "wife", "wolf")
#: Nouns that only look like compounds of those.
REGULAR = ("german", "human", "mongoose", "roman", "shaman", "talisman")
SAME = ("deer", "fish", "series", "sheep", "species")


def rewrite(word: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose pattern fits (STR14)."""
    out = word
    for pattern, to in reversed(rules):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, to)).otherwise(out)
    return out


def listed(word: Column, pairs: dict[str, str]) -> Column:
    """The entry of the word, or of the longest entry that the word ends in:
    ``workman`` goes with ``man``, but ``box`` not with ``ox``. Null where
    there is none."""
    out = F.lit(None).cast("string")
    for one in sorted(pairs, key=lambda x: (len(x), x)):
        stem = F.substr(word, F.lit(1), F.length(word) - len(one))
        hit = F.endswith(word, F.lit(one)) if min(len(one), len(pairs[one])) > 2 else word == one
        out = F.when(hit, F.concat(stem, F.lit(pairs[one]))).otherwise(out)
    regular = [*REGULAR, *[w + "s" for w in REGULAR]]
    return F.when(~word.isin(*regular), out)


def plural(word: Column, irregular: dict[str, str] | None = None) -> Column:
    """Plural of a lower-case noun (STR14). Spelling decides what is not
    listed: -es behind a hiss, -ies for a y behind a consonant, -ses for -sis."""
    known = IRREGULAR if irregular is None else irregular
    ves = {w: w.removesuffix("e").removesuffix("f") + "ves" for w in VES}
    regular = (
        F.when(word.isin(*SAME), word)
        .when(word.rlike("[sx]is$"), F.regexp_replace(word, "is$", "es"))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .when(word.rlike("([^aeiou]|qu)y$"), F.regexp_replace(word, "y$", "ies"))
        .otherwise(F.concat(word, F.lit("s")))
    )
    return F.coalesce(listed(word, known | ves), regular)


def singular(word: Column, irregular: dict[str, str] | None = None) -> Column:
    """Singular of a lower-case plural (STR14), the same spelling backwards."""
    known = IRREGULAR if irregular is None else irregular
    back = {v: k for k, v in known.items()} | {w.removesuffix("e").removesuffix("f") + "ves": w for w in VES}
    regular = (
        F.when(word.isin(*SAME) | word.rlike("(ss|us|is)$"), word)
        .when(word.rlike("[^aeiou]ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(x|ch|sh|ss|zz)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("(aly|the|cri|agno|^oa|^ba)ses$"), F.regexp_replace(word, "es$", "is"))
        .when(word.rlike("s$") & (F.length(word) > 2), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )
    return F.coalesce(listed(word, back), regular)


def lemma(word: Column, tag: Column) -> Column:
    """Base form by part of speech (STR28): singular of nouns, stem of verbs."""
    low = F.lower(word)
    verb = rewrite(low, [("^(is|are|am|was|were)$", "be"), ("^(has|had)$", "have"), ("^(does|did)$", "do"), ("([^aeiou])\\1ing$", "$1"), ("ying$", "y"), ("(...)ing$", "$1"), ("([^aeiou])\\1ed$", "$1"), ("ied$", "y"), ("(..)ed$", "$1"), ("([^s])s$", "$1")])
    return F.when(tag.rlike("^(VB|MD)"), verb).when(tag.rlike("^NN"), singular(low)).otherwise(low)


def sentiment(terms: DataFrame, lexicon: DataFrame, by: list[str], order: str) -> DataFrame:
    """Mean polarity and subjectivity of known words (STR16); a modifier in
    front multiplies by its intensity, a negation by -0.5. Lexicon: word,
    polarity, subjectivity, intensity."""
    w = Window.partitionBy(*by).orderBy(order)
    t = terms.join(lexicon.withColumnRenamed("word", "_w"), F.lower("token") == F.col("_w"), "left")
    prev = lambda c, k=1: F.lag(c, k).over(w)
    no = lambda k: F.coalesce(F.lower(prev("token", k)).isin("not", "no", "never"), F.lit(False))
    t = t.withColumns({"_i": F.coalesce(prev("intensity"), F.lit(1.0)), "_n": F.when(no(1) | no(2), -0.5).otherwise(1.0)})
    clamp = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    p = t.where("polarity is not null").withColumns({"_p": clamp(F.col("polarity") * F.col("_i") * F.col("_n")), "_s": F.least(F.lit(1.0), F.col("subjectivity") * F.col("_i"))})
    return p.groupBy(*by).agg(F.avg("_p").alias("polarity"), F.avg("_s").alias("subjectivity"), F.count(F.lit(1)).alias("known"))


def mood(sentence: Column) -> Column:
    """imperative, conditional, subjunctive or indicative (STR17) by phrases."""
    low = F.lower(sentence)
    return (
        F.when(low.rlike(r"\b(if|were i|wish|as if)\b.*\bwere\b"), "subjunctive").when(low.rlike(r"\b(would|could|should|might|may)\b|\bif\b"), "conditional")
        .when(low.rlike(r"^(please |do |don't |let |go |come |take |give |stop )"), "imperative").otherwise("indicative")
    )


def modality(sentence: Column) -> Column:
    """-1 (unsure) to 1 (sure), the mean weight of the marks met (STR17)."""
    marks = [(1.0, "certainly|surely|definitely|must|always|never|clearly"), (0.5, "will|usually|often|is|are"), (-0.5, "may|might|could|perhaps|maybe|seems?"), (-1.0, "doubt|unlikely|hardly|not sure")]
    hits = [(w, F.regexp_count(F.lower(sentence), F.lit(rf"\b(?:{p})\b"))) for w, p in marks]
    total = sum((n for _, n in hits), F.lit(0))
    return F.when(total == 0, 0.0).otherwise(sum((n * F.lit(w) for w, n in hits), F.lit(0.0)) / total)


# Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000}


def number(text: Column) -> Column:
    """Value of a number in words or digits (STR20); null if a word is none."""
    values = {w: k for k, w in enumerate(ONES)} | {w: 10 * (k + 2) for k, w in enumerate(TENS)}
    table = F.create_map(*[F.lit(x) for w, v in (values | SCALES).items() for x in (w, float(v))])
    parts = F.filter(F.split(F.lower(text), r"[\s-]+|\band\b"), lambda x: x != "")
    zero = F.struct(F.lit(0.0).alias("done"), F.lit(0.0).alias("open"), F.lit(True).alias("fine"))

    def step(a: Column, x: Column) -> Column:
        v = F.coalesce(F.try_element_at(table, x), x.try_cast("double"))
        big = x.isin("thousand", "million")
        return F.struct(
            F.when(big, a["done"] + F.greatest(a["open"], F.lit(1.0)) * v).otherwise(a["done"]).alias("done"),
            F.when(big, 0.0).when(x == "hundred", F.greatest(a["open"], F.lit(1.0)) * 100).otherwise(a["open"] + F.coalesce(v, F.lit(0.0))).alias("open"),
            (a["fine"] & v.isNotNull()).alias("fine"),
        )

    out = F.aggregate(parts, zero, step)
    return F.when(out["fine"] & (F.size(parts) > 0), out["done"] + out["open"])
