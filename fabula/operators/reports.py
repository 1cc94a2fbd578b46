"""Corpus reports: statistics of groups, verbs, quotes and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_statistics(mentions: DataFrame) -> DataFrame:
    """Entities, characters, mentions, groups, symbols per group and groups per
    symbol of each document (AGG2, JN6). mentions: doc_id, mention_id, grp,
    symbol, character."""
    pairs = mentions.where("symbol is not null").select("doc_id", "grp", "symbol").distinct()
    per_group = pairs.groupBy("doc_id", "grp").agg(F.count(F.lit(1)).alias("k")).groupBy("doc_id").agg(F.avg("k").alias("symbols_per_group"))
    per_symbol = pairs.groupBy("doc_id", "symbol").agg(F.count(F.lit(1)).alias("k")).groupBy("doc_id").agg(F.avg("k").alias("groups_per_symbol"))
    base = mentions.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("grp").alias("groups"), F.countDistinct("symbol").alias("symbols"), F.countDistinct(F.when(F.col("character"), F.col("symbol"))).alias("characters")
    )
    return base.join(per_group, "doc_id", "left").join(per_symbol, "doc_id", "left")


def characters_of_groups(mentions: DataFrame) -> DataFrame:
    """Distinct character symbols of each group (AGG3)."""
    return mentions.groupBy("doc_id", "grp").agg(
        F.countDistinct(F.when(F.col("character"), F.col("symbol"))).alias("characters"), F.bool_or("character").alias("has_character")
    )


def own_group(mentions: DataFrame, groups: DataFrame) -> DataFrame:
    """Group of each mention, its own id by default (JN7)."""
    return mentions.join(groups, ["doc_id", "mention_id"], "left").withColumn("grp", F.coalesce("grp", "mention_id"))


def before_and_after(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Sums and means of two versions side by side (AGG19)."""
    tag = lambda d, t: d.select(F.lit(t).alias("version"), *columns)
    both = tag(before, "before").unionByName(tag(after, "after"))
    return both.groupBy("version").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("sum", F.sum), ("mean", F.avg))])


def signal_verbs(hints: DataFrame) -> DataFrame:
    """Most frequent verbs of speech hints (AGG22)."""
    verb = F.lower(F.trim(F.split("hint", "[<>]")[0]))
    return hints.select(verb.alias("verb")).where("verb <> ''").groupBy("verb").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "verb")


def verb_report(verbs: DataFrame, classes: DataFrame) -> DataFrame:
    """Verbs with their class, counts and number of functions (AGG23)."""
    from fabula.operators.lexicon import mapped

    n = verbs.groupBy("lemma").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("functions"))
    return mapped(n, classes, "lemma").orderBy(F.desc("n"), "lemma")


def dialogue_totals(seq: DataFrame, in_quotes: DataFrame) -> DataFrame:
    """Counts of sequence classes, and of mentions inside quotes (AGG18)."""
    a = seq.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    b = in_quotes.groupBy(F.concat(F.lit("quoted "), "kind").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return a.union(b)


def verb_totals(verbs: DataFrame, args: DataFrame) -> DataFrame:
    """Number of verbs and of independent arguments (AGG48)."""
    v = verbs.agg(F.count(F.lit(1)).alias("verbs"))
    return v.crossJoin(args.where("is_independent").agg(F.count(F.lit(1)).alias("arguments")))  # one row each


def summed_by_rule(parts: DataFrame, counters: list[str]) -> DataFrame:
    """Counters of each rule over all stories (AGG17)."""
    return parts.groupBy("rule").agg(*[F.sum(c).alias(c) for c in counters])


def label_summary(functions: DataFrame) -> DataFrame:
    """Ordered labels of each document in one string (AGG50)."""
    o = F.transform(F.array_sort(F.collect_list(F.struct("offset", "label"))), lambda x: x["label"])  # a story's functions
    return functions.groupBy("doc_id").agg(F.array_join(o, " ").alias("labels"))


def reference_check(refs: DataFrame, known: DataFrame, kind: str, key: list[str]) -> DataFrame:
    """Counts of references that nothing resolves (JN10, AGG21)."""
    return refs.join(known.select(*key).distinct(), key, "left_anti").agg(F.lit(kind).alias("check"), F.count(F.lit(1)).alias("n"))


def form_strings(mentions: DataFrame) -> DataFrame:
    """Speech with speaker and listener as one string (STR23-STR25)."""
    return mentions.withColumn("shown", F.concat_ws(" ", "text", F.concat(F.lit("["), F.coalesce("speaker", F.lit("?")), F.lit(">"), F.coalesce("listener", F.lit("?")), F.lit("]"))))


def continuations(starts: DataFrame, truths: DataFrame, generated: DataFrame) -> DataFrame:
    """Start, true continuation and generated text of each story (JN16)."""
    t = truths.select("story", F.col("text").alias("truth"))
    g = generated.select("story", "source", F.col("text").alias("generated"))
    return starts.select("story", F.col("text").alias("start")).join(t, "story").join(g, "story", "left")


def parameter_sweep(grid: DataFrame, evaluate, names: list[str]) -> DataFrame:
    """Results of ``evaluate(**parameters)`` for a small grid (CLS14, SEQ11)."""
    out = None
    for r in grid.select(*names).distinct().orderBy(*names).collect():  # the grid
        values = r.asDict()
        one = evaluate(**values)
        one = one.select(*[F.lit(v).alias(k) for k, v in values.items()], *one.columns)
        out = one if out is None else out.unionByName(one)
    return out


def refined(mentions: DataFrame, link, classify, rounds: int) -> DataFrame:
    """The iterative loop (CLS16): links make groups, groups vote, labels feed
    the next links. ``link`` and ``classify`` map mentions to mentions."""
    from fabula.operators.evaluate import vote_by_group
    from fabula.session import cut

    for _ in range(rounds):
        m = classify(link(mentions)).withColumn("_g", F.struct("doc_id", "grp"))
        vote = vote_by_group(m, "_g", "label").select("_g", F.col("label").alias("_voted"))
        mentions = cut(m.join(vote, "_g", "left").withColumn("label", F.coalesce("_voted", "label")).drop("_voted", "_g"))
    return mentions


def ranked_by_frequency(values: DataFrame, column: str, top: int) -> DataFrame:
    """The most frequent values with their rank (AGG49)."""
    n = values.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(top)
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), column)))  # top rows
