"""Narrative functions, story frames, retrieval and survey reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.operators import sequences

# Prefixes of function labels, in the order they are tried.
PREFIXES = ["depart", "return", "theta", "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "mu", "nu", "xi", "pi", "rho", "sigma"]
ALIASES = {"d": "D", "lambda": "theta", "up": "depart", "down": "return"}


def function_label(raw: Column) -> Column:
    """A label without marks and numbers, aliases resolved (SEQ14)."""
    c = F.regexp_replace(F.trim(raw), r"^\?", "")
    base = F.regexp_extract(c, r"^([A-Za-z]+?)(?:[\d\-_'].*)?$", 1)
    out = F.when(base == "", c).otherwise(base)
    for p in reversed(PREFIXES):
        out = F.when(F.startswith(c, F.lit(p)), p).otherwise(out)
    for a, b in ALIASES.items():
        out = F.when(c.rlike(rf"^{a}($|[\d\-_'])"), b).otherwise(out)
    return out


def is_implicit(raw: Column) -> Column:
    return F.startswith(raw, F.lit("?"))


def paired(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counterpart of each label, itself where none is named (SEQ14)."""
    return labels.join(pairs, "label", "left").withColumn("counterpart", F.coalesce("counterpart", "label"))


def spans_of_runs(rows: DataFrame, story: str = "story_id") -> DataFrame:
    """Runs of equal function labels as one span (SRC24, AGG24): offsets from
    the first to the last row, implicit if any row is."""
    r = rows.withColumn("_label", function_label(F.col("function"))).withColumn("_order", F.col("offset"))
    w = Window.partitionBy(story).orderBy("offset")
    new = F.when(F.lag("_label").over(w).eqNullSafe(F.col("_label")), 0).otherwise(1)
    r = r.withColumn("_n", new).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(story, "run", F.col("_label").alias("label")).agg(
        F.min("offset").alias("offset"), (F.max(F.col("offset") + F.col("len")) - F.min("offset")).alias("len"), F.bool_or(is_implicit(F.col("function"))).alias("implicit"), F.count(F.lit(1)).alias("rows")
    )


def merged_by_first_letter(steps: DataFrame, story: str, order: str, label: str) -> DataFrame:
    """Neighbours whose labels begin alike become one (WIN17)."""
    return sequences.runs(steps.withColumn("_first", F.substring(label, 1, 1)), story, [order], "_first")


def role_shares(functions: DataFrame | None, mentions: DataFrame, roles: list[str], *, unique: bool = False) -> DataFrame:
    """Share of each role among the distinct mentions of a function (AGG6).
    mentions: doc_id, fn_id, mention_id, role; ``unique``: no row comes twice.
    Without ``functions`` those that have mentions."""
    m = mentions.select("doc_id", "fn_id", "mention_id", "role")
    m = m if unique else m.distinct()  # so a role's mentions need only be counted
    wide = m.groupBy("doc_id", "fn_id").agg(*[F.count(F.when(F.col("role") == r, F.col("mention_id"))).alias(r) for r in roles])
    total = sum((F.col(f"`{r}`") for r in roles), F.lit(0))
    j = wide if functions is None else functions.select("doc_id", "fn_id").join(wide, ["doc_id", "fn_id"], "left").na.fill(0, roles)
    return j.select("doc_id", "fn_id", *[F.when(total == 0, 0.0).otherwise(F.col(f"`{r}`") / total).alias(r) for r in roles])


def class_flags(function_verbs: DataFrame, classes: DataFrame, names: list[str]) -> DataFrame:
    """One-hot verb classes of each function (AGG7, JN17)."""
    hit = function_verbs.join(classes.withColumnRenamed("word", "lemma"), "lemma")
    return function_verbs.select("doc_id", "fn_id").distinct().join(hit.groupBy("doc_id", "fn_id").pivot("class", names).agg(F.max(F.lit(1.0))), ["doc_id", "fn_id"], "left").na.fill(0.0, names)


def positions(functions: DataFrame, docs: DataFrame) -> DataFrame:
    """Middle of each function divided by the text's length (AGG8)."""
    d = docs.select("doc_id", F.length("text").alias("_n"))
    return functions.join(d, "doc_id").withColumn("position", F.when(F.col("_n") > 0, (F.col("offset") + F.col("len") / 2) / F.col("_n"))).drop("_n")


def frames(verbs: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity and verb frames per phase without repeats (FRM1): story, phase,
    kind, head, args, name. verbs: story, phase, lemma, subject, object;
    entities: story, phase, entity, type."""
    e = entities.select("story", "phase", F.lit("entity").alias("kind"), F.col("type").alias("head"), F.array("entity").alias("args")).distinct()
    args = F.filter(F.array("subject", "object"), lambda x: x.isNotNull())
    v = verbs.select("story", "phase", F.lit("expression").alias("kind"), F.col("lemma").alias("head"), args.alias("args")).distinct()
    w = Window.partitionBy("story").orderBy("phase", "kind", "head", F.array_join("args", ","))
    return e.union(v).withColumn("name", F.concat(F.lit("e"), F.row_number().over(w).cast("string")))


def first_phases(f: DataFrame, n: int | None) -> DataFrame:
    """Frames of the first n phases, all for None (FRM2)."""
    return f if n is None else f.where(F.col("phase") <= n)


def without_heads(f: DataFrame, heads: list[str]) -> DataFrame:
    return f.where(~F.col("head").isin(*heads))  # FLT22


def retrieve(similar: DataFrame, k: int, excluded: DataFrame | None = None) -> DataFrame:
    """The k stories of the best instantiation for each probe (TOP6): similar
    has probe, story, instance and score."""
    best = similar.groupBy("probe", "story").agg(F.max("score").alias("score"))
    if excluded is not None:
        best = best.join(excluded, ["probe", "story"], "left_anti")
    w = Window.partitionBy("probe").orderBy(F.desc("score"), "story")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def random_scores(pairs: DataFrame, seed: int) -> DataFrame:
    """A random baseline for ``retrieve`` (TOP13), fixed by the seed."""
    return pairs.withColumn("score", F.pmod(F.xxhash64("probe", "story", F.lit(seed)), F.lit(1_000_003)) / 1_000_003)


def distractors(stories: DataFrame, k: int, seed: int) -> DataFrame:
    """k other stories for each story, by hash (TOP11). Candidates are the
    next ones on a ring of hashes, so nothing is crossed."""
    w = Window.orderBy("_h", "story")
    ring = stories.select("story").distinct().withColumn("_h", F.xxhash64("story", F.lit(seed))).withColumn("_r", F.row_number().over(w) - 1)
    n = ring.agg(F.count(F.lit(1)).alias("_n"))
    probe = ring.crossJoin(F.broadcast(n)).select("story", "_r", "_n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("pick"))  # one row
    at = probe.where("pick < _n").withColumn("_at", F.pmod(F.col("_r") + F.col("pick"), F.col("_n")))
    return at.join(ring.select(F.col("story").alias("other"), F.col("_r").alias("_at")), "_at").select("story", "pick", "other")


def concept_classes(c: DataFrame) -> DataFrame:
    """term and head: the least term with the same set of concepts. Pairs are
    then compared between heads, so a concept that most terms have is not
    paired out for each of them."""
    held = c.distinct().groupBy("term").agg(F.array_sort(F.collect_set(F.struct("relation", "concept"))).alias("held"))
    heads = held.groupBy("held").agg(F.min("term").alias("head"))
    return held.join(heads, "held").select("term", "head")


def concept_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared concepts over all concepts of two terms, relation by relation
    (SET8): term, relation, concept; result left, right, similarity."""
    left, right = a.select(F.col("term").alias("l"), "relation", "concept").distinct(), b.select(F.col("term").alias("r"), "relation", "concept").distinct()
    both = left.join(right, ["relation", "concept"]).groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))
    nl, nr = left.groupBy("l").agg(F.count(F.lit(1)).alias("nl")), right.groupBy("r").agg(F.count(F.lit(1)).alias("nr"))
    return both.join(nl, "l").join(nr, "r").select(F.col("l").alias("left"), F.col("r").alias("right"), (F.col("n") / (F.col("nl") + F.col("nr") - F.col("n"))).alias("similarity"))


def best_match_similarity(sets_a: DataFrame, sets_b: DataFrame, terms: DataFrame) -> DataFrame:
    """2 * sum of best matches / (n1 + n2), over the smaller set (SET9). sets:
    id, term; terms: left, right, similarity."""
    na, nb = sets_a.groupBy("id").agg(F.count(F.lit(1)).alias("na")), sets_b.groupBy("id").agg(F.count(F.lit(1)).alias("nb"))
    j = sets_a.select(F.col("id").alias("a"), F.col("term").alias("left")).join(terms, "left").join(sets_b.select(F.col("id").alias("b"), F.col("term").alias("right")), "right")
    by_a = j.groupBy("a", "b", "left").agg(F.max("similarity").alias("s")).groupBy("a", "b").agg(F.sum("s").alias("sa"))
    by_b = j.groupBy("a", "b", "right").agg(F.max("similarity").alias("s")).groupBy("a", "b").agg(F.sum("s").alias("sb"))
    k = by_a.join(by_b, ["a", "b"]).join(na.withColumnRenamed("id", "a"), "a").join(nb.withColumnRenamed("id", "b"), "b")
    return k.select("a", "b", (2 * F.when(F.col("na") <= F.col("nb"), F.col("sa")).otherwise(F.col("sb")) / (F.col("na") + F.col("nb"))).alias("similarity"))


def survey_report(answers: DataFrame, sources: DataFrame, least_checks: int = 5, least_minutes: float = 5.0) -> DataFrame:
    """Ratings and issues by story, source and both (AGG40). answers: uid,
    minutes, checks, story, place, rating, issue (y, n, a); sources: uid,
    story, place, source. Careless answers go first."""
    careful = answers.where((F.col("checks") >= least_checks) & (F.col("minutes") >= least_minutes))
    j = careful.join(sources, ["uid", "story", "place"])
    issue = F.when(F.col("issue") == "y", 1).when(F.col("issue") == "n", -1).when(F.col("issue") == "a", 0)
    g = j.groupingSets([["story", "source"], ["story"], ["source"]], "story", "source")
    return g.agg(F.count("rating").alias("ratings"), F.avg("rating").alias("mean"), F.stddev_samp("rating").alias("deviation"), F.sum(issue).alias("issues"), F.count_if(F.col("rating").isNull()).alias("missing"))


def argument_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Verbs matched by token, arguments once each (AGG13): an argument is a
    verb's slot and token, so distinct rows are the one-to-one match."""
    v = lambda d: d.select("doc_id", "token_id").distinct()
    a = lambda d: d.select("doc_id", "token_id", "slot", "arg").where("arg is not null").distinct()
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    parts = [
        count(v(predicted).join(v(gold), ["doc_id", "token_id"]), "verbs_hit"), count(v(predicted), "verbs_predicted"), count(v(gold), "verbs_gold"),
        count(a(predicted).join(a(gold), ["doc_id", "token_id", "slot", "arg"]), "args_hit"), count(a(predicted), "args_predicted"), count(a(gold), "args_gold"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def rule_windows(tokens: DataFrame, by: list[str], pos: str, cls: str, anchor: str, reach: int) -> DataFrame:
    """Windows of classes around each anchor token become rules (SEQ16): rule,
    n. All windows of up to ``reach`` tokens to either side."""
    w = Window.partitionBy(*by).orderBy(pos)
    around = tokens.select(F.col(cls).alias("_c"), *[(F.lag(cls, k) if k > 0 else F.lead(cls, -k)).over(w).alias(f"w{k + reach}") for k in range(-reach, reach + 1) if k])
    hit = around.where(F.col("_c") == anchor)
    rules = []
    for a in range(reach + 1):
        for b in range(reach + 1):
            parts = [f"w{k + reach}" for k in range(a, 0, -1)] + ["_c"] + [f"w{reach - k}" for k in range(1, b + 1)]
            whole = F.lit(True)
            for p in parts:
                whole = whole & F.col(p).isNotNull()
            rules.append(F.when(whole, F.concat_ws(" ", *parts)))
    return hit.select(F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def generalised(rules: DataFrame, keep: str) -> DataFrame:
    """Variants of a rule in which items other than ``keep`` are optional, one
    at a time (SEQ17)."""
    items = F.split("rule", " ")
    variants = F.transform(items, lambda x, i: F.when(x != keep, F.array_join(F.transform(items, lambda y, j: F.when(i == j, F.concat(y, F.lit("?"))).otherwise(y)), " ")))
    return rules.select(F.explode(F.array_distinct(F.concat(F.array("rule"), F.filter(variants, lambda x: x.isNotNull())))).alias("rule")).distinct()


def weighted_vote(votes: DataFrame, weights: DataFrame, item: list[str], method: str = "weight") -> DataFrame:
    """Picks a speaker for each item (SEQ18): ``top`` takes the vote of the
    best rule, ``weight`` sums weights, ``bayes`` log-odds, ``counter`` counts."""
    j = votes.join(weights, "rule")
    gain = {"top": F.max("weight"), "weight": F.sum("weight"), "bayes": F.sum(F.log(F.col("weight") / (1 - F.col("weight")))), "counter": F.count(F.lit(1))}[method]
    s = j.groupBy(*item, "vote").agg(F.round(gain.cast("double"), 9).alias("score"))
    w = Window.partitionBy(*item).orderBy(F.desc("score"), "vote")
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sampled_paths(labels: DataFrame, n: int, steps: int, seed: int) -> DataFrame:
    """n random label paths by cumulative shares and hashes (SEQ10). labels:
    label, p."""
    w = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    c = labels.withColumn("hi", F.sum("p").over(w)).withColumn("lo", F.col("hi") - F.col("p"))  # a row per label
    draws = labels.sparkSession.range(n).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    draws = draws.withColumn("u", F.pmod(F.xxhash64("path", "step", F.lit(seed)), F.lit(1_000_003)) / 1_000_003)
    return draws.join(F.broadcast(c), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("path", "step", "label")  # labels only


def guessed_language(words: DataFrame, lexicons: DataFrame, by: list[str]) -> DataFrame:
    """The language that knows the largest share of words (STR19). words: by,
    word; lexicons: word, lang."""
    n = words.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    known = words.join(lexicons, "word").groupBy(*by, "lang").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by).orderBy(F.desc("k"), "lang")
    best = known.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return n.join(best, by, "left").select(*by, "lang", F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)).alias("share"))
