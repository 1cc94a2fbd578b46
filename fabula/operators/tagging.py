"""Repair of tags by ordered rules, and entities of one or many words.

Rules are tables of any length that are folded inside Spark: a later rule sees
what an earlier one changed, and in a sentence a token sees the repaired tags
to its left. Lexicons and entity lists are tables joined by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Commands of morphological rules, with f in front: only for a tag.
LEXICAL = ("word", "char", "haspref", "hassuf", "addpref", "addsuf", "deletepref", "deletesuf", "goodleft", "goodright")
#: Commands of contextual rules, and what they look at: places
#: from the token, w(ord) or t(ag), for x and, behind a comma, for y.
CONTEXT = {
    "prevtag": "-1t", "nexttag": "+1t", "prev2tag": "-2t", "next2tag": "+2t", "prev1or2tag": "-1t -2t", "next1or2tag": "+1t +2t",
    "prev1or2or3tag": "-1t -2t -3t", "next1or2or3tag": "+1t +2t +3t", "surroundtag": "-1t,+1t", "curwd": "0w", "prevwd": "-1w", "nextwd": "+1w",
    "prev1or2wd": "-1w -2w", "next1or2wd": "+1w +2w", "prev1or2or3wd": "-1w -2w -3w", "next1or2or3wd": "+1w +2w +3w", "prevwdtag": "-1w,-1t", "nextwdtag": "+1w,+1t",
    "wdprevtag": "-1t,0w", "wdnexttag": "0w,+1t", "wdand2aft": "0w,+2w", "wdand2tagbfr": "-2t,0w", "wdand2tagaft": "0w,+2t",
    "lbigram": "-1w,0w", "rbigram": "0w,+1w", "prevbigram": "-2t,-1t", "nextbigram": "+1t,+2t",
}


def lexical_rules(lines: list[str]) -> list[tuple[str, str, str, str]]:
    """(tag or '', affix, command, new tag) of lines such as ``ly hassuf 2 RB x``
    and ``NN s fhassuf 1 NNS x``."""
    out = []
    for line in lines:
        p = line.split()
        if len(p) > 2 and p[1].lower() in LEXICAL:
            out.append(("", p[0], p[1].lower(), p[-2]))
        elif len(p) > 3 and p[2].lower().removeprefix("f") in LEXICAL:
            out.append((p[0], p[1], p[2].lower().removeprefix("f"), p[-2]))
        else:
            raise ValueError(f"no morphological rule: {line!r}")
    return out


def context_rules(lines: list[str]) -> list[tuple[str, str, str, str, str]]:
    """(tag or *, new tag, command, x, y) of lines such as ``VBD VB PREVTAG TO``."""
    out = []
    for line in lines:
        p = line.split()
        if len(p) < 4 or p[2].lower() not in CONTEXT:
            raise ValueError(f"no contextual rule: {line!r}")
        out.append((p[0], p[1], p[2].lower(), p[3], p[4] if len(p) > 4 else ""))
    return out


def rule_array(rules: list[tuple], names: list[str]) -> Column:
    kind = f"array<struct<{','.join(f'{n}:string' for n in names)}>>"
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rules]).cast(kind)


def by_morphology(tokens: DataFrame, rules: list[str], by: list[str], order: str, known: DataFrame | None = None) -> DataFrame:
    """``tokens`` with ``tag`` repaired by affix and neighbour-word rules, in
    order. ``known`` (word): the lexicon of the rules that add or take away an
    affix; it is joined by the few forms that they make of each distinct word."""
    parsed = lexical_rules(rules)
    w = Window.partitionBy(*by).orderBy(order)
    t = tokens.withColumns({"_next": F.lead("token").over(w), "_prev": F.lag("token").over(w)})
    affix = sorted({(c, x) for _, x, c, _ in parsed if c in ("addpref", "addsuf", "deletepref", "deletesuf")})
    word = F.col("token")

    def form(command: str, x: str) -> Column:
        if command == "addpref":
            return F.concat(F.lit(x), word)
        if command == "addsuf":
            return F.concat(word, F.lit(x))
        if command == "deletepref":
            return F.when(F.startswith(word, F.lit(x)), F.substring(word, len(x) + 1, 1 << 30))
        return F.when(F.endswith(word, F.lit(x)), F.substr(word, F.lit(1), F.length(word) - len(x)))

    if affix and known is not None:
        forms = F.array(*[F.struct(F.lit(f"{c} {x}").alias("key"), form(c, x).alias("form")) for c, x in affix])
        made = t.select("token").distinct().select("token", F.explode(forms).alias("f")).select("token", "f.*").where("form is not null")
        hits = made.join(known.select(F.col("word").alias("form")).distinct(), "form", "left_semi").groupBy(F.col("token").alias("_w")).agg(F.collect_set("key").alias("_known"))  # a rule's forms
        t = t.join(hits, F.col("token") == F.col("_w"), "left").drop("_w")
    else:
        t = t.withColumn("_known", F.lit(None).cast("array<string>"))
    t = t.withColumn("_rules", rule_array(parsed, ["only", "x", "cmd", "to"]))

    def step(tag: Column, r: Column) -> Column:
        x, cmd = r["x"], r["cmd"]
        hit = (
            F.when(cmd == "word", word == x).when(cmd == "char", F.contains(word, x)).when(cmd == "haspref", F.startswith(word, x)).when(cmd == "hassuf", F.endswith(word, x))
            .when(cmd == "goodleft", F.col("_next") == x).when(cmd == "goodright", F.col("_prev") == x)
            .otherwise(F.array_contains("_known", F.concat(cmd, F.lit(" "), x)))
        )
        return F.when(((r["only"] == "") | (r["only"] == tag)) & F.coalesce(hit, F.lit(False)), r["to"]).otherwise(tag)

    out = t.withColumn("tag", F.aggregate("_rules", F.col("tag"), step))
    return out.select(*tokens.columns)


def by_context(tokens: DataFrame, rules: list[str], by: list[str], order: str) -> DataFrame:
    """``tokens`` with ``tag`` repaired by rules on words and tags up to three
    places away. A sentence is one row while it is folded, in the order of
    ``order``; where that is null or repeated, rows come in order of token and
    tag. Nothing stands before and behind a sentence."""
    parsed = context_rules(rules)
    names = [c for c in tokens.columns if c not in by]
    row = F.struct(F.col(order).alias("_o"), F.col("token").alias("_w"), F.col("tag").alias("_t"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    s = tokens.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_s"))  # a sentence's tokens
    s = s.withColumn("_rules", rule_array(parsed, ["only", "to", "cmd", "x", "y"]))
    s = s.withColumns({"_words": F.transform("_s", lambda x: F.coalesce(x["_w"], F.lit(""))), "_tags": F.transform("_s", lambda x: F.coalesce(x["_t"], F.lit("")))})

    def fold(done: Column, i: Column) -> Column:
        """done: the repaired tags so far."""

        def seen(spec: str, tag: Column) -> Column:
            place, kind = int(spec[:-1]), spec[-1]
            if kind == "w":
                return F.get("_words", i + place)
            return tag if place == 0 else F.get(done if place < 0 else F.col("_tags"), i + place)

        def step(tag: Column, r: Column) -> Column:
            hit = F.lit(False)
            for cmd, spec in CONTEXT.items():
                xs, _, ys = spec.partition(",")
                fits = F.lit(False)
                for x in xs.split():
                    fits = fits | F.coalesce(seen(x, tag) == r["x"], F.lit(False))
                if ys:
                    fits = fits & F.coalesce(seen(ys, tag) == r["y"], F.lit(False))
                hit = F.when(r["cmd"] == cmd, fits).otherwise(hit)
            return F.when(((r["only"] == "*") | (r["only"] == tag)) & hit, r["to"]).otherwise(tag)

        return F.array_append(done, F.aggregate("_rules", F.get("_tags", i), step))

    s = s.withColumn("_new", F.aggregate(F.sequence(F.lit(0), F.size("_s") - 1), F.array().cast("array<string>"), fold))
    each = s.select(*by, F.explode(F.arrays_zip(F.transform("_s", lambda x: x["_row"]).alias("row"), F.col("_new").alias("new"))).alias("z"))
    return each.select(*by, *[F.when(F.col("z.row.tag").isNull() & (F.col("z.new") == ""), None).otherwise(F.col("z.new")).alias("tag") if c == "tag" else F.col(f"z.row.`{c}`").alias(c) for c in names]).select(*tokens.columns)


#: What counts as an entity by its form.
LINK = r"^(http://|www\..*\.(com|org|net|edu|de|uk)$|[\w.+-]+@(\w[\w-]+\.)+[\w-]+$)"


#: Up to so many sizes of names every token is looked up for each, else for those of its word.
FEW_SIZES = 4


def with_entities(tokens: DataFrame, entities: DataFrame, by: list[str], order: str, tag: str = "NNP") -> DataFrame:
    """``tokens`` with the tags of named entities. ``entities``: name, of one
    or more words, and kind (may be null). From left to right the longest name
    that starts at a token is taken, of equally long ones the one of the least
    kind; names don't overlap. Its tokens get ``tag``, unless theirs begins
    with it, and ``-KIND``. Links and mail addresses get ``tag`` alone. Names
    are looked up as arrays, once for each size that names have."""
    names = entities.select(F.split(F.lower(F.trim("name")), r"\s+").alias("_e"), F.upper("kind").alias("_kind")).where(F.element_at("_e", 1) != "").distinct()
    sizes = sorted(r[0] for r in names.select(F.size("_e")).distinct().collect()) or [1]  # how many words names have
    w = Window.partitionBy(*by).orderBy(order, "token", "tag")
    low = F.lower(F.coalesce("token", F.lit("")))
    t = tokens.withColumn("_n", F.row_number().over(w)).withColumn("_ahead", F.collect_list(low).over(w.rowsBetween(0, sizes[-1] - 1)))
    # Whole names meet: a first word can be that of most names and of most places.
    ahead = t.where(F.col("_ahead")[0] != "").select(*by, "_n", "_ahead")
    if len(sizes) > FEW_SIZES:
        of = names.groupBy(F.col("_e")[0].alias("_first")).agg(F.collect_set(F.size("_e")).alias("_sizes"))  # at most a number for each size
        ahead = ahead.join(of, F.col("_ahead")[0] == F.col("_first"))
    else:
        ahead = ahead.withColumn("_sizes", F.array(*map(F.lit, sizes)))
    heads = ahead.select(*by, "_n", "_ahead", F.explode("_sizes").alias("_size")).where(F.size("_ahead") >= F.col("_size"))
    at = heads.select(*by, "_n", F.slice("_ahead", 1, F.col("_size")).alias("_e")).join(names, "_e")
    best = at.groupBy(*by, "_n").agg(F.min(F.struct((-F.size("_e")).alias("size"), F.col("_kind").alias("kind"))).alias("b"))
    spans = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), (-F.col("b.size")).alias("size"), F.col("b.kind").alias("kind")))).alias("_spans"))  # a sentence's names
    # The fold keeps the spans that begin behind the last one kept.
    kind = "array<struct<n:int,size:int,kind:string>>"
    free = F.aggregate("_spans", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(F.concat(acc, F.array(x)), F.size(acc))["n"] + F.element_at(F.concat(acc, F.array(x)), F.size(acc))["size"] <= x["n"]), F.array_append(acc, x)).otherwise(acc))
    kept = spans.select(*by, F.explode(free.cast(kind)).alias("x")).select(*by, F.explode(F.sequence(F.col("x.n"), F.col("x.n") + F.col("x.size") - 1)).alias("_n"), F.lit(True).alias("_hit"), F.col("x.kind").alias("_kind"))
    j = t.join(kept, [*by, "_n"], "left")
    base = F.when(F.startswith(F.coalesce("tag", F.lit("")), F.lit(tag)), F.col("tag")).otherwise(F.lit(tag))
    named = F.concat(base, F.coalesce(F.concat(F.lit("-"), F.col("_kind")), F.lit("")))
    new = F.when(F.col("_hit"), named).when(low.rlike(LINK), F.lit(tag)).otherwise(F.col("tag"))
    return j.withColumn("tag", new).select(*tokens.columns)
