"""Mentions, verbs and dependencies: lookups, roles and pair features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.operators import linking


def covering(mentions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mentions over each token, shortest first (SPN4). A determiner or
    possessive at the front of a mention counts for the mention after it, so
    a token whose successor is a possessive mark is passed over."""
    m = mentions.select("doc_id", "sent_id", "mention_id", (F.col("tok_end") - F.col("tok_start")).alias("width"), F.explode(F.sequence("tok_start", F.col("tok_end") - 1)).alias("idx"))
    t = tokens.withColumn("_next", F.lead("pos").over(Window.partitionBy("doc_id", "sent_id").orderBy("idx")))
    t = t.where(~F.coalesce(F.col("pos").isin("DT", "POS") | (F.col("_next") == "POS"), F.lit(False)))
    w = Window.partitionBy("doc_id", "sent_id", "idx").orderBy("width", "mention_id")
    return t.select("doc_id", "sent_id", "idx").join(m, ["doc_id", "sent_id", "idx"]).withColumn("rank", F.row_number().over(w))


def verb_of_token(verbs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The first verb of each token (SPN5)."""
    first = verbs.groupBy("doc_id", "token_id").agg(F.min("verb_id").alias("verb_id"))
    return tokens.join(first, ["doc_id", "token_id"], "left")


def node_ancestors(nodes: DataFrame) -> DataFrame:
    """(doc_id, sent_id, path, above, label_above): a node's ancestors are the
    prefixes of its path, exploded once and joined by equality (SPN8, SPN9)."""
    pre = nodes.select("doc_id", "sent_id", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))).alias("above"))
    up = nodes.select("doc_id", "sent_id", F.col("path").alias("above"), F.col("label").alias("label_above"))
    return pre.join(up, ["doc_id", "sent_id", "above"])


def lowest_node(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The deepest parse node over a token range (SPN7)."""
    j = ranges.join(nodes, ["doc_id", "sent_id"]).where("node_start <= tok_start and node_end >= tok_end")
    return j.groupBy("doc_id", "sent_id", "range_id").agg(F.max_by("path", F.struct(F.size("path"), "path")).alias("path"))


def node_flags(nodes: DataFrame, above: list[str], below: list[str]) -> DataFrame:
    """Flags of labels above and below each node (FEA1)."""
    a = node_ancestors(nodes).where(F.col("above") != F.col("path"))
    up = a.groupBy("doc_id", "sent_id", "path").agg(F.collect_set("label_above").alias("_up"))  # a node's ancestors
    low = nodes.select("doc_id", "sent_id", F.col("path").alias("p2"), F.col("label").alias("l2"))
    down = a.join(low, ["doc_id", "sent_id"]).where("path = p2").groupBy("doc_id", "sent_id", F.col("above").alias("path")).agg(F.collect_set("l2").alias("_down"))
    j = nodes.join(up, ["doc_id", "sent_id", "path"], "left").join(down, ["doc_id", "sent_id", "path"], "left")
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False)).cast("double")
    return j.select("doc_id", "sent_id", "path", *[has("_up", v).alias(f"above_{v}") for v in above], *[has("_down", v).alias(f"below_{v}") for v in below])


def mentions_from_tree(nodes: DataFrame, phrase: str = "NP", stop: tuple[str, ...] = ("S", "SBAR", "VP")) -> DataFrame:
    """Highest ``phrase`` nodes that hold no clause, as mentions (HIER2): a
    node with a qualifying ancestor is dependent on it."""
    a = node_ancestors(nodes).where(F.col("above") != F.col("path"))
    clauses = a.join(nodes.where(F.col("label").isin(*stop)).select("doc_id", "sent_id", "path"), ["doc_id", "sent_id", "path"], "left_semi").select("doc_id", "sent_id", F.col("above").alias("path")).distinct()
    fit = nodes.where(F.col("label") == phrase).join(clauses, ["doc_id", "sent_id", "path"], "left_anti")
    under = a.join(fit.select("doc_id", "sent_id", F.col("path").alias("above")), ["doc_id", "sent_id", "above"], "left_semi").select("doc_id", "sent_id", "path").distinct().withColumn("_under", F.lit(True))
    return fit.join(under, ["doc_id", "sent_id", "path"], "left").withColumn("is_independent", F.col("_under").isNull()).drop("_under")


def closest(probes: DataFrame, mentions: DataFrame, key: list[str]) -> DataFrame:
    """The mention of the same key whose centre is nearest to the probe, the
    earlier of equals (SPN10)."""
    gap = F.abs(F.col("offset") + F.col("len") / 2 - F.col("centre"))
    return probes.join(mentions, key).groupBy("probe_id").agg(F.min_by("mention_id", F.struct(gap, "offset", "mention_id")).alias("mention_id"))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mentions of two versions by shared tokens (SPN12, JN9): left_id, rights
    (sorted), status none, one or many. Tables: doc_id, mention_id, token."""
    r = right.select("doc_id", "token", F.col("mention_id").alias("right_id"))
    j = left.join(r, ["doc_id", "token"], "left").groupBy("doc_id", F.col("mention_id").alias("left_id")).agg(F.array_sort(F.collect_set("right_id")).alias("rights"))  # a mention's partners
    return j.withColumn("status", F.when(F.size("rights") == 0, "none").when(F.size("rights") == 1, "one").otherwise("many"))


def hinted(quotes: DataFrame, key: str = "doc_id", order: str = "offset") -> DataFrame:
    """``verb<speaker/listener`` hints, and the quotes around each (SPN16)."""
    w = Window.partitionBy(key).orderBy(order)
    p, who = F.split("hint", "[<>]"), F.split(F.get(F.split("hint", "[<>]"), F.lit(1)), "/")
    return quotes.withColumns(
        {
            "hint_verb": F.nullif(F.trim(p[0]), F.lit("")), "hint_speaker": F.nullif(F.trim(F.get(who, F.lit(0))), F.lit("")), "hint_listener": F.nullif(F.trim(F.get(who, F.lit(1))), F.lit("")),
            "previous_quote": F.lag(order).over(w), "next_quote": F.lead(order).over(w), "backward": F.contains("hint", F.lit("<")),
        }
    )


def unfolded_copulas(deps: DataFrame) -> DataFrame:
    """Rewrites ``nsubj`` under a governor with ``cop`` to ``cop_nsubj`` and
    adds the copula's own subject (JN5)."""
    cop = deps.where("type = 'cop'").select("doc_id", "sent_id", "gov_idx", F.col("dep_idx").alias("_cop"))
    j = deps.join(cop, ["doc_id", "sent_id", "gov_idx"], "left")
    hit = (F.col("type") == "nsubj") & F.col("_cop").isNotNull()
    new = j.where(hit).select("doc_id", "sent_id", F.lit("nsubj").alias("type"), F.col("_cop").alias("gov_idx"), "dep_idx")
    old = j.select("doc_id", "sent_id", F.when(hit, "cop_nsubj").otherwise(F.col("type")).alias("type"), "gov_idx", "dep_idx").distinct()
    return old.unionByName(new)


def verbs_from_dependencies(deps: DataFrame, tokens: DataFrame) -> DataFrame:
    """Verbs with their argument slots (JN1, STR22): doc_id, sent_id, idx,
    lemma, slot, dep_idx; slots A0, A1, A2, AM-NEG and AM-MOD."""
    slot = (
        F.when(F.col("type").isin("nsubj", "agent", "xsubj"), "A0").when(F.col("type").isin("dobj", "nsubjpass", "ccomp"), "A1").when(F.col("type").isin("iobj") | F.startswith("type", F.lit("prep_")), "A2")
        .when(F.col("type") == "neg", "AM-NEG").when(F.col("type") == "advmod", "AM-MOD")
    )
    v = tokens.where(F.startswith("pos", F.lit("VB"))).select("doc_id", "sent_id", "idx", "lemma")
    d = deps.withColumn("slot", slot).where("slot is not null").select("doc_id", "sent_id", F.col("gov_idx").alias("idx"), "slot", "dep_idx")
    particle = deps.where("type = 'prt'").select("doc_id", "sent_id", F.col("gov_idx").alias("idx"), F.col("dep_idx").alias("_p"))
    p = particle.join(tokens.select("doc_id", "sent_id", F.col("idx").alias("_p"), F.col("lemma").alias("_l")), ["doc_id", "sent_id", "_p"])
    v = v.join(p.drop("_p"), ["doc_id", "sent_id", "idx"], "left").withColumn("lemma", F.concat_ws("_", "lemma", "_l")).drop("_l")
    return v.join(d, ["doc_id", "sent_id", "idx"], "left")


def subjects_and_objects(args: DataFrame, cover: DataFrame) -> DataFrame:
    """Argument tokens to their smallest mentions (JN2): A0 are subjects, other
    numbered slots objects. cover: result of ``covering``."""
    m = cover.where("rank = 1").select("doc_id", "sent_id", F.col("idx").alias("dep_idx"), "mention_id")
    role = F.when(F.col("slot") == "A0", "subject").when(F.col("slot").isin("A1", "A2"), "object")
    return args.join(m, ["doc_id", "sent_id", "dep_idx"]).withColumn("role", role).where("role is not null").select("doc_id", "sent_id", "idx", "lemma", "role", "mention_id").distinct()


def prior_links(mentions: DataFrame, group: str) -> DataFrame:
    """+1 for pairs of one group, -1 otherwise (COR1)."""
    p = linking.pairs(mentions.select("doc_id", "mention_id", group), "doc_id", "mention_id")
    return p.select("doc_id", F.col("mention_id_i").alias("i"), F.col("mention_id_j").alias("j"), F.when(F.col(f"{group}_i").eqNullSafe(F.col(f"{group}_j")), 1.0).otherwise(-1.0).alias("w"))


def feature_links(mentions: DataFrame, vector: str = "features") -> DataFrame:
    """Similarity sum(min) / sum(max) of feature vectors (COR3)."""
    from fabula.operators.classify import weighted_jaccard

    p = linking.pairs(mentions.select("doc_id", "mention_id", vector), "doc_id", "mention_id")
    return p.select("doc_id", F.col("mention_id_i").alias("i"), F.col("mention_id_j").alias("j"), (1 - weighted_jaccard(F.col(f"{vector}_i"), F.col(f"{vector}_j"))).alias("w"))


def conflict_links(mentions: DataFrame, labels: list[str]) -> DataFrame:
    """-1 for pairs whose number or gender label differs (COR4); the label is
    the column with the largest value, none if all are zero."""
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("v"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(labels)]))
    m = mentions.select("doc_id", "mention_id", F.when(best["v"] > 0, best["c"]).alias("kind"))
    p = linking.pairs(m, "doc_id", "mention_id").where("kind_i <> kind_j")
    return p.select("doc_id", F.col("mention_id_i").alias("i"), F.col("mention_id_j").alias("j"), F.lit(-1.0).alias("w"))


def role_links(mentions: DataFrame) -> DataFrame:
    """+1 for one role, -1 for a different character flag (COR5)."""
    p = linking.pairs(mentions.select("doc_id", "mention_id", "role", "character"), "doc_id", "mention_id")
    w = F.when(F.col("role_i") == F.col("role_j"), 1.0).otherwise(0.0) + F.when(F.col("character_i") != F.col("character_j"), -1.0).otherwise(0.0)
    return p.select("doc_id", F.col("mention_id_i").alias("i"), F.col("mention_id_j").alias("j"), w.alias("w")).where("w <> 0")


def probabilistic_merge(cells: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted log-odds vote of link tables with values 0.9 and 0.1 (COR10):
    positive if the pair is more likely linked than not."""
    out = None
    for links, f1 in cells:
        p = F.when(F.col("w") > 0, 0.9).otherwise(0.1)
        part = links.select("doc_id", "i", "j", (F.log(p / (1 - p)) * f1).alias("w"))
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "i", "j").agg((1 / (1 + F.exp(-F.sum("w")))).alias("w"))


def owners(mentions: DataFrame) -> DataFrame:
    """Tokens shared by mentions stay with the shortest one (WIN15)."""
    size = Window.partitionBy("doc_id", "mention_id")
    m = mentions.withColumn("_n", F.count(F.lit(1)).over(size))
    w = Window.partitionBy("doc_id", "token").orderBy("_n", "mention_id")
    return m.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def groups_with_entity(mentions: DataFrame) -> DataFrame:
    """Each group's first text, majority role and character flag (COR13)."""
    from fabula.operators.evaluate import vote_by_group

    named = mentions.withColumn("_g", F.struct("doc_id", "grp"))
    first = named.groupBy("_g").agg(F.min_by("text", "offset").alias("representation"), F.count(F.lit(1)).alias("mentions"), F.bool_or("character").alias("any_character"))
    role = vote_by_group(named, "_g", "role").select("_g", F.col("role").alias("majority_role"))
    return first.join(role, "_g", "left").select("_g.doc_id", "_g.grp", "representation", "mentions", "majority_role", "any_character")


def merged_by_head(mentions: DataFrame, mode: int = 0) -> DataFrame:
    """Groups that share a head word become one (COR9): 0 merges on equal lists
    of noun and adjective lemmas, 1 on equal lists of noun lemmas, 2 on any
    common noun lemma, -1 not at all. mentions: doc_id, mention_id, grp and
    tokens (an array of pos, lemma); plurals neither merge nor are merged upon.
    A group takes the least number that it can reach."""
    if mode == -1:
        return mentions
    kinds = ["NN", "NNP", "JJ"] if mode == 0 else ["NN", "NNP"]
    heads = F.transform(F.filter("tokens", lambda t: t["pos"].isin(kinds)), lambda t: F.lower(t["lemma"]))
    single = mentions.where(~F.exists("tokens", lambda t: t["pos"].isin("NNS", "NNPS"))).withColumn("heads", heads).where(F.size("heads") > 0)
    key = F.explode(F.array_distinct("heads")) if mode == 2 else F.array_join("heads", "\n")
    keyed = single.select("doc_id", "grp", key.alias("key")).distinct()
    first = keyed.groupBy("doc_id", "key").agg(F.min("grp").alias("first"))  # a star, not all pairs
    edges = keyed.join(first, ["doc_id", "key"]).where("grp <> first").select("doc_id", "grp", "first").distinct()
    dealt = edges.repartition("doc_id").sortWithinPartitions("doc_id")
    kinds = dict(mentions.dtypes)
    to = dealt.mapInPandas(merged_groups, f"doc_id {kinds['doc_id']}, grp {kinds['grp']}, _to {kinds['grp']}")
    return mentions.join(to, ["doc_id", "grp"], "left").withColumn("grp", F.coalesce("_to", "grp")).drop("_to")


def merged_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, grp and the least group that it reaches by edges (doc_id, grp,
    first), which come document by document and never leave one. Holds a batch
    and the edges of the document that it ends in."""

    def solved(e: pd.DataFrame) -> pd.DataFrame:
        nodes = pd.concat([e[["doc_id", "grp"]], e[["doc_id", "first"]].rename(columns={"first": "grp"})], ignore_index=True)
        at = nodes.groupby(["doc_id", "grp"], sort=True).ngroup().to_numpy()
        a, b = at[: len(e)], at[len(e) :]
        label = np.arange(at.max(initial=-1) + 1)
        while True:
            before = label.copy()
            np.minimum.at(label, a, before[b])
            np.minimum.at(label, b, before[a])
            label = label[label]
            if (label == before).all():
                break
        spot = np.zeros(len(label), np.int64)
        spot[at] = np.arange(len(at))  # a row of each node
        moved = spot[label != np.arange(len(label))]
        out = nodes.iloc[moved].reset_index(drop=True)
        return out.assign(_to=nodes["grp"].to_numpy()[spot[label[at[moved]]]])

    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        open_doc = (pdf["doc_id"] == pdf["doc_id"].iloc[-1]).to_numpy()
        held = pdf[open_doc]
        if not open_doc.all():
            yield solved(pdf[~open_doc].reset_index(drop=True))
    if held is not None:
        yield solved(held.reset_index(drop=True))


def joined_symbols(mentions: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Split groups of one symbol take its least number, and a mention alone in
    its group is marked ``singleton`` (COR11). Without a symbol groups stay."""
    w = mentions.where(F.col(symbol).isNotNull()).groupBy("doc_id", symbol).agg(F.min("grp").alias("_to"))
    m = mentions.join(w, ["doc_id", symbol], "left").withColumn("grp", F.coalesce("_to", "grp")).drop("_to")
    alone = m.groupBy("doc_id", "grp").agg((F.count(F.lit(1)) == 1).alias("singleton"))
    return m.join(alone, ["doc_id", "grp"])


def reset_groups(mentions: DataFrame) -> DataFrame:
    """Every mention is a group of its own (COR12)."""
    return mentions.withColumn("grp", F.col("mention_id"))
