"""Text templates with slots as tables (TPL1, TPL2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(templates: DataFrame, options: DataFrame) -> DataFrame:
    """All texts of ``id, template`` whose ``{slot}`` parts are replaced by the
    ``slot, value`` options, slot by slot. A slot is the same all over a text."""
    slots = [r[0] for r in options.select("slot").distinct().orderBy("slot").collect()]  # names of slots
    out = templates.select("id", F.col("template").alias("text"))
    for s in slots:
        mark = F.lit("{" + s + "}")
        values = options.where(F.col("slot") == s).select("value")
        hit = out.where(F.contains("text", mark)).join(F.broadcast(values)).select("id", F.replace("text", mark, F.col("value")).alias("text"))  # options of one slot
        out = out.where(~F.contains("text", mark)).union(hit)
    return out.distinct()


def sample(templates: DataFrame, options: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n texts of each template; each slot's value is picked by a hash."""
    slots = options.groupBy("slot").agg(F.array_sort(F.collect_list("value")).alias("values")).orderBy("slot").collect()  # options of slots
    out = templates.select("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), F.col("template").alias("text"))
    for r in slots:
        at = F.pmod(F.xxhash64("id", "k", F.lit(r["slot"]), F.lit(seed)), F.lit(len(r["values"]))).cast("int")
        out = out.withColumn("text", F.replace("text", F.lit("{" + r["slot"] + "}"), F.element_at(F.array(*map(F.lit, r["values"])), at + 1)))
    return out


def tidy(text):
    """First letter a capital, single blanks, none before marks (STR21)."""
    c = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r" ([.,!?;:])", "$1")
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))
