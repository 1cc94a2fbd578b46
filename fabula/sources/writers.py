"""Sinks: tables, tab-separated and ARFF files, text per story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A document set as one Parquet folder per table (SNK1, SNK20)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """SNK2, SNK3, SNK5, SNK6, SNK9, SNK19: columns as they stand."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """Rule weights and other small records, an object a line (SNK17)."""
    df.write.mode("overwrite").json(path)


def arff_lines(df: DataFrame, relation: str, label: str, labels: list[str], digits: int = 4) -> DataFrame:
    """Header and rows of an ARFF file in order (SNK3, SNK11): part, value."""
    spark = df.sparkSession
    numbers = [c for c in df.columns if c != label]
    head = [f"@RELATION {relation}", *[f"@ATTRIBUTE {c} NUMERIC" for c in numbers], f"@ATTRIBUTE {label} {{{','.join(labels)}}}", "@DATA"]
    row = F.concat_ws(",", *[F.format_string(f"%.{digits}f", F.col(c).cast("double")) for c in numbers], F.col(label).cast("string"))
    return spark.createDataFrame(list(enumerate(head)), "part int, value string").union(df.select(F.lit(len(head)), row))


def arff(df: DataFrame, path: str, relation: str, label: str, labels: list[str]) -> None:
    """One ordered text folder; header rows sort first."""
    arff_lines(df, relation, label, labels).repartitionByRange("part").sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


def conll_lines(mentions: DataFrame, doc: str = "doc_id", mention: str = "mention", group: str = "grp") -> DataFrame:
    """``document mention (group)`` lines (SNK4)."""
    return mentions.select(doc, mention, F.format_string("%s\t%s\t(%s)", F.col(doc).cast("string"), F.col(mention).cast("string"), F.col(group).cast("string")).alias("value"))


def joined_text(sents: DataFrame, key: str, order: str, text: str, sep: str = "\n") -> DataFrame:
    """Sentences of each story as one text (SNK6, SNK7, SNK18)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])  # a story's sentences
    return sents.groupBy(key).agg(F.array_join(ordered, sep).alias("text"))


def text_per_key(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder per key (SNK7, SNK13, SNK18)."""
    df.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def confusion_matrix(counts: DataFrame, gold: str, predicted: str, labels: list, path: str) -> None:
    """Predicted by gold table of given labels (SNK10)."""
    counts.groupBy(predicted).pivot(gold, labels).agg(F.sum("n")).na.fill(0).write.mode("overwrite").option("header", True).csv(path)


def term_lines(terms: DataFrame) -> DataFrame:
    """``term count`` lines of each document (SNK12, SNK16)."""
    return terms.select("doc_id", F.concat_ws(" ", "term", F.col("n").cast("string")).alias("value"))


def without_comments(text: Column) -> Column:
    """Text without ``/* */`` stretches (SNK18)."""
    return F.regexp_replace(text, r"(?s)/\*.*?\*/", "")


def frame_text(frames: DataFrame) -> DataFrame:
    """S-expressions of story frames (SNK14): story, phase, head, args, name."""
    line = F.concat(F.lit("("), F.col("name"), F.lit(" "), F.col("head"), F.when(F.size("args") > 0, F.concat(F.lit(" "), F.array_join("args", " "))).otherwise(""), F.lit(")"))
    lines = frames.groupBy("story", "phase").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n    ").alias("body"))  # a phase's frames
    phase = lines.select("story", "phase", F.format_string("  (:PHASE %s\n    %s)", F.col("phase").cast("string"), "body").alias("p"))
    return phase.groupBy("story").agg(F.concat(F.lit("(DEF-STORY\n"), F.array_join(F.array_sort(F.collect_list("p")), "\n"), F.lit(")")).alias("text"))  # a story's phases
