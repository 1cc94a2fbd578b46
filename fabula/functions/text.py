"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
VOWELS = "[aeiouyáéíóúàèùâêîôûäöüë]+"


def words(text: str | Column) -> Column:
    """Lower-case runs of letters and digits; null gives none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def tokens(text: str | Column) -> Column:
    """Word-like runs and single other marks, as written."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def normalise_spacing(text: Column) -> Column:
    """Lower case, one blank for each run of white space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def normalise_letters(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def letter_count(text: Column) -> Column:
    """How many letters and digits a text has; the yardstick of alignment."""
    return F.length(normalise_letters(text))


def ngrams(items: Column, n: int, sep: str = " ") -> Column:
    """All runs of n neighbours, joined; fewer items give none. The array is
    zipped with its own tails, so the work is linear in its length and
    ``items`` is not evaluated again for each run."""
    out = items
    for k in range(1, n):
        out = F.zip_with(out, F.slice(items, k + 1, F.size(items)), lambda a, b: F.concat(a, F.lit(sep), b))
    return F.filter(out, lambda x: x.isNotNull())


def character_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters: a look-ahead at each one."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))."), F.lit(1))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets; two empty sets have 0."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return 206.835 - 1.015 * n_words / n_sentences - 84.6 * n_syllables / n_words


def limit_repeats(text: Column, n: int = 1) -> Column:
    """Runs of one character cut to n: ``NIIICE!!`` is ``NICE!`` for n = 1."""
    return F.regexp_replace(text, rf"((.)\2{{{n - 1}}})\2+", "$1")


def syllables(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(VOWELS))


def wildcard(text: Column, pattern: str) -> Column:
    """``*`` stands for any run: ``x*``, ``*x``, ``*x*``, ``a*b``."""
    import re

    return text.rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")


def from_bytes(raw: Column, *charsets: str) -> Column:
    """The first charset that reads the bytes without a replacement mark; the
    last one is taken as it comes."""
    tried = [F.decode(raw, c) for c in charsets]
    out = tried[-1]
    for t in reversed(tried[:-1]):
        out = F.when(~F.contains(t, F.lit("�")), t).otherwise(out)
    return out
