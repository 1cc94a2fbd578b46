"""English stems (Porter's second algorithm), once per distinct word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The algorithm's exceptions and suffix tables.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
V = "aeiouy"


def region(word: str, start: int) -> int:
    """Where the part after the first vowel and its consonant begins."""
    m = re.compile(rf"[{V}][^{V}]").search(word, start)
    return m.end() if m else len(word)


def short_end(w: str) -> bool:
    return bool(re.search(rf"(^|.*[^{V}])[{V}][^{V}wxY]$", w) and len(w) > 2 or re.fullmatch(rf"[{V}][^{V}]", w))


def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2 or w in UNCHANGED:
        return w
    if w in WHOLE:
        return WHOLE[w]
    w = re.sub(r"^'", "", w)
    w = re.sub(rf"^y|(?<=[{V}])y", "Y", w)
    head = re.match(r"gener|commun|arsen", w)
    r1 = head.end() if head else region(w, 0)
    r2 = region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{V}]", w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    m = re.search(r"(eedly|ingly|edly|eed|ing|ed)$", w)
    if m:
        at, end = m.start(), m[1]
        if end in ("eed", "eedly"):
            w = w[:at] + "ee" if at >= r1 else w
        elif re.search(rf"[{V}]", w[:at]):
            w = w[:at]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif r1 >= len(w) and short_end(w):
                w += "e"
    # 1c
    if re.search(rf".[^{V}][yY]$", w):
        w = w[:-1] + "i"

    def swap(table: list[str], w: str) -> str:
        for row in table:
            end, to = row
            if w.endswith(end):
                return w[: -len(end)] + to if len(w) - len(end) >= r1 else w
        if table is STEP2:
            if w.endswith("ogi") and w[-4:-3] == "l" and len(w) - 3 >= r1:
                return w[:-1]
            if w.endswith("li") and re.search(r"[cdeghkmnrt]li$", w) and len(w) - 2 >= r1:
                return w[:-2]
        return w

    w = swap(STEP2, w)
    if w.endswith("ative"):
        w = w[:-5] if len(w) - 5 >= r2 else w
    else:
        w = swap(STEP3, w)
    for end in STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if re.search(r"[st]ion$", w) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """word and stem of the distinct words; join back on the word (STR30)."""

    @F.pandas_udf("string")
    def run(w: pd.Series) -> pd.Series:
        return w.map(stem, na_action="ignore")

    return words.select(word).distinct().withColumn("stem", run(word))
