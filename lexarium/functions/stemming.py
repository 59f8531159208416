"""English stemming after Porter (1980), and the analyzer's other word steps.

Stems are worked out once for each different word, in Arrow batches, and joined to the tokens.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffix rules of the published algorithm.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_SHAPE = re.compile(r"(v+c+)")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_SHAPE.findall(_shape(stem)))


def _short_end(word: str) -> bool:
    """consonant, vowel, consonant that is not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, rules) -> str:
    """The longest matching suffix decides; it is replaced behind a stem of measure 1 or more."""
    found = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if found and _measure(word[: -len(found[0])]) > 0:
        return word[: -len(found[0])] + found[1]
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x) and "v" in _shape(word[: -len(x)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    last = max((x for x in _STEP4 if word.endswith(x)), key=len, default=None)
    if last and _measure(word[: -len(last)]) > 1 and (last != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(last)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def strip_possessive(c: Column) -> Column:
    """Without a final 's, whatever its apostrophe."""
    return F.regexp_replace(c, "['’＇][sS]$", "")


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of each different term."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(porter)

    return terms.select(F.col(term).alias("term")).where("term is not null").distinct().withColumn("stem", stem("term"))
