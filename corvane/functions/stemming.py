"""The Porter stemmer, from the published description of 1980, applied to distinct terms."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Suffix rules of steps 2, 3 and 4 of the published algorithm.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _shape(word: str) -> str:
    """The word as a string of v and c; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, rules: str, least: int) -> str:
    """Replace the longest matching suffix if the stem before it has a measure above ``least``."""
    pairs = sorted((r.partition(":")[::2] for r in rules.split()), key=lambda r: -len(r[0]))
    for suffix, to in pairs:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            fits = _measure(stem) > least and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem + to if fits else word
    return word


@functools.lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(word, STEP2, 0)
    word = _longest(word, STEP3, 0)
    word = _longest(word, STEP4, 1)
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def _stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(porter, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _stem_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda words: [porter(w) for w in words])


def stem_tokens(tokens: Column) -> Column:
    return _stem_all(tokens)


def stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of distinct terms: each is stemmed once, however often it occurs."""
    return terms.select("term").distinct().withColumn("stem", _stem(F.col("term")))
