"""Text analysis as Column expressions: folding, tokens, stop words, lengths.

Folding follows the Unicode rule "compatibility-decompose, then drop every character with a non-zero combining
class". The tables come from the interpreter's Unicode data by that rule, so the whole analysis stays in the JVM:
one hash lookup per character, and only for texts that hold a character outside ASCII.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

APOSTROPHES = "'’`"


@functools.cache
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """``translate`` arguments (characters without a counterpart are deleted) and the characters that become several.

    Hangul syllables are left out: their parts are letters outside a-z as well, so no token changes.
    """
    one, to, gone, several = [], [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        c = chr(cp)
        d = unicodedata.normalize("NFKD", c)
        if d.isascii() is False and d == c and unicodedata.combining(c) == 0:
            continue
        d = "".join(x for x in d if unicodedata.combining(x) == 0)
        if d == c:
            continue
        if not d:
            gone.append(c)
        elif len(d) == 1:
            one.append(c)
            to.append(d)
        else:
            several[c] = d
    return "".join(one + gone), "".join(to), several


def fold(text: Column) -> Column:
    """Compatibility-decomposed text without combining characters. Null stays null."""
    many_from, to, several = fold_tables()
    table = F.from_json(F.lit(json.dumps(several, ensure_ascii=False)), "map<string,string>")
    marks = F.lit("".join(several))
    expanded = F.when(
        F.translate(text, "".join(several), "") != text,
        F.array_join(
            F.transform(F.split(text, ""), lambda c: F.when(F.instr(marks, c) > 0, F.coalesce(table[c], c)).otherwise(c)), ""
        ),
    ).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(expanded, many_from, to)).otherwise(text)


def drop_apostrophes(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, "")


def tokens(text: Column, lowercase: bool = True, min_length: int = 1) -> Column:
    """The maximal ASCII letter-digit runs of the folded text, in order; null and empty texts give an empty list."""
    clean = drop_apostrophes(fold(text))
    found = F.regexp_extract_all(F.lower(clean) if lowercase else clean, F.lit("([a-z0-9]+)" if lowercase else "([A-Za-z0-9]+)"), F.lit(1))
    if min_length > 1:
        found = F.filter(found, lambda t: F.length(t) >= min_length)
    return F.coalesce(found, F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Lower-case words of a text, every length kept."""
    return tokens(text)


@dataclass(frozen=True)
class Analyzer:
    """Options of the search analysis, applied in a fixed order.

    fold, drop apostrophes, lower case, tokens, stop words (matched on the surface form), lemma, stem, length.
    ``lemmas`` is a dictionary (form to form) of bounded size; a form it lacks stays as it is. ``tagger``, where one is plugged in, maps
    the token array to an array of parts of speech; a lemma under "form/tag" then goes before one under "form".
    """

    lowercase: bool = True
    stop_words: tuple[str, ...] = ()
    lemmas: dict[str, str] = field(default_factory=dict, hash=False)
    stem: bool = False
    min_length: int = 2
    tagger: Callable[[Column], Column] | None = field(default=None, hash=False)

    def __call__(self, text: Column) -> Column:
        found = tokens(text, self.lowercase)
        if self.stop_words:
            stops = F.array(*[F.lit(w) for w in normalised_stop_words(self.stop_words)])
            found = F.filter(found, lambda t: ~F.array_contains(stops, F.lower(t)))
        if self.lemmas:
            table = F.from_json(F.lit(json.dumps(self.lemmas)), "map<string,string>")
            plain = lambda t: F.coalesce(table[F.lower(t)], F.lower(t))
            found = F.transform(found, plain) if self.tagger is None else F.zip_with(found, self.tagger(found), lambda t, p: F.coalesce(table[F.concat(F.lower(t), F.lit("/"), p)], plain(t)))
        if self.stem:
            from corvane.functions.stemming import stem_tokens

            found = stem_tokens(found)
        return F.filter(found, lambda t: F.length(t) >= self.min_length)


def normalised_stop_words(stop_words) -> list[str]:
    """Stop words put through the same folding as the text, so that they match its tokens."""
    out = []
    for w in stop_words:
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if unicodedata.combining(c) == 0)
        w = "".join(c for c in w if c not in APOSTROPHES).lower().strip()
        if w and w not in out:
            out.append(w)
    return out


#: A short list of English function words used where no other list is supplied.
STOP_WORDS = tuple(
    "a an and are as at be but by for from had has have he her his i if in into is it its no not of on or she so "
    "such than that the their them then there these they this to was we were what when which who will with you".split()
)


def content_tokens(text: Column, stop_words=STOP_WORDS) -> Column:
    """Tokens of the cluster and topic models: raw text in lower case, words of two or more characters, no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.coalesce(F.filter(found, lambda t: ~F.array_contains(stops, t)), F.array().cast("array<string>"))
