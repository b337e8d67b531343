"""Visually identical text in one form.

A character is *unstable* when the form chosen here would change it: by canonical composition, by a
compatibility mapping that keeps the look (width, ligature, font, no-break), because it shows nothing
(zero-width and other ignorable characters), or because it is a space or hyphen of another kind. The quick check asks for any such
character; a text without one is returned unchanged. Otherwise only the unstable *segments* are normalised: a maximal run of
unstable characters with the one character before it, which composition can reach. What follows a segment is stable, so
it starts anew, and the segment is spliced back into the unchanged rest, whatever script that is in.

Kept apart, since a reader sees the difference: case, accents, punctuation, superscripts, circled and fractional
forms. Letters of other scripts become the Latin ones they look like in words that hold Latin letters too; words
wholly of such letters follow only in a text with more Latin letters than letters that look like none, and with such a mixed word (or if they have one or two letters),
so that words and texts of other scripts survive. :func:`look` maps all of them and serves for comparison only.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.runtime import keep, spread

#: Letters of other scripts and the Latin letters they look like, by script.
LOOK_ALIKES = {
    # Greek
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "у": "y", "х": "x", "ԁ": "d", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "ԍ": "g",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԁ": "D", "Ӏ": "I",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "յ": "j", "Օ": "O", "Ս": "U", "Տ": "S",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H",
    "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Latin letters of other shapes, and hyphens
    "ɡ": "g", "ɑ": "a", "ı": "i", "ȷ": "j", "ɩ": "i", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴄ": "c", "ꜱ": "s",
    "‐": "-", "‑": "-", "−": "-", "⁃": "-",
}
#: Compatibility mappings a reader can see are not applied.
VISIBLE = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
#: Letters of a word that is taken for Latin in a Latin text if all of them may be.
SHORT = 2
#: Rows of one stored form that are paired one by one.
EXPAND = 64
IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}᠎﻿]")
SPACE = regex.compile(r"[\p{Zs}\t\v\f\x85]")
_GAPS = re.compile(r"[\t\v\f\x85]")


def _mapped(c: str) -> str:
    """The character with its look kept and its accents apart, without the look-alike step."""
    if IGNORABLE.match(c):
        return ""
    if SPACE.match(c) or c == "\xa0":
        return " "
    parts = []
    for x in unicodedata.normalize("NFD", c):
        tag = unicodedata.decomposition(x).split(" ", 1)[0]
        if tag.startswith("<") and tag not in VISIBLE:
            d = unicodedata.normalize("NFKD", x)
            parts.append(d if not d.startswith(" ") or len(d) == 1 else x)
        else:
            parts.append(x)
    return "".join(parts)


_HYPHENS = "‐‑−⁃"


@functools.cache
def tables() -> tuple[dict[int, str], frozenset[str], re.Pattern]:
    """The map of single characters, the characters whose quick check says no or maybe, and the pattern of a segment."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    special = {*IGNORABLE.findall(every), *SPACE.findall(every), *_HYPHENS} - {" "}
    to, unstable = {ord(c): "-" for c in _HYPHENS}, set(special)
    for c in every:
        if 0xAC00 <= ord(c) <= 0xD7A3 or c in _HYPHENS or not (c in special or unicodedata.decomposition(c) or unicodedata.combining(c)):
            continue
        m = _mapped(c)
        if m != unicodedata.normalize("NFD", c):
            to[ord(c)] = m
        if unicodedata.combining(c) or unicodedata.normalize("NFC", m) != c or not unicodedata.is_normalized("NFC", "a" + c):
            unstable.add(c)
    unstable.update(map(chr, range(0x1161, 0x1200)))  # conjoining letters compose with what precedes them
    # one class of the basic plane, which is matched by a table; of the planes above, every character is looked up
    near = "".join(map(re.escape, sorted(c for c in unstable if ord(c) < 0x10000)))
    far = "".join(map(re.escape, sorted(c for c in unstable if ord(c) >= 0x10000)))
    return to, frozenset(unstable), re.compile(f"(?s).?(?:[{near}]+|[\U00010000-\U0010ffff](?<=[{far}]))+")


_WORD = regex.compile(r"[\p{L}\p{M}]+")
_FOREIGN = re.compile("[" + "".join(c for c in LOOK_ALIKES if c not in _HYPHENS) + "]")
_LETTERS = str.maketrans({a: b for a, b in LOOK_ALIKES.items() if a not in _HYPHENS})
_LATIN = regex.compile(r"[\p{Latin}\p{M}]+")
_MIXED = regex.compile(r"\p{Latin}\p{M}*[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}]|[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}]\p{M}*\p{Latin}")
_OTHER, _OWN = regex.compile(r"[\p{L}--\p{Latin}]", regex.V1), regex.compile(r"\p{Latin}")


def _latinised(text: str) -> str:
    """Words in Latin letters where all their letters have Latin look-alikes and the word, or the text around it, is a mixture."""
    latin = len(_OWN.findall(text)) > sum(c not in LOOK_ALIKES for c in _OTHER.findall(text))
    whole = latin and bool(_MIXED.search(text))

    def word(m) -> str:
        w = m.group()
        if not _FOREIGN.search(w) or not (whole or latin and len(w) <= SHORT or _OWN.search(w)):
            return w
        d = unicodedata.normalize("NFD", w).translate(_LETTERS)
        return unicodedata.normalize("NFC", d) if _LATIN.fullmatch(d) else w

    return _WORD.sub(word, text)


def canonical_text(text: str | None) -> str | None:
    """One text in the consistent form; null stays null."""
    if text is None or text.isascii() and not _GAPS.search(text):
        return text
    to, unstable, segment = tables()
    if not unstable.isdisjoint(text):
        text = segment.sub(lambda m: unicodedata.normalize("NFC", unicodedata.normalize("NFD", m.group()).translate(to)), text)
    return text if text.isascii() or not _FOREIGN.search(text) else _latinised(text)


@F.pandas_udf(StringType())
def _canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(canonical_text, na_action="ignore")


# the optimizer neither repeats it nor moves it below an exchange
_canonical = _canonical.asNondeterministic()


#: Only texts with such a character are sent to Python.
_ASK = r"[^\x00-\x7F]|[\t\x0B\f]"


def canonical(text: Column) -> Column:
    """Column form of :func:`canonical_text`: Arrow batches, one pass, no shuffle. ASCII texts stay in the JVM."""
    return F.coalesce(_canonical(F.when(text.rlike(_ASK), text)), text)


@functools.cache
def _looks() -> tuple[str, str]:
    """Look-alikes, and by rule their composed forms with accents, with the Latin letters they look like."""
    to = dict(LOOK_ALIKES)
    for c in map(chr, range(0x370, 0x10000)):
        d = unicodedata.normalize("NFD", c) if unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<") else ""
        if len(d) > 1 and d[0] in LOOK_ALIKES and len(x := unicodedata.normalize("NFC", LOOK_ALIKES[d[0]] + d[1:])) == 1:
            to[c] = x
    return "".join(to), "".join(to.values())


def look(canon: Column) -> Column:
    """What a reader sees of a canonical text: remaining look-alikes as Latin letters, outer spaces and their number ignored."""
    return F.trim(F.regexp_replace(F.translate(canon, *_looks()), r" +", " "))


def look_classes(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, look, form): a class of each row that looks like others of the same ``look``, and of its stored ``form`` (64-bit hashes).

    Rows with a null key, or a text without visible characters, have no row; repeated rows count once.
    """
    return _classes(rows, key, text).select("key", F.col("g.col1").alias("look"), F.col("form").alias("form"))


def _classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    return (
        spread(rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("stored")).where("key is not null and stored is not null"))
        .withColumn("seen", look(canonical(F.col("stored"))))
        .where(F.regexp_replace("seen", r"(?U)[\s\p{C}\p{M}]", "") != "")
        .select("key", F.struct(F.xxhash64("seen"), F.xxhash64(F.reverse("seen"))).alias("g"), F.xxhash64("stored", F.reverse("stored")).alias("form"))
        .distinct()
    )


def same_look(rows: DataFrame, key: str, text: str = "text", expand: int = EXPAND) -> DataFrame:
    """Pairs of rows whose texts differ as stored but look the same: (key_a, key_b), the smaller string first.

    Rows with a null key, or a text without visible characters, have no partner. Groups are formed on a 128-bit hash
    of the look, so no text is shuffled, and a group with a single stored form leaves before anything is joined. Each
    pair joins two *different* forms. Of a form with more than ``expand`` rows, only the smallest key meets all
    rows of the other forms, and each further row meets the smallest key of each other form: every row keeps its
    link to every other form, without the product of two large groups.
    """
    looks = keep(_classes(rows, key, text), "looks")
    several = looks.groupBy("g").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo <> hi").select("g")
    form = Window.partitionBy("g", "form")
    part = looks.join(several, "g", "left_semi")
    part = part.select("g", "form", "key", (F.min("key").over(form) == F.col("key")).alias("first"), (F.count(F.lit(1)).over(form) <= expand).alias("small"))
    a, b = part.where("small or first").alias("a"), part.alias("b")
    other = (F.col("a.g") == F.col("b.g")) & (F.col("a.form") != F.col("b.form"))
    met = a.join(b, other & (F.col("b.small") | F.col("b.first") | F.col("a.first"))).select(F.col("a.key").alias("x"), F.col("b.key").alias("y"))
    return met.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).where("key_a <> key_b").distinct()
