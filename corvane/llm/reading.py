"""Texts as they read, word by word: one pass over each text, in Arrow batches.

Canonical form, folding and splitting happen in a single ``mapInPandas``. Callers filter inside it, since a filter on the
result of a scalar function is pushed below exchanges by the optimizer and the text would be analysed twice.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corvane.functions.text import APOSTROPHES
from corvane.llm.canonical import canonical_text
from corvane.runtime import spread

_WORDS = re.compile("[a-z0-9]+")
_DROP = str.maketrans("", "", APOSTROPHES)


@functools.cache
def _gone() -> dict[int, None]:
    """Apostrophes and all characters with a non-zero combining class."""
    return dict.fromkeys([*map(ord, APOSTROPHES), *(c for c in range(0x300, 0x110000) if unicodedata.combining(chr(c)))])


def folded(text: str) -> str:
    """The canonical text, decomposed, without combining characters and apostrophes; case is kept."""
    text = canonical_text(text)
    return text.translate(_DROP) if text.isascii() else unicodedata.normalize("NFKD", text).translate(_gone())


def words_of(text: str) -> list[str]:
    return _WORDS.findall(folded(text).lower())


def hashed(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process; each distinct word is hashed once."""
    codes, distinct = pd.factorize(np.array(words, object))
    return pd.util.hash_array(distinct.astype(object), categorize=False)[codes] if len(words) else np.zeros(0, np.uint64)


def read(docs: DataFrame, columns: list[str], emit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``emit`` of every batch of (columns, text) of the rows with a non-null id (the first column) and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = emit(b)
            if len(got):
                yield got

    rows = docs.where(f"`{columns[0]}` is not null and text is not null").select(*columns, "text")
    return spread(rows).mapInPandas(run, schema)
