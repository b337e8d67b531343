"""Encoding of a whole corpus with a public tokenizer, each distinct word encoded once."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from corvane.runtime import keep, spread

#: Where the vocabulary files of the public tokenizers lie, on every executor.
TOKENIZERS = os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: At most this many words are treated as frequent: each is more than 1/HOT of all occurrences, so no more can exist.
HOT = 8192


def pre_tokens(text: Column) -> Column:
    """The pieces of a text in order; nothing is lost between them. (?U) gives \\s its Unicode meaning in the JVM."""
    return F.regexp_extract_all(text, F.lit("(?U)(" + PATTERN + ")"), F.lit(1))


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode(path: str):
    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(path)
        for s in batches:
            yield s.map(enc.encode_ordinary)

    return encode


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def word_ids(pieces: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): every distinct word once, with its occurrences. ``pieces`` has ``word``."""
    return pieces.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("ids", _encode(path)(F.col("word")))


def _pieces(texts: DataFrame) -> DataFrame:
    return spread(texts).select("doc", F.posexplode(pre_tokens(F.col("text"))).alias("pos", "word"))


def _joined(texts: DataFrame, path: str, value: Column) -> DataFrame:
    """(doc, pos, value): each piece with a value of its word's ids.

    Words that make up more than 1/HOT of all pieces are at most HOT: they are broadcast and their rows never move
    by word, which takes the hot keys out of the shuffle. All other words are joined by a shuffle on the word.
    """
    pieces = keep(_pieces(texts), "pieces")
    words = keep(word_ids(pieces, path).select("word", "n", value.alias("value")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = F.broadcast(words.where(F.col("n") * HOT > total).select("word", "value"))
    rare = words.where(F.col("n") * HOT <= total).select("word", "value")
    at_once = pieces.join(frequent, "word").select("doc", "pos", "value")
    moved = pieces.join(frequent.select("word"), "word", "left_anti").join(rare, "word").select("doc", "pos", "value")
    return at_once.unionByName(moved)


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each document, without special tokens.

    Null and empty texts give an empty list. A null ``doc_id`` is a key like any other; exact repetitions of a row
    give one row, and one id with several texts gives a row for each text.
    """
    path = path or vocabulary_path()
    texts = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text, F.reverse(text)).alias("form")).alias("doc"), F.col(text).alias("text"))
    rows = _joined(texts, path, F.col("ids")).unionByName(
        texts.select("doc", F.lit(-1).alias("pos"), F.array().cast("array<int>").alias("value"))
    )
    gathered = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("all"))
    once = F.transform("all", lambda x, i: F.when((i > 0) & (F.get("all", i - 1)["pos"] == x["pos"]), F.array().cast("array<int>")).otherwise(x["value"]))
    return gathered.select(F.col("doc.id").alias(doc_id), F.flatten(once).alias("ids"))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens): size of each document whose text and source are not null; repeated rows once.

    Sums are combined before the shuffle, since the pieces of a document lie together.
    """
    path = path or vocabulary_path()
    texts = docs.where("text is not null and source is not null").select(
        F.struct("doc_id", "source", F.xxhash64("text", F.reverse("text")).alias("form")).alias("doc"), "text"
    ).dropDuplicates(["doc"])
    sizes = _joined(texts, path, F.size("ids").cast("long")).unionByName(texts.select("doc", F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("value")))
    return sizes.groupBy("doc").agg(F.sum("value").alias("n_tokens")).select("doc.doc_id", "doc.source", "n_tokens")


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, text): the inverse of :func:`encode_corpus`, by a join with the token-byte table.

    The table has one row per token of the vocabulary, some 50,000, and is broadcast. Null lists give null texts.
    """
    path = path or vocabulary_path()
    spark = encoded.sparkSession
    tokens = spark.createDataFrame(
        [(i, b) for b, i in _encoding(path)._mergeable_ranks.items()],
        StructType([StructField("id", IntegerType()), StructField("bytes", BinaryType())]),
    )
    rows = encoded.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64("ids").alias("form")).alias("doc"), "ids")
    parts = rows.where("size(ids) > 0").select("doc", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(tokens), "id")
    joined = parts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("bytes")))).alias("all"))
    text = F.decode(F.unhex(F.array_join(F.transform("all", lambda x: x["bytes"]), "")), "UTF-8")
    return joined.select(F.col("doc.id").alias(doc_id), text.alias("text")).unionByName(
        rows.where("coalesce(size(ids), 0) <= 0").select(F.col("doc.id").alias(doc_id), F.when(F.col("ids").isNotNull(), "").alias("text"))
    )
