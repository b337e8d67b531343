"""The inverted index as three tables, and Boolean matching over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.records import record_terms
from corvane.runtime import forget, keep, spread


@dataclass
class Index:
    """postings (doc_id, term, tf, dl), doc_stats (doc_id, dl) and terms (term, df, cf); documents without tokens keep length 0.

    A posting carries the length of its document, so ranking joins no document table.
    """

    postings: DataFrame
    doc_stats: DataFrame
    terms: DataFrame

    def stats(self) -> DataFrame:
        """One row: num_docs, vocab_size, num_postings, total_tokens, avg_doc_length (0 for an empty index)."""
        docs = self.doc_stats.agg(F.count(F.lit(1)).alias("num_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_doc_length"))
        terms = self.terms.agg(F.count(F.lit(1)).alias("vocab_size"), F.coalesce(F.sum("df"), F.lit(0)).alias("num_postings"))
        return docs.join(terms).select("num_docs", "vocab_size", "num_postings", "total_tokens", F.round("avg_doc_length", 6).alias("avg_doc_length"))


def tokenised(docs: DataFrame, analyzer, text: str = "text") -> DataFrame:
    """(doc_id, tokens): analyse once, derive everything else from it."""
    return spread(docs.select("doc_id", F.col(text).alias("_text"))).select("doc_id", analyzer(F.col("_text")).alias("tokens"))


def build_index(tokens: DataFrame) -> Index:
    """The index of (doc_id, tokens). Postings are counted within each document; only term statistics are shuffled."""
    sized = tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens")
    postings = record_terms(sized, ["doc_id", "dl"], F.col("tokens")).select("doc_id", "term", "tf", "dl")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return Index(postings, sized.select("doc_id", "dl"), terms)


def kept_index(tokens: DataFrame) -> Index:
    """:func:`build_index` written to the shared folder: texts are analysed once, however many rankings follow."""
    tokens = keep(tokens, "index_tokens")
    postings = keep(build_index(tokens).postings, "index_postings")
    empty = keep(tokens.where(F.size("tokens") == 0).select("doc_id", F.lit(0).cast("long").alias("dl")), "index_empty")
    forget(tokens)
    stats = postings.groupBy("doc_id").agg(F.first("dl").alias("dl")).unionByName(empty)
    return Index(postings, keep(stats, "index_stats"), keep(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "index_terms"))


def query_terms(queries: DataFrame, analyzer, text: str = "text") -> DataFrame:
    """(query_id, term, qtf) of analysed queries; queries without a term have no row."""
    return record_terms(queries.select("query_id", analyzer(F.col(text)).alias("tokens")), ["query_id"], F.col("tokens")).withColumnRenamed("tf", "qtf")


def postings_of(index: Index, term: str, limit: int = 100) -> DataFrame:
    """(doc_id, tf, df, cf) of one term in document order; df and cf are over all documents, whatever the limit."""
    return index.postings.where(F.col("term") == term).join(F.broadcast(index.terms.where(F.col("term") == term)), "term").select("doc_id", "tf", "df", "cf").orderBy("doc_id").limit(limit)


def boolean_match(index: Index, terms: DataFrame, operator: str = "and") -> DataFrame:
    """(query_id, doc_id, matched) for (query_id, term): ``matched`` distinct query terms occur in the document.

    ``and`` keeps documents that hold every term of the query, so an unknown term or an empty query matches nothing;
    ``or`` keeps all.
    """
    if operator not in ("and", "or"):
        raise ValueError("operator is 'and' or 'or'")
    wanted = terms.select("query_id", "term").distinct()
    hit = index.postings.select("term", "doc_id").join(wanted, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("matched"))
    if operator == "or":
        return hit
    need = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    return hit.join(need, "query_id").where("matched = need").drop("need")


def boolean_top(matches: DataFrame, k: int) -> DataFrame:
    """The first k matches of each query, most terms first, then smaller doc_id, with the number of all matches."""
    # the number is an aggregate of its own, so that the limit of each query can be applied before the shuffle
    ranked = matches.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("matched"), "doc_id"))).where(F.col("rank") <= k)
    return ranked.join(matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("total")), "query_id").select("query_id", "doc_id", "matched", "rank", "total")


def matched_terms(index: Index, queries: DataFrame, analyzer, text: str = "text") -> DataFrame:
    """(query_id, pos, term, df): distinct query terms in first-seen order, df 0 for unknown ones."""
    found = queries.select("query_id", F.posexplode(F.array_distinct(analyzer(F.col(text)))).alias("pos", "term"))
    return found.join(index.terms.select("term", "df"), "term", "left").select("query_id", F.col("pos").cast("long").alias("pos"), "term", F.coalesce("df", F.lit(0)).alias("df"))


def top_k(scores: DataFrame, k: int, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(key, item, score, rank): the k best of each key, ties by the smaller item.

    Scores are rounded to six places before they are ranked, so sums taken in another order rank alike.
    """
    rounded = scores.select(key, item, F.round("score", 6).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), item)
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def number(value: float) -> Column:
    """A double literal; a decimal one would round sums differently."""
    return F.lit(float(value))
