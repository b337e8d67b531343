"""Hybrid search: fusion of runs, serial re-ranking, pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.index import top_k

RRF_K, CANDIDATES, MAX_MEMBERS = 60, 100, 50_000


def pool_size(k: int) -> int:
    """How deep each component ranks for a fused list of k."""
    return min(max(5 * k, 100), 1000)


def validate(mode: str, parts: list[str], weights: list[float] | None = None, first: str | None = None, rerank: str | None = None) -> None:
    """The rules of a hybrid search: fusion takes two components or more, and a weight for each if any; a serial search re-ranks with
    another model than it searches with."""
    if mode not in ("parallel", "serial"):
        raise ValueError("mode is 'parallel' or 'serial'")
    if mode == "parallel" and len(parts) < 2:
        raise ValueError("fusion needs two components or more")
    if mode == "parallel" and weights is not None and len(weights) != len(parts):
        raise ValueError("one weight for each component")
    if mode == "serial" and (not first or not rerank or first == rerank):
        raise ValueError("a serial search needs two different models")


def components(runs: list[DataFrame]) -> DataFrame:
    """Runs (query_id, doc_id, score, rank) as one table with their position ``component``."""
    validate("parallel", [str(i) for i in range(len(runs))])
    return reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "score", "rank", F.lit(i).alias("component")) for i, r in enumerate(runs)])


def _fused(parts: DataFrame, k: int) -> DataFrame:
    """Sum ``part``; equal sums keep the order in which the first component that holds the document ranked it."""
    fused = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score"), F.min(F.struct("component", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.component", "first.rank", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def fuse_rrf(runs: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (rrf_k + rank)."""
    return _fused(components(runs).withColumn("part", 1.0 / (F.lit(float(rrf_k)) + F.col("rank"))), k)


def fuse_weighted(runs: list[DataFrame], k: int, weights: list[float] | None = None) -> DataFrame:
    """Weighted sum of scores scaled to [0, 1] for each list; a list of equal scores counts 1, its minimum 0."""
    weights = [1.0] * len(runs) if weights is None else weights
    if len(weights) != len(runs):
        raise ValueError("one weight for each component")
    w = Window.partitionBy("query_id", "component")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    scaled = components(runs).withColumn("lo", lo).withColumn("hi", hi)
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    weight = reduce(lambda acc, x: acc.when(F.col("component") == x[0], F.lit(float(x[1]))), enumerate(weights), F.when(F.lit(False), F.lit(0.0)))
    return _fused(scaled.withColumn("part", weight * norm), k)


def serial(first: DataFrame, rescored: DataFrame, k: int) -> DataFrame:
    """The first stage's candidates in the order of the second; candidates the second does not know are dropped.

    A query of which the second knows no candidate keeps the first stage's order and scores.
    """
    pool = first.select("query_id", "doc_id")
    known = rescored.join(pool, ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "score")
    rest = first.join(known.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "doc_id", "score")
    return top_k(known.unionByName(rest), k)


def prune(clusters: DataFrame | None, topics: DataFrame | None, item: str = "doc_id") -> DataFrame | None:
    """Candidates (query_id, item) in both member sets, or in either for a query whose sets do not meet; None is no limit."""
    if clusters is None or topics is None:
        return clusters if topics is None else topics
    a, b = clusters.select("query_id", item).distinct(), topics.select("query_id", item).distinct()
    both = a.join(b, ["query_id", item], "left_semi")
    either = a.unionByName(b).distinct().join(both.select("query_id").distinct(), "query_id", "left_anti")
    return both.unionByName(either)


def nearest_members(order: DataFrame, members: DataFrame, n: int, cap: int = MAX_MEMBERS) -> DataFrame:
    """(query_id, doc_id, pos): members of the n nearest groups, nearest group first, at most ``cap`` for each query.

    ``order`` is (query_id, group_id, distance), ``members`` (group_id, doc_id). The cap is the size of the search space the
    caller asks for.
    """
    near = order.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "group_id"))).where(F.col("r") <= n)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("r", "doc_id"))
    return near.join(members, "group_id").withColumn("pos", pos).where(F.col("pos") <= cap).select("query_id", "doc_id", "pos")


def with_text(run: DataFrame, docs: DataFrame) -> DataFrame:
    """A run with the stored text of its documents; null for a document that is not there."""
    return run.join(docs.select("doc_id", "text"), "doc_id", "left").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "text")
