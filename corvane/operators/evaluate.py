"""Effectiveness of runs against judgments, and comparisons of reports."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.runtime import keep

METRICS = ("map", "ndcg@10", "recall@100", "precision@10")
SAME = 1e-6


def parse_metric(name: str) -> tuple[str, int | None]:
    """``name`` or ``name@k``; ``p`` is precision. A cut-off of 0 and unknown names are errors, found before anything runs."""
    m = re.fullmatch(r"(map|ndcg|recall|precision|p)(?:@([0-9]+))?", name)
    if not m or m[2] is not None and int(m[2]) == 0:
        raise ValueError(f"unknown metric {name!r}")
    kind = "precision" if m[1] == "p" else m[1]
    return kind, int(m[2]) if m[2] else (10 if kind == "precision" else None)


def judgments(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance): one grade for each pair, the last delivered; null ids and grades judge nothing."""
    rows = qrels.where("query_id is not null and doc_id is not null and relevance is not null")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("relevance", F.struct("seq", "dataset")).alias("relevance"))


def gold_queries(judged: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, text): judged queries that exist, the first ``most`` in string order."""
    gold = queries.select("query_id", "text").join(judged.select("query_id").distinct(), "query_id", "left_semi")
    return gold if most is None else gold.orderBy("query_id").limit(most)


def ranked(run: DataFrame, keys: list[str]) -> DataFrame:
    """A run with its rank by score, ties by doc_id; a document counts once, with its best score."""
    best = run.where("doc_id is not null and score is not null and not isnan(score)").groupBy(*keys, "doc_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")))


def _metric(kind: str, k: int | None, relevant: Column, rank: Column, grade: Column, gain) -> Column:
    inside = (rank <= k) if k else F.lit(True)
    if kind == "precision":
        return F.sum(F.when(relevant & inside, 1.0).otherwise(0.0)) / F.lit(float(k))
    if kind == "recall":
        return F.sum(F.when(relevant & inside, 1.0).otherwise(0.0))
    if kind == "map":
        return F.sum(F.when(relevant & inside, F.col("hits") / rank).otherwise(0.0))
    return F.sum(F.when(relevant & inside, gain(grade) / F.log2(rank + 1.0)).otherwise(0.0))


def evaluate(run: DataFrame, judged: DataFrame, gold: DataFrame, metrics=METRICS, linear: bool = False) -> DataFrame:
    """(run_label, query_id, metric, value) for every run and gold query; a query without hits scores 0.

    ``run`` is (run_label, query_id, doc_id, score). A grade above 0 is relevant. Precision divides by k; recall and average
    precision by all relevant documents, also with a cut-off; nDCG gains 2^grade - 1 (or the grade) over log2(rank + 1),
    and without a cut-off is cut at the retrieved depth, as recall is.
    """
    parsed = [(m, *parse_metric(m)) for m in metrics]
    if len(set(metrics)) != len(metrics):
        raise ValueError("a metric is repeated")
    gain = (lambda g: g.cast("double")) if linear else (lambda g: F.pow(F.lit(2.0), g) - 1.0)
    truth = judged.join(gold.select("query_id"), "query_id", "left_semi").where("relevance > 0")
    hits = ranked(run.join(gold.select("query_id"), "query_id", "left_semi"), ["run_label", "query_id"]).join(truth, ["query_id", "doc_id"], "left")
    order = Window.partitionBy("run_label", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    relevant = F.col("relevance").isNotNull()
    hits = hits.withColumn("hits", F.sum(F.when(relevant, 1.0).otherwise(0.0)).over(order))
    got = hits.groupBy("run_label", "query_id").agg(F.max("rank").alias("depth"), *[_metric(kind, k, relevant, F.col("rank"), F.col("relevance"), gain).alias(f"m{i}") for i, (_, kind, k) in enumerate(parsed)])
    ideal_rank = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    ideal = truth.withColumn("ir", F.row_number().over(ideal_rank)).withColumn("gain", gain(F.col("relevance")) / F.log2(F.col("ir") + 1.0))
    ideal = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.transform(F.sort_array(F.collect_list(F.struct("ir", "gain"))), lambda x: x["gain"]).alias("gains"))
    every = gold.select("query_id").distinct().join(run.select("run_label").distinct())
    rows = every.join(got, ["run_label", "query_id"], "left").join(ideal, "query_id", "left")

    def finished(i: int, kind: str, k: int | None) -> Column:
        value = F.coalesce(F.col(f"m{i}"), F.lit(0.0))
        if kind == "precision":
            return value
        if kind in ("recall", "map"):
            return F.when(F.col("relevant") > 0, value / F.col("relevant")).otherwise(0.0)
        best = F.aggregate(F.slice("gains", 1, F.lit(k) if k else F.greatest(F.coalesce("depth", F.lit(1)), F.lit(1))), F.lit(0.0), lambda s, x: s + x)
        return F.when(best > 0, value / best).otherwise(0.0)

    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(finished(i, kind, k), 6).alias("value")) for i, (m, kind, k) in enumerate(parsed)])
    return rows.select("run_label", "query_id", F.explode(values).alias("x")).select("run_label", "query_id", "x.metric", "x.value")


def report(per_query: DataFrame) -> DataFrame:
    """(run_label, metric, value): the mean over gold queries, to nine places."""
    return per_query.groupBy("run_label", "metric").agg(F.round(F.avg("value"), 9).alias("value"))


def best_per_metric(rep: DataFrame, labels=()) -> DataFrame:
    """(metric, run_label, value): the best run of each metric; of equals the first in ``labels``, the order of the runs, then by label."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("run_label")) if labels else F.lit(0)
    order = Window.partitionBy("metric").orderBy(F.desc("value"), F.when(place > 0, place).otherwise(len(labels) + 1), "run_label")
    return rep.withColumn("r", F.row_number().over(order)).where("r = 1").select("metric", "run_label", "value")


def report_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_label, metric, before, after, delta, direction) of two reports; within 1e-6 is ``same``."""
    both = before.select("run_label", "metric", F.col("value").alias("before")).join(after.select("run_label", "metric", F.col("value").alias("after")), ["run_label", "metric"])
    delta = F.round(F.col("after") - F.col("before"), 9)
    return both.withColumn("delta", delta).withColumn("direction", F.when(F.col("delta") > SAME, "up").when(F.col("delta") < -SAME, "down").otherwise("same"))


def depth_curves(rep: DataFrame) -> DataFrame:
    """(run_label, family, k, value) of metrics with two cut-offs or more."""
    parts = rep.where(F.contains("metric", F.lit("@"))).select("run_label", F.split("metric", "@")[0].alias("family"), F.split("metric", "@")[1].cast("int").alias("k"), "value")
    return parts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run_label", "family"))).where("n >= 2").drop("n")


def win_tie_loss(per_query: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, wins, ties, losses) of run a against run b over queries."""
    d = _difference(per_query, a, b)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return d.groupBy("metric").agg(one(F.col("diff") > SAME).alias("wins"), one(F.abs("diff") <= SAME).alias("ties"), one(F.col("diff") < -SAME).alias("losses"))


def _difference(per_query: DataFrame, a: str, b: str) -> DataFrame:
    x = per_query.where(F.col("run_label") == a).select("query_id", "metric", F.col("value").alias("a"))
    y = per_query.where(F.col("run_label") == b).select("query_id", "metric", F.col("value").alias("b"))
    return x.join(y, ["query_id", "metric"]).withColumn("diff", F.round(F.col("a") - F.col("b"), 6))


def top_differences(per_query: DataFrame, a: str, b: str, metric: str, n: int = 10) -> DataFrame:
    """The n queries on which two runs differ most."""
    return _difference(per_query, a, b).where(F.col("metric") == metric).orderBy(F.desc(F.abs("diff")), "query_id").limit(n).select("query_id", "a", "b", "diff")


def query_extremes(per_query: DataFrame, metric: str, n: int = 8) -> DataFrame:
    """(run_label, kind, place, query_id, value): the n worst and n best queries of each run."""
    rows = per_query.where(F.col("metric") == metric)
    out = None
    for kind, key in (("worst", F.asc("value")), ("best", F.desc("value"))):
        part = rows.withColumn("place", F.row_number().over(Window.partitionBy("run_label").orderBy(key, "query_id"))).where(F.col("place") <= n)
        part = part.select("run_label", F.lit(kind).alias("kind"), "place", "query_id", "value")
        out = part if out is None else out.unionByName(part)
    return out


def sweep_pivot(grid: DataFrame, k1: list[float]) -> DataFrame:
    """One row for each b, one column for each k1, of (k1, b, value)."""
    wide = grid.groupBy("b").pivot("k1", k1).agg(F.first("value"))
    return wide.select("b", *[F.col(f"`{x}`").alias(f"k1_{str(x).replace('.', '_')}") for x in k1])


def quality_latency(rep: DataFrame, latency: DataFrame, metric: str) -> DataFrame:
    """(run_label, value, avg_query_ms) in order of quality."""
    return rep.where(F.col("metric") == metric).join(latency, "run_label").select("run_label", "value", "avg_query_ms").orderBy(F.desc("value"), "avg_query_ms", "run_label")


def run_all(configs: dict, judged: DataFrame, gold: DataFrame, metrics=METRICS) -> tuple[DataFrame | None, dict[str, str], dict[str, float]]:
    """Per-query values of every configuration (label to a function that returns a run), the errors of those that fail and the
    mean milliseconds a gold query took in those that do not.

    Each run is written to the shared folder, since a plan only fails, and only takes time, when it is executed; the others go on. Labels are
    unique by construction; metrics are checked first, so that an unknown one fails before any run.
    """
    for m in metrics:
        parse_metric(m)
    runs, errors, took = None, {}, {}
    asked = gold.count()
    for label, make in configs.items():
        began = time.perf_counter()
        try:
            run = keep(make().select(F.lit(label).alias("run_label"), "query_id", "doc_id", F.col("score").cast("double").alias("score")), "run")
            took[label] = (time.perf_counter() - began) * 1000 / max(asked, 1)
            runs = run if runs is None else runs.unionByName(run)
        except Exception as e:
            errors[label] = str(e)
    return (None if runs is None else evaluate(runs, judged, gold, metrics)), errors, took
