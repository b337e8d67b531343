"""Corpus tables: ingest with positions, unique keys, pages, lookups, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.runtime import keep


class DuplicateKeys(ValueError):
    """Rows to be stored repeat a key that must be unique."""


def scan_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def scan_queries(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "text")


def scan_qrels(qrels: DataFrame) -> DataFrame:
    return qrels.select("query_id", "doc_id", "relevance")


def counts(documents: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: documents, queries, qrels and whether there are judgments. Counts come from the file footers."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(documents, "documents").join(one(queries, "queries")).join(one(qrels, "qrels")).withColumn("has_qrels", F.col("qrels") > 0)


def document_text(title: Column, *bodies: Column) -> Column:
    """Title and the first body that is not blank, separated by a space; empty when all are missing."""
    body = F.coalesce(*[F.when(F.trim(b) != "", b) for b in bodies])
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))


def with_positions(rows: DataFrame, order: Sequence[str], position: str = "seq", within: str | None = "dataset") -> DataFrame:
    """Rows with a zero-based position in a total order, within each dataset.

    Positions are offsets of range partitions plus a running number within each, so a dataset of any size is
    numbered by many tasks: the partition sizes, one row a partition, are all that is gathered.
    """
    key = [within] if within else []
    # written once: both branches below must see the same partitioning
    parted = keep(rows.repartitionByRange(*key, *order).withColumn("_p", F.spark_partition_id()), "parted")
    local = Window.partitionBy("_p", *key).orderBy(*order)
    numbered = parted.withColumn("_n", F.row_number().over(local) - 1)
    before = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1) if key else Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("_p", *key).count().withColumn("_o", F.coalesce(F.sum("count").over(before), F.lit(0))).select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k_{k}") for k in key], "_o")
    same = F.col("_p") == F.col("_q")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return numbered.join(F.broadcast(sizes), same).withColumn(position, (F.col("_n") + F.col("_o")).cast("bigint")).drop("_p", "_n", "_q", "_o", *[f"_k_{k}" for k in key])


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def store(rows: DataFrame, path: str, key: Sequence[str], order: str = "seq") -> None:
    """Write a table partitioned by dataset and sorted by position; repeated keys are refused before anything is written.

    Rows are range-partitioned by dataset and position, so a large dataset is written by many tasks.
    """
    first = duplicate_keys(rows, key).first()
    if first is not None:
        raise DuplicateKeys(f"repeated key: {first.asDict()}")
    rows.repartitionByRange("dataset", order).sortWithinPartitions("dataset", order).write.partitionBy("dataset").parquet(path)


def page(rows: DataFrame, offset: int, limit: int, dataset: str | None = None) -> DataFrame:
    """Rows with ``offset <= seq < offset + limit`` in order: a range on a stored column, which prunes row groups."""
    rows = rows.where((F.col("seq") >= offset) & (F.col("seq") < offset + limit))
    return (rows if dataset is None else rows.where(F.col("dataset") == dataset)).orderBy("seq")


def by_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(pos, doc_id, text) for the requested (pos, doc_id): order and repetitions of the request are kept."""
    return ids.join(docs.select("doc_id", "text"), "doc_id").select("pos", "doc_id", "text")


def missing_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(docs.select("doc_id"), "doc_id", "left_anti").select("pos", "doc_id")


def nested_qrels(qrels: DataFrame) -> DataFrame:
    """(query_id, judged map of doc_id to relevance): the latest position decides a repeated judgment."""
    last = qrels.where("query_id is not null and doc_id is not null").groupBy("query_id", "doc_id").agg(F.max_by("relevance", F.struct("seq", "dataset")).alias("relevance"))
    return last.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_id", "relevance")))).alias("judged"))


def status(documents: DataFrame, queries: DataFrame, qrels: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Rows of each dataset by table; with ``expected`` (dataset, doc_count), whether all documents have arrived."""
    count = lambda df, name: df.groupBy("dataset").agg(F.count(F.lit(1)).alias(name))
    out = count(documents, "documents").join(count(queries, "queries"), "dataset", "full").join(count(qrels, "qrels"), "dataset", "full").fillna(0)
    if expected is not None:
        out = out.join(expected, "dataset", "left").withColumn("complete", F.coalesce(F.col("documents") >= F.col("doc_count"), F.lit(False))).drop("doc_count")
    return out


def parse_catalog(text: Column) -> Column:
    """Entries of a comma list: trimmed, blanks dropped, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def safe_name(dataset: Column) -> Column:
    """A dataset id as part of a file name."""
    return F.regexp_replace(dataset, "[/:]", "__")
