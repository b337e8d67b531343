"""Scans of the stored tables, with the schema their files state, and the schemas they are expected to have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "doc_id BIGINT, dataset STRING, seq BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, ingested_at TIMESTAMP_NTZ",
    "queries": "dataset STRING, seq BIGINT, query_id STRING, text STRING, created_at TIMESTAMP_NTZ",
    "qrels": "dataset STRING, seq BIGINT, query_id STRING, doc_id BIGINT, relevance INT, judged_at TIMESTAMP_NTZ",
    "search_hits": "dataset STRING, run_label STRING, query_id STRING, doc_id BIGINT, score DOUBLE, rank INT, scored_at TIMESTAMP_NTZ",
    "deleted_keys": "dataset STRING, table_name STRING, doc_id BIGINT, query_id STRING, deleted_at TIMESTAMP_NTZ",
    "subject_labels": "dataset STRING, seq BIGINT, doc_id BIGINT, subject STRING, labelled_at TIMESTAMP_NTZ",
    "subjects": "subject STRING, description STRING",
    "tfidf_params": "param_set STRING, min_df INT, max_df DOUBLE, sublinear_tf BOOLEAN",
    "mix_targets": "mix_id STRING, source STRING, weight DOUBLE, max_repeats INT",
    "cluster_info": "dataset STRING, cluster_id INT, size BIGINT, top_terms ARRAY<STRING>, built_at TIMESTAMP_NTZ",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def months(column):
    """Calendar month of a timestamp, as yyyy-MM."""
    return F.date_format(column, "yyyy-MM")
