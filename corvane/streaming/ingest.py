"""Incremental indexing: files that arrive are analysed once and appended to the postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.index import build_index, tokenised


def append_postings(batch: DataFrame, batch_id: int, path: str, analyzer) -> None:
    """Write the postings of one micro-batch under its own number, so that a batch that runs again replaces itself."""
    build_index(tokenised(batch, analyzer)).postings.drop("dl").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def start_index_stream(spark: SparkSession, source: str, path: str, progress: str, analyzer, files: int = 1000):
    """A query that indexes new document files (doc_id, text) of a folder; it stops when none is left."""
    arrivals = spark.readStream.schema("doc_id BIGINT, text STRING").option("maxFilesPerTrigger", files).parquet(source)
    return (
        arrivals.writeStream.foreachBatch(lambda df, n: append_postings(df, n, path, analyzer))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def postings_of_stream(spark: SparkSession, source: str, path: str, progress: str, analyzer) -> DataFrame:
    """Run the stream over what is there and return all postings."""
    start_index_stream(spark, source, path, progress, analyzer).awaitTermination()
    return spark.read.parquet(path).select("doc_id", "term", "tf")
