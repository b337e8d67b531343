"""Frequency of every distinct term, and the terms that parameter rows exclude."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.records import record_terms
from corvane.functions.text import words
from corvane.runtime import rows_of, spread


def term_frequencies(rows: DataFrame, text: str = "text") -> DataFrame:
    """(term, cf, df): occurrences of each term and the number of records that hold it.

    Null and empty texts hold no term. Repeated rows count as often as they are there. The only shuffle moves one
    partially summed row per term and map task; a term held by every record arrives as one row per task.
    """
    return record_terms(spread(rows.select(F.col(text).alias("_text"))), [], words(F.col("_text"))).groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def excluded_terms(rows: DataFrame, params: DataFrame, text: str = "text") -> DataFrame:
    """(param_set, term, mark, cf, df): per parameter row, terms in fewer than ``min_df`` records (``rare``) or in more
    than ``max_df`` x N (``common``); N counts the records with a non-null text. A term may carry both marks.

    ``params`` is a settings table of at most 1,000 rows (more is an error): its bounds become literals, so the
    term table is passed over once. A null bound excludes nothing.
    """
    n = rows.where(F.col(text).isNotNull()).count()
    checks = []
    for p in rows_of(params.select("param_set", "min_df", "max_df").distinct(), 1000):
        for mark, test in (
            ("rare", F.lit(p.min_df).cast("bigint") > F.col("df")),
            ("common", F.col("df") > F.lit(None if p.max_df is None else p.max_df * n).cast("double")),
        ):
            checks.append(F.when(test, F.struct(F.lit(p.param_set).cast("string").alias("param_set"), F.lit(mark).alias("mark"))))
    none = F.lit(None).cast("struct<param_set:string,mark:string>")
    marked = term_frequencies(rows, text).withColumn("m", F.explode(F.filter(F.array(none, *checks), lambda x: x.isNotNull())))
    return marked.select("m.param_set", "term", "m.mark", "cf", "df")
