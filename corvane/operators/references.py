"""References to records that do not exist: composite keys with partial nulls."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = ("strict", "simple", "partial", "full")


def orphans(refs: DataFrame, keys: DataFrame, columns: Sequence[str], match: str = "simple") -> DataFrame:
    """The rows of ``refs`` whose composite key ``columns`` is not in ``keys``; the columns of ``refs`` are kept.

    References are grouped by null mask, and each mask is anti-joined on its non-null columns. ``match`` says
    what a null means, as in the SQL standard:

    * ``simple``: a key with any null refers to nothing and is never an orphan;
    * ``partial``: the non-null columns must occur together in some key; all null is no orphan;
    * ``full``: all null is no orphan, a key with only some nulls always is;
    * ``strict``: a null equals no key, so every key with a null is an orphan.

    Keys are made distinct per mask; null keys match nothing. Other columns of ``keys`` are ignored, whatever
    their names. Repeated references are reported as often as they occur.
    """
    if match not in MATCH:
        raise ValueError(f"match is one of {MATCH}")
    out = None
    for mask in product((True, False), repeat=len(columns)):
        there = [c for c, m in zip(columns, mask) if m]
        if not all(mask):
            if match == "simple" or (not there and match != "strict"):
                continue
        part = refs
        for c, m in zip(columns, mask):
            part = part.where(F.col(f"`{c}`").isNotNull() if m else F.col(f"`{c}`").isNull())
        if all(mask) or match == "partial":
            part = part.join(keys.select(*there).dropna().distinct(), there, "left_anti")
        out = part if out is None else out.unionByName(part)
    return out


def classify(
    refs: DataFrame, keys: DataFrame, deleted: DataFrame, columns: Sequence[str], ref_time: str, key_time: str
) -> DataFrame:
    """Broken references with their ``kind``: ``missing``, ``deleted`` or ``late``.

    A reference without a key is ``deleted`` when ``deleted`` lists the key, else ``missing``. A reference whose key
    arrived after ``ref_time`` is ``late``; a null on either side is never late. If a key occurs more than
    once, its earliest arrival counts. A row whose last key column is null refers to nothing; a null in an earlier
    column (the dataset) equals no key, so such a reference is lost (strict match).
    """
    names = list(columns)
    refs = refs.where(F.col(names[-1]).isNotNull())
    lost = orphans(refs, keys, names, "strict")
    gone = deleted.select(*names).dropna().distinct().withColumn("_gone", F.lit(True))
    lost = lost.join(gone, names, "left").withColumn("kind", F.when(F.col("_gone"), "deleted").otherwise("missing")).drop("_gone")
    arrived = keys.select(*names, F.col(key_time).alias("_arrived")).dropna().groupBy(*names).agg(F.min("_arrived").alias("_arrived"))
    late = refs.join(arrived, names).where(F.col("_arrived") > F.col(ref_time)).drop("_arrived").withColumn("kind", F.lit("late"))
    return lost.unionByName(late)


def broken_references(tables: dict[str, DataFrame]) -> DataFrame:
    """Every broken reference of ``qrels`` and ``subject_labels``: (table_name, dataset, seq, ref_column, kind, at).

    The key of a reference is its dataset together with ``doc_id`` or ``query_id``; ``at`` is the time of the reference.
    """
    documents, queries, deleted = tables["documents"], tables["queries"], tables["deleted_keys"]
    out = None
    for name, time, target, column, arrival in (
        ("qrels", "judged_at", documents, "doc_id", "ingested_at"),
        ("qrels", "judged_at", queries, "query_id", "created_at"),
        ("subject_labels", "labelled_at", documents, "doc_id", "ingested_at"),
    ):
        of = "documents" if column == "doc_id" else "queries"
        refs = tables[name].select("dataset", "seq", column, F.col(time).alias("at"))
        keys = target.select("dataset", column, F.col(arrival).alias("arrival"))
        gone = deleted.where(F.col("table_name") == of).select("dataset", column)
        found = classify(refs, keys, gone, ("dataset", column), "at", "arrival").select(
            F.lit(name).alias("table_name"), "dataset", "seq", F.lit(column).alias("ref_column"), "kind", "at"
        )
        out = found if out is None else out.unionByName(found)
    return out


def orphan_report(broken: DataFrame) -> DataFrame:
    """Number of broken references by table, column, kind and month; the month is null where the time is."""
    return broken.groupBy("table_name", "ref_column", "kind", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orphans")
    )
