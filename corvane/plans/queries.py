"""The core queries by name."""

from __future__ import annotations

from corvane.operators import references
from corvane.plans import corpus, evaluation, models, ranking
from corvane.sources.tables import table

REFERENCE_TABLES = ("documents", "queries", "qrels", "subject_labels", "deleted_keys")


def _broken(spark, d):
    return references.broken_references({n: table(spark, d, n) for n in REFERENCE_TABLES})


def p5_found(spark, d):
    return _broken(spark, d).drop("at")


def p5_report(spark, d):
    """Number of broken references per table, column, kind and month."""
    return references.orphan_report(_broken(spark, d))


OWN = {f.__name__: f for f in (p5_found, p5_report)}
QUERIES = OWN | corpus.QUERIES | ranking.QUERIES | evaluation.QUERIES | models.QUERIES


def sql() -> dict[str, str]:
    return _own_sql() | corpus.sql() | ranking.sql() | evaluation.sql() | models.sql()


def _own_sql() -> dict[str, str]:
    def part(name, column, of, time, arrival):
        same = f"t.dataset = r.dataset AND t.{column} = r.{column}"
        return f"""SELECT '{name}' AS table_name, r.dataset, r.seq, '{column}' AS ref_column, r.{time} AS moment,
  CASE WHEN EXISTS (SELECT 1 FROM {of} t WHERE {same}) THEN 'late'
       WHEN EXISTS (SELECT 1 FROM deleted_keys t WHERE t.table_name = '{of}' AND {same}) THEN 'deleted' ELSE 'missing' END AS kind
FROM {name} r WHERE r.{column} IS NOT NULL AND
  (NOT EXISTS (SELECT 1 FROM {of} t WHERE {same}) OR r.{time} < (SELECT min(t.{arrival}) FROM {of} t WHERE {same}))"""

    broken = " UNION ALL ".join(
        (
            part("qrels", "doc_id", "documents", "judged_at", "ingested_at"),
            part("qrels", "query_id", "queries", "judged_at", "created_at"),
            part("subject_labels", "doc_id", "documents", "labelled_at", "ingested_at"),
        )
    )
    return {
        "p5_found": f"SELECT table_name, dataset, seq, ref_column, kind FROM ({broken})",
        "p5_report": f"SELECT table_name, ref_column, kind, strftime(moment, '%Y-%m') AS month, count(*) AS orphans FROM ({broken}) GROUP BY ALL",
    }
