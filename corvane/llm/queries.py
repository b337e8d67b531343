"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.llm import canonical, clusters, encoding, mixing, neardup, subjects, terms, topn
from corvane.runtime import keep
from corvane.sources.tables import table

N_BEST = 10


def p1_groups(spark, d):
    """Every document of 60 words or more, its class of equal word bags, and the number of its links to other classes."""
    members, pairs = neardup.near_duplicates(table(spark, d, "documents"))
    ends = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "rep", "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p1_found(spark, d):
    return neardup.document_pairs(*neardup.near_duplicates(table(spark, d, "documents")))


def p2_topn(spark, d):
    """The ten best documents of each run and judged query, with score and rank."""
    return topn.top_n(table(spark, d, "search_hits"), ["run_label", "query_id"], "doc_id", "score", N_BEST, table(spark, d, "qrels").select("query_id"))


def p2_found(spark, d):
    return p2_topn(spark, d).select("run_label", "query_id", "doc_id")


def p3_terms(spark, d):
    """Occurrences and documents of every term."""
    return terms.term_frequencies(table(spark, d, "documents"))


def p3_found(spark, d):
    return terms.excluded_terms(table(spark, d, "documents"), table(spark, d, "tfidf_params")).select("param_set", "term", "mark")


def p4_text(spark, d):
    """The consistent form of every text of documents and queries."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("key"), canonical.canonical(F.col("text")).alias("text"))
    return docs.unionByName(table(spark, d, "queries").select(F.lit("queries").alias("table_name"), F.col("query_id").alias("key"), canonical.canonical(F.col("text")).alias("text")))


def p4_classes(spark, d):
    """Every row of documents and queries with the class of its look and of its stored form: the membership of any number of copies."""
    docs = canonical.look_classes(table(spark, d, "documents"), "doc_id").select(F.lit("documents").alias("table_name"), "key", "look", "form")
    return docs.unionByName(canonical.look_classes(table(spark, d, "queries"), "query_id").select(F.lit("queries").alias("table_name"), "key", "look", "form"))


def p4_found(spark, d):
    docs = canonical.same_look(table(spark, d, "documents"), "doc_id").select(F.lit("documents").alias("table_name"), "key_a", "key_b")
    return docs.unionByName(canonical.same_look(table(spark, d, "queries"), "query_id").select(F.lit("queries").alias("table_name"), "key_a", "key_b"))


def p6_clusters(spark, d):
    """Every cluster with its size, top terms and typical members."""
    return clusters.describe_clusters(keep(p6_members(spark, d), "members"), table(spark, d, "documents"))


def p6_members(spark, d):
    areas = keep(subjects.subject_mixtures(*_areas(spark, d))[0], "areas")
    return clusters.thing_clusters(table(spark, d, "documents"), areas)


def p6_found(spark, d):
    return clusters.cluster_pairs(keep(p6_members(spark, d), "members"))


def p7_ids(spark, d):
    return encoding.encode_corpus(table(spark, d, "documents"))


def p7_round_trip(spark, d):
    """Documents whose decoded ids are not their text: none."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.join(encoding.decode_corpus(encoding.encode_corpus(docs)).withColumnRenamed("text", "decoded"), "doc_id", "left").where("decoded is distinct from text").select("doc_id")


def _mix(spark, d):
    return table(spark, d, "mix_targets"), keep(encoding.token_counts(table(spark, d, "documents")), "sizes")


def p8_shares(spark, d):
    """Target and actual shares of every mix and source."""
    return mixing.shares(*_mix(spark, d))


def p8_order(spark, d):
    """The documents of every mix in training order."""
    return mixing.curriculum(*_mix(spark, d))


def p8_order_tilted(spark, d):
    """The same with shares that vary over time: large sources first, small ones last."""
    targets, sizes = _mix(spark, d)
    return mixing.curriculum(targets, sizes, mixing.tilted_schedule(targets))


def p8_shares_tilted(spark, d):
    """The same shares where large sources come first and small ones last."""
    targets, sizes = _mix(spark, d)
    return mixing.shares(targets, sizes, mixing.tilted_schedule(targets))


def p8_found(spark, d):
    return mixing.plan(*_mix(spark, d)).where("short").select("mix_id", "source")


def _areas(spark, d):
    return table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects")


def p9_found(spark, d):
    return subjects.subject_areas(*_areas(spark, d))


def p9_composition(spark, d):
    """Documents of each subject area, and the sum of their shares."""
    shares = subjects.subject_mixtures(*_areas(spark, d))[0]
    return shares.groupBy("subject").agg(F.sum(F.when(F.col("share") >= subjects.SHARE, 1).otherwise(0)).alias("documents"), F.sum("share").alias("weight"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_topn, p3_found, p3_terms, p4_found, p4_classes, p4_text, p6_found, p6_members, p6_clusters, p7_ids, p7_round_trip, p8_found, p8_shares, p8_shares_tilted, p8_order, p8_order_tilted, p9_found, p9_composition)}


def sql() -> dict[str, str]:
    from corvane.plans.sqltext import sql_tokens

    best = """WITH best AS (
  SELECT run_label, query_id, doc_id, max(score) AS score FROM search_hits
  WHERE score IS NOT NULL AND NOT isnan(score) AND doc_id IS NOT NULL AND query_id IN (SELECT query_id FROM qrels WHERE query_id IS NOT NULL)
  GROUP BY run_label, query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_label, query_id ORDER BY score DESC, doc_id) AS rank FROM best)
"""
    counted = f"""WITH found AS (SELECT unnest({sql_tokens('text')}) AS term, rowid_ FROM (SELECT text, row_number() OVER () AS rowid_ FROM documents)),
freq AS (SELECT term, count(*) AS cf, count(DISTINCT rowid_) AS df FROM found GROUP BY term)
"""
    return {
        "p2_found": best + "SELECT run_label, query_id, doc_id FROM ranked WHERE rank <= 10",
        "p2_topn": best + "SELECT run_label, query_id, doc_id, score, rank::INT AS rank FROM ranked WHERE rank <= 10",
        "p3_terms": counted + "SELECT term, cf, df FROM freq",
        "p3_found": counted
        + """, n AS (SELECT count(text) AS n FROM documents)
SELECT param_set, term, 'rare' AS mark FROM freq, tfidf_params WHERE df < min_df
UNION ALL SELECT param_set, term, 'common' AS mark FROM freq, tfidf_params, n WHERE df > max_df * n""",
        "p7_round_trip": "SELECT doc_id FROM documents WHERE false",
    }
