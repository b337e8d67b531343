"""Queries of fitted models: clusters, topics, word vectors; and of incremental indexing."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from corvane.functions.text import STOP_WORDS, content_tokens
from corvane.operators import groups
from corvane.operators import index as ix
from corvane.plans.common import ANALYZER, sql_list
from corvane.runtime import keep, new_path
from corvane.sources.tables import table


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _content(s, d):
    return groups.not_blank(_docs(s, d)).select("doc_id", content_tokens(F.col("text")).alias("tokens"))


def _state(s, d) -> tuple:
    """What is stored as ``documents``: a model answers only for the very files it was fitted on."""
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    fs = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


@lru_cache(maxsize=2)
def _fitted_clusters(s, d, state):
    return groups.fit_clusters(_docs(s, d), k=8)


@lru_cache(maxsize=2)
def _fitted_topics(s, d, state):
    return groups.fit_topics(_docs(s, d), topics=10)


def _clusters(s, d):
    return _fitted_clusters(s, d, _state(s, d))


def _topics(s, d):
    return _fitted_topics(s, d, _state(s, d))


def topic_infer(s, d):
    _, model, vectors = _topics(s, d)
    return groups.topic_mixtures(model, vectors)


def topic_sizes(s, d):
    return groups.group_sizes(topic_infer(s, d).where("topic >= 0"), s.range(10).select(F.col("id").cast("int").alias("topic")), "topic")


def topic_terms(s, d):
    terms, model, _ = _topics(s, d)
    return groups.topic_terms(terms, model)


def lda(s, d):
    """Perplexity of the fit."""
    import math

    _, model, vectors = _topics(s, d)
    return s.createDataFrame([(10, math.exp(model.logPerplexity(vectors)))], "topics int, perplexity double")


def topic_label(s, d):
    """Labels of the stored clusters from their distinct terms."""
    terms = F.array_distinct(F.filter("top_terms", lambda t: t.isNotNull()))
    return table(s, d, "cluster_info").select("dataset", "cluster_id", "size", groups.topic_label(F.coalesce(terms, F.array().cast("array<string>"))).alias("label"))


def lsa(s, d):
    c = _clusters(s, d)
    rows = [(t, [float(x) for x in v]) for t, v in zip(c.vocabulary, c.components)]
    return s.createDataFrame(rows, "term string, components array<double>")


def kmeans(s, d):
    c = _clusters(s, d)
    return s.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c.model.clusterCenters())], "cluster int, centre array<double>")


def w2v_build(s, d):
    tokens = keep(ix.tokenised(_docs(s, d), ANALYZER), "tokens")
    model = groups.fit_word_vectors(tokens)
    return groups.word_vector_documents(model, tokens)


def stream_postings(s, d):
    """The index as a stream builds it, one batch of files after another, equals the index built at once."""
    from corvane.streaming.ingest import postings_of_stream

    source = new_path(s, "arrivals")
    table(s, d, "documents").select("doc_id", "text").repartition(3, "doc_id").write.parquet(source)
    return postings_of_stream(s, source, new_path(s, "postings"), new_path(s, "progress"), ANALYZER)


QUERIES = {
    "cluster_vocab": lambda s, d: groups.vocabulary(_content(s, d), features=20_000),
    "topic_vocab": lambda s, d: groups.vocabulary(_content(s, d), 2, 0.5, 20_000),
    "nonblank": lambda s, d: groups.not_blank(_docs(s, d)).select("doc_id"),
    "lsa": lsa,
    "kmeans": kmeans,
    "cluster_members": lambda s, d: _clusters(s, d).members(),
    "cluster_assign": lambda s, d: _clusters(s, d).assign(),
    "cluster_terms": lambda s, d: _clusters(s, d).terms(),
    "cluster_plot": lambda s, d: _clusters(s, d).points(),
    "lda": lda,
    "topic_terms": topic_terms,
    "topic_infer": topic_infer,
    "topic_sizes": topic_sizes,
    "topic_label": topic_label,
    "w2v_build": w2v_build,
    "stream_postings": stream_postings,
}


def sql() -> dict[str, str]:
    from corvane.plans.common import sql_index

    content = f"coalesce(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({sql_list(STOP_WORDS)}, t)), [])"
    vocab = f"""WITH t AS (SELECT doc_id, {content} AS tokens FROM documents WHERE regexp_matches(text, '\\S')), n AS (SELECT count(*)::DOUBLE AS n FROM t),
v AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(tokens) AS term FROM t) GROUP BY term)
SELECT term, df, cf FROM v, n WHERE df >= 2 AND df <= SHARE::DOUBLE * n ORDER BY cf DESC, term LIMIT 20000"""
    return {
        "cluster_vocab": vocab.replace("SHARE", "0.6"),
        "topic_vocab": vocab.replace("SHARE", "0.5"),
        "nonblank": "SELECT doc_id FROM documents WHERE regexp_matches(text, '\\S')",
        "topic_label": "SELECT dataset, cluster_id, size, CASE WHEN len(t) > 0 THEN array_to_string(t[1:2], ' / ') ELSE '—' END AS label FROM (SELECT *, (SELECT coalesce(list(x ORDER BY i), []) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(top_terms) AS x, generate_subscripts(top_terms, 1) AS i) WHERE x IS NOT NULL GROUP BY x)) AS t FROM cluster_info)",
        "stream_postings": sql_index() + " SELECT doc_id, term, tf FROM post",
    }
