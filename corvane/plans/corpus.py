"""Queries over the stored corpus, text analysis and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import index as ix
from corvane.plans.common import ANALYZER, TOP, asked, index_of, search_tokens, sql_index, sql_list, terms_asked
from corvane.plans.sqltext import sql_fold, sql_tokens
from corvane.sources import corpus
from corvane.sources.tables import table

OFFSET, LIMIT = 200, 100
DOC, QUERY, WORD = 1000000007, "200000007", "patients"
#: A small dictionary of word forms, to show lemmatisation by a supplied table.
LEMMAS = {"patients": "patient", "goals": "goal", "loans": "loan", "birds": "bird", "judges": "judge", "functions": "function", "taxes": "tax", "wolves": "wolf", "melodies": "melody", "was": "be", "were": "be", "is": "be"}
CATALOG = " askpool/test, fieldnotes/train,, askpool/test ,polyglot/dev , "


def _t(name):
    return lambda spark, d: table(spark, d, name)


documents, queries, qrels = _t("documents"), _t("queries"), _t("qrels")


def _ids(spark, d):
    """A request for documents: all judged pairs in order of delivery, with repetitions and unknown ids."""
    return qrels(spark, d).where("doc_id is not null").select(F.concat_ws("#", "dataset", "seq").alias("pos"), "doc_id")


QUERIES = {
    "doc_scan": lambda s, d: corpus.scan_documents(documents(s, d)),
    "query_scan": lambda s, d: corpus.scan_queries(queries(s, d)),
    "qrels_scan": lambda s, d: corpus.scan_qrels(qrels(s, d)),
    "corpus_counts": lambda s, d: corpus.counts(documents(s, d), queries(s, d), qrels(s, d)),
    "text_extract": lambda s, d: documents(s, d).select("doc_id", corpus.document_text(F.col("source"), F.col("text"), F.col("dataset")).alias("text")),
    "ingest_seq": lambda s, d: corpus.with_positions(documents(s, d).select("dataset", "doc_id"), ["doc_id"]),
    "dup_keys": lambda s, d: corpus.duplicate_keys(qrels(s, d), ["dataset", "query_id", "doc_id"]),
    "docs_page": lambda s, d: corpus.page(documents(s, d), OFFSET, LIMIT).select("dataset", "seq", "doc_id", "text"),
    "queries_page": lambda s, d: corpus.page(queries(s, d), OFFSET, LIMIT).select("dataset", "seq", "query_id", "text"),
    "qrels_page": lambda s, d: corpus.page(qrels(s, d), OFFSET, LIMIT, "askpool/test").select("seq", "query_id", "doc_id", "relevance"),
    "docs_range": lambda s, d: documents(s, d).where(F.col("seq").between(OFFSET, OFFSET + 10 * LIMIT)).select("doc_id", "text"),
    "doc_by_id": lambda s, d: documents(s, d).where(F.col("doc_id") == DOC).select("doc_id", "text"),
    "docs_by_ids": lambda s, d: corpus.by_ids(documents(s, d), _ids(s, d)),
    "docs_missing": lambda s, d: corpus.missing_ids(documents(s, d), _ids(s, d)),
    "qrels_for_query": lambda s, d: qrels(s, d).where(F.col("query_id") == QUERY).select("doc_id", "relevance"),
    "qrels_nested": lambda s, d: corpus.nested_qrels(qrels(s, d)).select("query_id", F.explode("judged").alias("doc_id", "relevance")),
    "dataset_status": lambda s, d: corpus.status(documents(s, d), queries(s, d), qrels(s, d)),
    "catalog_parse": lambda s, d: s.range(1).select(F.posexplode(corpus.parse_catalog(F.lit(CATALOG))).alias("pos", "dataset")).select("pos", "dataset", corpus.safe_name(F.col("dataset")).alias("folder")),
    "text_fold": lambda s, d: documents(s, d).select("doc_id", T.drop_apostrophes(T.fold(F.col("text"))).alias("text")),
    "tokenize": lambda s, d: documents(s, d).select("doc_id", T.tokens(F.col("text")).alias("tokens")),
    "tokenize_cased": lambda s, d: documents(s, d).select("doc_id", T.tokens(F.col("text"), lowercase=False).alias("tokens")),
    "stopwords": lambda s, d: documents(s, d).select("doc_id", T.Analyzer(stop_words=T.STOP_WORDS, min_length=1)(F.col("text")).alias("tokens")),
    "lemmatize": lambda s, d: documents(s, d).select("doc_id", T.Analyzer(lemmas=LEMMAS, min_length=1)(F.col("text")).alias("tokens")),
    "min_len": lambda s, d: documents(s, d).select("doc_id", T.tokens(F.col("text"), min_length=4).alias("tokens")),
    "normalized_text": lambda s, d: documents(s, d).select("doc_id", F.array_join(ANALYZER(F.col("text")), " ").alias("text")),
    "postings": lambda s, d: index_of(s, d).postings.drop("dl"),
    "postings_range": lambda s, d: index_of(s, d, F.col("seq").between(OFFSET, OFFSET + 10 * LIMIT - 1)).postings.drop("dl"),
    "doc_lengths": lambda s, d: index_of(s, d).doc_stats,
    "term_stats": lambda s, d: index_of(s, d).terms,
    "index_stats": lambda s, d: index_of(s, d).stats(),
    "postings_lookup": lambda s, d: ix.postings_of(index_of(s, d), WORD, 100),
    "doc_info": lambda s, d: index_of(s, d, F.col("doc_id") == DOC).doc_stats,
    "bool_and": lambda s, d: ix.boolean_match(index_of(s, d), terms_asked(s, d), "and"),
    "bool_or": lambda s, d: ix.boolean_match(index_of(s, d), terms_asked(s, d), "or"),
    "bool_total": lambda s, d: ix.boolean_top(ix.boolean_match(index_of(s, d), terms_asked(s, d), "or"), TOP),
    "bool_terms": lambda s, d: ix.matched_terms(index_of(s, d), asked(s, d), ANALYZER),
    "bool_search_text": lambda s, d: ix.boolean_top(ix.boolean_match(index_of(s, d), terms_asked(s, d), "or"), TOP).join(documents(s, d).select("doc_id", "text"), "doc_id", "left"),
}


def _stem(s, d):
    from corvane.functions.stemming import stems

    return stems(index_of(s, d).terms)


QUERIES["stem"] = _stem


def sql() -> dict[str, str]:
    i = sql_index()
    page = f"seq >= {OFFSET} AND seq < {OFFSET + LIMIT}"
    last = "SELECT query_id, doc_id, relevance FROM qrels WHERE query_id IS NOT NULL AND doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY seq DESC, dataset DESC) = 1"
    boolean = i + ", m AS (SELECT query_id, doc_id, count(DISTINCT term) AS matched FROM qt JOIN post USING (term) GROUP BY query_id, doc_id)"
    total = boolean + f", r AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total, (row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id))::INT AS rank FROM m) "
    counted = lambda t: f"(SELECT dataset, count(*) AS n FROM {t} GROUP BY dataset)"
    lemma = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in LEMMAS.items()) + "}"
    ids = "SELECT concat_ws('#', dataset, seq) AS pos, doc_id FROM qrels WHERE doc_id IS NOT NULL"
    return {
        "doc_scan": "SELECT doc_id, text FROM documents",
        "query_scan": "SELECT query_id, text FROM queries",
        "qrels_scan": "SELECT query_id, doc_id, relevance FROM qrels",
        "corpus_counts": "SELECT a.n AS documents, b.n AS queries, c.n AS qrels, c.n > 0 AS has_qrels FROM (SELECT count(*) n FROM documents) a, (SELECT count(*) n FROM queries) b, (SELECT count(*) n FROM qrels) c",
        "text_extract": "SELECT doc_id, trim(concat_ws(' ', coalesce(source, ''), coalesce(CASE WHEN trim(text) <> '' THEN text END, CASE WHEN trim(dataset) <> '' THEN dataset END, '')), ' ') AS text FROM documents",
        "ingest_seq": "SELECT dataset, doc_id, row_number() OVER (PARTITION BY dataset ORDER BY doc_id) - 1 AS seq FROM documents",
        "dup_keys": "SELECT dataset, query_id, doc_id, count(*) AS copies FROM qrels GROUP BY ALL HAVING count(*) > 1",
        "docs_page": f"SELECT dataset, seq, doc_id, text FROM documents WHERE {page}",
        "queries_page": f"SELECT dataset, seq, query_id, text FROM queries WHERE {page}",
        "qrels_page": f"SELECT seq, query_id, doc_id, relevance FROM qrels WHERE {page} AND dataset = 'askpool/test'",
        "docs_range": f"SELECT doc_id, text FROM documents WHERE seq BETWEEN {OFFSET} AND {OFFSET + 10 * LIMIT}",
        "doc_by_id": f"SELECT doc_id, text FROM documents WHERE doc_id = {DOC}",
        "docs_by_ids": f"SELECT pos, doc_id, text FROM ({ids}) JOIN documents USING (doc_id)",
        "docs_missing": f"SELECT pos, doc_id FROM ({ids}) r WHERE NOT EXISTS (SELECT 1 FROM documents t WHERE t.doc_id = r.doc_id)",
        "qrels_for_query": f"SELECT doc_id, relevance FROM qrels WHERE query_id = '{QUERY}'",
        "qrels_nested": last,
        "dataset_status": f"SELECT dataset, coalesce(a.n, 0) AS documents, coalesce(b.n, 0) AS queries, coalesce(c.n, 0) AS qrels FROM {counted('documents')} a FULL JOIN {counted('queries')} b USING (dataset) FULL JOIN {counted('qrels')} c USING (dataset)",
        "catalog_parse": "SELECT * FROM (VALUES (0, 'askpool/test', 'askpool__test'), (1, 'fieldnotes/train', 'fieldnotes__train'), (2, 'polyglot/dev', 'polyglot__dev')) t(pos, dataset, folder)",
        "text_fold": f"SELECT doc_id, translate({sql_fold('text')}, '''’`', '') AS text FROM documents",
        "tokenize": f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents",
        "tokenize_cased": f"SELECT doc_id, {sql_tokens('text', lowercase=False)} AS tokens FROM documents",
        "stopwords": f"SELECT doc_id, list_filter({sql_tokens('text')}, lambda t: NOT list_contains({sql_list(T.STOP_WORDS)}, t)) AS tokens FROM documents",
        "lemmatize": f"SELECT doc_id, list_transform({sql_tokens('text')}, lambda t: coalesce({lemma}[t], t)) AS tokens FROM documents",
        "min_len": f"SELECT doc_id, {sql_tokens('text', min_length=4)} AS tokens FROM documents",
        "normalized_text": f"SELECT doc_id, array_to_string({search_tokens('text')}, ' ') AS text FROM documents",
        "postings": i + " SELECT doc_id, term, tf FROM post",
        "postings_range": sql_index(f"seq BETWEEN {OFFSET} AND {OFFSET + 10 * LIMIT - 1}") + " SELECT doc_id, term, tf FROM post",
        "doc_lengths": i + " SELECT doc_id, dl FROM st",
        "term_stats": i + " SELECT term, df, cf FROM terms",
        "index_stats": i + " SELECT n::BIGINT AS num_docs, (SELECT count(*) FROM terms) AS vocab_size, (SELECT count(*) FROM post) AS num_postings, (SELECT sum(dl) FROM st)::BIGINT AS total_tokens, round(avgdl, 6) AS avg_doc_length FROM n",
        "postings_lookup": i + f" SELECT doc_id, tf, df, cf FROM post JOIN terms USING (term) WHERE term = '{WORD}' ORDER BY doc_id LIMIT 100",
        "doc_info": i + f" SELECT doc_id, dl FROM st WHERE doc_id = {DOC}",
        "bool_and": boolean + " SELECT query_id, doc_id, matched FROM m JOIN (SELECT query_id, count(*) AS need FROM qt GROUP BY query_id) USING (query_id) WHERE matched = need",
        "bool_or": boolean + " SELECT query_id, doc_id, matched FROM m",
        "bool_total": total + f"SELECT query_id, doc_id, matched, rank, total FROM r WHERE rank <= {TOP}",
        "bool_search_text": total + f"SELECT r.query_id, r.doc_id, r.matched, r.rank, r.total, d.text FROM r LEFT JOIN documents d USING (doc_id) WHERE rank <= {TOP}",
        "bool_terms": i + """, p AS (SELECT query_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS place FROM q),
f AS (SELECT query_id, term, min(place) AS place FROM p GROUP BY query_id, term)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS pos, term, coalesce(df, 0) AS df FROM f LEFT JOIN terms USING (term)""",
    }
