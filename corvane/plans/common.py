"""What the core queries and their SQL twins share."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import STOP_WORDS, Analyzer
from corvane.operators import index as ix
from corvane.operators import lexical
from corvane.plans.sqltext import quoted, sql_tokens
from corvane.sources.tables import table

ANALYZER = Analyzer(stop_words=STOP_WORDS)
#: Searches take every query whose id is divisible by this, against all documents.
ASKED = 100
TOP = 10


def asked(spark, d, name: str = "queries", key: str = "query_id") -> DataFrame:
    """The stated query set of searches."""
    return table(spark, d, name).where(F.col(key).cast("bigint") % ASKED == 0)


def index_of(spark, d, where=None) -> ix.Index:
    docs = table(spark, d, "documents").select("doc_id", "seq", "text")
    return ix.kept_index(ix.tokenised(docs if where is None else docs.where(where), ANALYZER))


def terms_asked(spark, d) -> DataFrame:
    return ix.query_terms(asked(spark, d), ANALYZER)


def bm25_run(spark, d, k: int = TOP, index=None, **options) -> DataFrame:
    index = index or index_of(spark, d)
    return ix.top_k(lexical.positive(lexical.bm25_scores(index, terms_asked(spark, d), **options)), k)


def tfidf_run(spark, d, k: int = TOP, index=None, **options) -> DataFrame:
    index = index or index_of(spark, d)
    return ix.top_k(lexical.positive(lexical.tfidf_scores(index, terms_asked(spark, d), **options)), k)


def sql_list(items) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


@cache
def search_tokens(column: str) -> str:
    return f"list_filter({sql_tokens(column)}, lambda t: length(t) >= 2 AND NOT list_contains({sql_list(STOP_WORDS)}, t))"


@cache
def sql_index(where: str = "true") -> str:
    return f"""WITH dt AS MATERIALIZED (SELECT doc_id, {search_tokens('text')} AS tokens FROM documents WHERE {where}),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM dt) GROUP BY doc_id, term),
terms AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term),
st AS MATERIALIZED (SELECT doc_id, len(tokens) AS dl FROM dt),
n AS (SELECT count(*)::DOUBLE AS n, coalesce(avg(dl), 0)::DOUBLE AS avgdl FROM st),
q AS MATERIALIZED (SELECT query_id, {search_tokens('text')} AS tokens FROM queries WHERE query_id::BIGINT % {ASKED} = 0),
qt AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM q) GROUP BY query_id, term)"""


def sql_bm25(k1: str = "1.5::DOUBLE", b: str = "0.75::DOUBLE", extra: str = "", source: str = "") -> str:
    """A CTE ``bm`` (query_id, doc_id, score)."""
    return f""", idf AS (SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM terms, n),
bm AS MATERIALIZED (SELECT query_id, doc_id{extra}, round(sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
  FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN st USING (doc_id), n{source} GROUP BY query_id, doc_id{extra})"""


def sql_tfidf(sublinear: bool = True) -> str:
    """CTEs ``w`` (doc_id, term, w), ``wq`` (query_id, term, w) and ``tc`` (query_id, doc_id, score)."""
    weight = "(1 + ln({x}::DOUBLE))" if sublinear else "{x}::DOUBLE"
    return f""", ti AS (SELECT term, ln((1 + n) / (1 + df::DOUBLE)) + 1 AS idf FROM terms, n),
wr AS (SELECT doc_id, term, {weight.format(x='tf')} * idf AS w FROM post JOIN ti USING (term)),
w AS MATERIALIZED (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM wr),
wqr AS (SELECT query_id, term, {weight.format(x='qtf')} * idf AS w FROM qt JOIN ti USING (term)),
wq AS MATERIALIZED (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM wqr),
tc AS MATERIALIZED (SELECT query_id, doc_id, round(sum(wq.w * w.w), 6) AS score FROM wq JOIN w USING (term) GROUP BY query_id, doc_id)"""


def sql_top(source: str, k: int, key: str = "query_id", item: str = "doc_id", more: str = "") -> str:
    return f"SELECT {key}, {item}, score{more}, rank FROM (SELECT *, (row_number() OVER (PARTITION BY {key}{more} ORDER BY score DESC, {item}))::INT AS rank FROM {source} WHERE score > 0) WHERE rank <= {k}"
