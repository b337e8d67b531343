"""Core queries against their SQL twins, over the smallest tables."""

import os

import duckdb
import pytest

import verify
from corvane.plans import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = queries.sql()
#: One query of each kind; verify.py compares all of them.
NAMES = ["pruned_bm25", "prune_union_fallback", "synonym_expand", "spell_correct", "best_per_metric", "bool_total", "hybrid_serial", "qrels_nested", "ingest_seq", "tokenize", "postings", "index_stats", "bool_terms", "bm25_sweep", "tfidf_weights", "dense_search", "fuse_rrf", "fuse_weighted", "nearest_members", "silhouette", "eval_report", "query_extremes", "refine_query", "p5_found", "p5_report", "stream_postings"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        path = f"{FOLDER}/{f}" + ("/*.parquet" if os.path.isdir(f"{FOLDER}/{f}") else "")
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert verify.rows(got) == verify.rows(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries.QUERIES)


def test_model_queries_run_the_whole_job(spark, monkeypatch):
    import inspect

    from corvane.operators import groups
    from corvane.plans import models

    asked = {}
    for name in ("fit_clusters", "fit_topics", "fit_word_vectors"):
        was = inspect.signature(getattr(groups, name))

        def record(*a, _name=name, _was=was, **k):
            bound = _was.bind(*a, **k)
            bound.apply_defaults()
            asked[_name] = bound.arguments
            raise StopIteration

        monkeypatch.setattr(groups, name, record)
    for f in (models._clusters, models._topics, models.w2v_build):
        with pytest.raises(StopIteration):
            f(spark, FOLDER)
    assert (asked["fit_clusters"]["features"], asked["fit_clusters"]["dims"], asked["fit_clusters"]["seeds"]) == (20_000, 128, 10)
    assert asked["fit_topics"]["features"] == 20_000
    assert (asked["fit_word_vectors"]["size"], asked["fit_word_vectors"]["iterations"]) == (100, 5)
    whole = groups.Clusters(["a", "b"], None, None, [[0.5] * 20, [0.1] * 20])
    monkeypatch.setattr(models, "_clusters", lambda s, d: whole)
    assert {len(r.components) for r in models.lsa(spark, FOLDER).collect()} == {20}


def test_every_document_and_query_is_encoded(spark):
    got = queries.QUERIES["encode_plugin"](spark, FOLDER).groupBy("table_name").count().collect()
    want = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("documents", "queries")}
    assert {r.table_name: r["count"] for r in got} == want
