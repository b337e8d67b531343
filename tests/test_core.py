"""Small fixtures with hand-computed results for the core operators."""

import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.stemming import porter
from corvane.operators import evaluate as ev
from corvane.operators import fusion, index as ix, lexical, refine
from corvane.operators.references import classify, orphans
from corvane.runtime import rows_of, shared_folder
from corvane.sources import corpus
from corvane.sources.artifacts import Artifacts, Jobs, NotBuilt, fingerprint

DOCS = [(1, "Müller's don't ramble"), (2, "cats chase mice"), (3, "cats chase mice"), (4, ""), (5, None), (6, "mice mice dogs")]


def plain_words(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.combining(c) == 0)
    out, run = [], ""
    for c in "".join(c for c in t if c not in "'’`").lower() + " ":
        if c.isascii() and c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    return ix.build_index(ix.tokenised(docs, T.Analyzer()))


def test_words_agree_with_unicode_data(spark):
    texts = ["Müller's don't", "№ ½ ﬃ 𝐀𝐁 ⑽ ㎏ K ŉ Å ẹ́ İ x＇y", "", "ß ø Ж 東京", "áb⃝ c", "ＡＢＣ　１２"]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.words(F.col("t")).alias("w")).collect()]
    assert got == [plain_words(t) for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(T.words(F.col("t")).alias("w")).first().w == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=30, max_size=60))
def test_words_agree_on_any_text(spark, texts):
    texts = [t for t in texts if not any(0xAC00 <= ord(c) <= 0xD7A3 or 0xD800 <= ord(c) <= 0xDFFF or ord(c) == 0 for c in t)]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.words(F.col("t")).alias("w")).collect()] if texts else []
    assert got == [plain_words(t) for t in texts]


def test_analyzer_order(spark):
    a = T.Analyzer(stop_words=("Thé",), lemmas={"cats": "cat"}, stem=True, min_length=3)
    got = spark.createDataFrame([("The cats are running to it",)], "t string").select(a(F.col("t")).alias("w")).first().w
    assert got == ["cat", "run"]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_index(index):
    assert rows(index.postings.where("doc_id = 6"), "term", "tf") == [("dogs", 1), ("mice", 2)]
    assert rows(index.doc_stats, "doc_id", "dl") == [(1, 3), (2, 3), (3, 3), (4, 0), (5, 0), (6, 3)]
    assert rows(index.terms.where("term = 'mice'"), "df", "cf") == [(3, 4)]
    s = index.stats().first()
    assert (s.num_docs, s.total_tokens, s.avg_doc_length) == (6, 12, 2.0)
    assert index.terms.where("term in ('mullers', 'dont')").count() == 2


def test_empty_index(spark):
    empty = ix.build_index(ix.tokenised(spark.createDataFrame([], "doc_id bigint, text string"), T.Analyzer()))
    assert empty.stats().first().avg_doc_length == 0.0
    terms = spark.createDataFrame([("q", "mice", 1)], "query_id string, term string, qtf bigint")
    assert lexical.bm25_scores(empty, terms).count() == 0 and lexical.tfidf_scores(empty, terms).count() == 0


@pytest.mark.parametrize("k1,b", [(1.5, 0.75), (0.0, 0.0), (1.2, 1.0)])
def test_bm25_by_hand(spark, index, k1, b):
    terms = spark.createDataFrame([("q", "mice", 2), ("q", "cats", 1), ("q", "unknown", 1)], "query_id string, term string, qtf bigint")
    idf = lambda df: math.log(1 + (6 - df + 0.5) / (df + 0.5))
    part = lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * 3 / 2))
    got = {r.doc_id: r.score for r in lexical.bm25_scores(index, terms, k1, b).collect()}
    assert got == pytest.approx({2: 2 * idf(3) * part(1) + idf(2) * part(1), 3: 2 * idf(3) * part(1) + idf(2) * part(1), 6: 2 * idf(3) * part(2)})
    top = ix.top_k(lexical.bm25_scores(index, terms, k1, b), 2).orderBy("rank").collect()
    assert [r.doc_id for r in top if r.score == top[-1].score] == sorted(r.doc_id for r in top if r.score == top[-1].score)
    pool = spark.createDataFrame([("q", 1), ("q", 2), ("q", 99)], "query_id string, doc_id bigint")
    kept = lexical.given(pool, index.doc_stats, lexical.bm25_scores(index, terms, k1, b, candidates=pool))
    assert rows(kept, "doc_id") == [(1,), (2,)] and kept.where("doc_id = 1").first().score == 0.0


def test_tfidf_rows_have_length_one(index):
    for sublinear in (True, False):
        w = lexical.tfidf_weights(index, 6, sublinear)
        assert all(abs(r.n - 1) < 1e-9 for r in w.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect())
    assert rows(lexical.tfidf_idf(index, 6, 2, 0.4), "term") == [("cats",), ("chase",)]


def test_boolean(spark, index):
    terms = spark.createDataFrame([("a", "cats"), ("a", "mice"), ("b", "mice"), ("b", "unknown")], "query_id string, term string")
    both, either = ix.boolean_match(index, terms, "and"), ix.boolean_match(index, terms, "or")
    assert rows(both, "query_id", "doc_id", "matched") == [("a", 2, 2), ("a", 3, 2)]
    assert {(q, d) for q, d in rows(both, "query_id", "doc_id")} <= set(rows(either, "query_id", "doc_id"))
    top = rows(ix.boolean_top(either, 2), "query_id", "doc_id", "matched", "rank", "total")
    assert top[:2] == [("a", 2, 2, 1, 3), ("a", 3, 2, 2, 3)]


def run(spark, *hits):
    return spark.createDataFrame([("q", d, s, r) for d, s, r in hits], "query_id string, doc_id bigint, score double, rank int")


def test_fusion(spark):
    a, b = run(spark, (1, 9.0, 1), (2, 5.0, 2)), run(spark, (2, 3.0, 1), (1, 1.0, 2))
    tie = fusion.fuse_rrf([a, b], 10).orderBy("rank").collect()
    assert [r.doc_id for r in tie] == [1, 2] and tie[0].score == round(1 / 61 + 1 / 62, 6)
    flat = run(spark, (7, 2.0, 1), (8, 2.0, 2))
    got = {r.doc_id: r.score for r in fusion.fuse_weighted([a, flat], 10, [0.5, 0.25]).collect()}
    assert got == {1: 0.5, 2: 0.0, 7: 0.25, 8: 0.25}
    with pytest.raises(ValueError):
        fusion.fuse_weighted([a, b], 10, [1.0])
    again = spark.createDataFrame([("q", 2, 0.9)], "query_id string, doc_id bigint, score double")
    assert rows(fusion.serial(a, again, 10), "doc_id", "rank") == [(2, 1)]
    assert rows(fusion.serial(a, again.limit(0), 10), "doc_id", "rank") == [(1, 1), (2, 2)]


def test_prune(spark):
    pool = lambda *p: spark.createDataFrame(list(p), "query_id string, doc_id bigint")
    got = fusion.prune(pool(("a", 1), ("a", 2), ("b", 1)), pool(("a", 2), ("b", 3)))
    assert rows(got, "query_id", "doc_id") == [("a", 2), ("b", 1), ("b", 3)]
    assert fusion.prune(None, None) is None


def test_metrics(spark):
    judged = spark.createDataFrame([("q", 1, 2), ("q", 2, 1), ("q", 3, 0), ("z", 1, 0), ("n", 5, 1)], "query_id string, doc_id bigint, relevance int")
    gold = spark.createDataFrame([("q",), ("z",), ("n",)], "query_id string")
    hits = lambda label, *ids: [(label, "q", d, float(-i)) for i, d in enumerate(ids)]
    runs = spark.createDataFrame(hits("perfect", 1, 2, 3) + hits("reversed", 3, 2, 1), "run_label string, query_id string, doc_id bigint, score double")
    got = {(r.run_label, r.query_id, r.metric): r.value for r in ev.evaluate(runs, judged, gold, ("map", "ndcg@10", "recall@1", "precision@10", "ndcg")).collect()}
    assert got["perfect", "q", "map"] == got["perfect", "q", "ndcg@10"] == got["perfect", "q", "ndcg"] == 1.0
    assert got["reversed", "q", "map"] == pytest.approx((1 / 2 + 2 / 3) / 2, abs=1e-6)
    assert got["perfect", "q", "recall@1"] == 0.5 and got["perfect", "q", "precision@10"] == 0.2
    assert got["reversed", "q", "ndcg@10"] == pytest.approx((1 / math.log2(3) + 3 / 2) / (3 + 1 / math.log2(3)), abs=1e-6)
    assert got["perfect", "z", "map"] == got["perfect", "n", "recall@1"] == 0.0
    for bad in ("map@0", "bpref", "ndcg@x"):
        with pytest.raises(ValueError):
            ev.parse_metric(bad)
    late = lambda: runs.withColumn("score", F.expr("assert_true(score > 0)").cast("double"))
    out, errors, took = ev.run_all({"late": late, "ok": lambda: runs.where("run_label = 'perfect'"), "bad": lambda: 1 / 0}, judged, gold)
    assert sorted(errors) == ["bad", "late"] and out.select("run_label").distinct().count() == 1 and list(took) == ["ok"] and took["ok"] > 0
    tied = spark.createDataFrame([("b", "map", 0.5), ("a", "map", 0.5)], "run_label string, metric string, value double")
    assert ev.best_per_metric(tied, ("b", "a")).first().run_label == "b" and ev.best_per_metric(tied).first().run_label == "a"


def test_refine(spark):
    q = spark.createDataFrame([("1", "Infromation at MIT about iPhone by Bloomberg don’t top 10"), ("2", ""), ("3", None)], "query_id string, text string")
    d = spark.createDataFrame([("information", 5), ("about", 9), ("top", 3)], "term string, cf bigint")
    words = {r.word: r.corrected for r in refine.correct(q, d).collect()}
    assert words == {"Infromation": "Information", "at": "at", "MIT": "MIT", "about": "about", "iPhone": "iPhone", "by": "by", "Bloomberg": "Bloomberg", "don't": "don't", "top": "top"}
    out = {r.query_id: r for r in refine.refine(q, d).collect()}
    assert out["1"].applied == "spell_correction" and out["2"].refined == "" and out["3"].suggestion is None


def test_orphans_by_match_rule(spark):
    refs = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), (None, 9), ("a", None), (None, None), ("a", 2)], "dataset string, doc_id bigint").withColumn("note", F.lit("x"))
    keys = spark.createDataFrame([("a", 1, "k"), (None, 7, "k"), ("a", 1, "k")], "dataset string, doc_id bigint, note string")
    count = lambda m: sorted(map(repr, ((r.dataset, r.doc_id) for r in orphans(refs, keys, ("dataset", "doc_id"), m).collect())))
    assert count("simple") == ["('a', 2)", "('a', 2)"]
    assert count("partial") == ["('a', 2)", "('a', 2)", "(None, 9)"]
    assert count("full") == ["('a', 2)", "('a', 2)", "('a', None)", "(None, 1)", "(None, 9)"]
    assert len(count("strict")) == 6
    with pytest.raises(ValueError):
        orphans(refs, keys, ("dataset",), "loose")
    none = keys.limit(0)
    assert orphans(refs, none, ("dataset", "doc_id")).count() == 3 and orphans(refs.limit(0), keys, ("dataset", "doc_id")).count() == 0


def test_reference_kinds(spark):
    ref = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("a", 4, None), ("a", 4, 1), ("a", None, 5), (None, 1, 5)], "dataset string, doc_id bigint, at int")
    keys = spark.createDataFrame([("a", 1, 2), ("a", 1, 9), ("a", 4, 3)], "dataset string, doc_id bigint, came int")
    gone = spark.createDataFrame([("a", 2), ("a", 2), ("a", 1)], "dataset string, doc_id bigint")
    got = sorted((str(r.dataset), r.doc_id, r.kind) for r in classify(ref, keys, gone, ("dataset", "doc_id"), "at", "came").collect())
    assert got == [("None", 1, "missing"), ("a", 2, "deleted"), ("a", 3, "missing"), ("a", 4, "late")]


def test_corpus(spark, tmp_path):
    t = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(7)] + [(None, 3)], "dataset string, doc_id bigint")
    got = corpus.with_positions(t.repartition(5), ["doc_id"])
    assert got.where("dataset is not null and seq <> doc_id").count() == 0 and got.count() == 58
    with pytest.raises(corpus.DuplicateKeys):
        corpus.store(t.union(t).withColumn("seq", F.col("doc_id")), str(tmp_path / "x"), ["dataset", "doc_id"])
    assert not (tmp_path / "x").exists()
    assert spark.range(1).select(corpus.parse_catalog(F.lit(" a, ,b,a "))).first()[0] == ["a", "b"]


def test_artifacts_and_jobs(spark, tmp_path):
    store = Artifacts(spark, str(tmp_path / "store"))
    with pytest.raises(NotBuilt):
        store.read("a/b", "index")
    key, part = fingerprint(start=0, stop=None), fingerprint(start=0, stop=5)
    assert key != part and store.write(spark.range(3), "a/b", "index", key) and not store.write(spark.range(9), "a/b", "index", key)
    assert store.read("a/b", "index", key).count() == 3 and len(store.built()) == 1
    store.write(spark.range(1), "a/b", "topics")
    assert store.delete("a/b") == 2 and store.built() == []
    jobs = Jobs()
    assert jobs.run("index", "a", lambda p: p(1), 4)["state"] == "succeeded"
    assert jobs.run("index", "a", lambda p: 1 / 0)["state"] == "failed"


def test_small_tables_are_checked(spark):
    assert len(rows_of(spark.range(3), 3)) == 3
    with pytest.raises(ValueError):
        rows_of(spark.range(4), 3)
    assert shared_folder(spark)


def test_near_distance_equals_brute_force(spark):
    def osa(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    words = ["table", "tabel", "atbel", "tale", "tablet", "tbale", "stable", "cable", "batle", "tables", "xyz", "a", "ab", "ba"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in pairs.withColumn("d", refine.near_distance(F.col("a"), F.col("b"))).collect():
        assert (r.d if r.d is not None else 3) == min(osa(r.a, r.b), 3), r


def test_synonyms_are_taken_before_present_words_are_dropped(spark):
    words = spark.createDataFrame([("1", 0, "good"), ("1", 1, "fine"), ("1", 2, "Good"), ("2", 0, "Good")], "query_id string, pos int, corrected string")
    more = spark.createDataFrame([("good", 1, "well_known"), ("good", 2, "fine"), ("good", 3, "the"), ("good", 4, "sound")], "term string, ord int, synonym string")
    got = {(r.query_id, r.pos, r.place, r.synonym) for r in refine.synonyms(words, more, ("the",), 2).collect()}
    assert got == {("1", 0, 2, "the"), ("2", 0, 1, "fine"), ("2", 0, 2, "the")}


def test_hybrid_rules():
    fusion.validate("parallel", ["a", "b"], [1.0, 2.0])
    fusion.validate("serial", [], first="a", rerank="b")
    for bad in (("parallel", ["a"]), ("parallel", ["a", "b"], [1.0]), ("serial", [], None, "a", "a"), ("both", ["a", "b"])):
        with pytest.raises(ValueError):
            fusion.validate(*bad)


def test_lemma_by_part_of_speech(spark):
    tag = lambda found: F.transform(found, lambda t, i: F.when(i == 0, "n").otherwise("v"))
    a = T.Analyzer(lemmas={"saw/v": "see", "saw": "saw", "dogs": "dog"}, tagger=tag)
    assert spark.createDataFrame([("saw saw dogs",)], "t string").select(a(F.col("t"))).first()[0] == ["saw", "see", "dog"]


def test_pruned_queries_without_candidates_search_all(spark):
    docs = spark.createDataFrame([(1, "cats run"), (2, "cats sleep")], "doc_id bigint, text string")
    index = ix.kept_index(ix.tokenised(docs, T.Analyzer()))
    terms = ix.query_terms(spark.createDataFrame([("a", "cats"), ("b", "cats")], "query_id string, text string"), T.Analyzer())
    pool = spark.createDataFrame([("a", 2)], "query_id string, doc_id bigint")
    got = {(r.query_id, r.doc_id) for r in lexical.bm25_scores(index, terms, candidates=pool, rest=True).collect()}
    assert got == {("a", 2), ("b", 1), ("b", 2)}
    assert {(r.doc_id, r.dl) for r in index.doc_stats.collect()} == {(1, 2), (2, 2)}


def test_report_store(spark, tmp_path):
    from corvane.sources.artifacts import NotBuilt, Reports

    store = Reports(spark, str(tmp_path / "reports"))
    assert store.ids() == []
    rep = spark.createDataFrame([("bm25", "map", 0.5)], "run_label string, metric string, value double")
    one = store.save(rep, rep.withColumnRenamed("metric", "query_id"), {"bert": "no model"}, "first", {"bm25": 3.0})
    two = store.save(rep)
    assert store.ids() == [two, one]
    body = store.load(one)
    assert [(r["label"], r["error"]) for r in body["runs"]] == [("bm25", None), ("bert", "no model")] and body["runs"][0]["avg_query_ms"] == 3.0
    assert [tuple(r) for r in store.table(one).collect()] == [("bm25", "map", 0.5)] and store.per_query(one).count() == 1
    assert store.delete(one) and not store.delete(one) and store.ids() == [two]
    with pytest.raises(NotBuilt):
        store.load(one)


def test_datasets_are_deleted_and_ingested_again(spark, tmp_path):
    from corvane.sources import artifacts

    docs = spark.createDataFrame([("a/x", i, i) for i in range(5)] + [("b", 0, 9)], "dataset string, seq bigint, doc_id bigint")
    tables, built = {"documents": str(tmp_path / "documents")}, artifacts.Artifacts(spark, str(tmp_path / "built"))
    corpus.store(docs, tables["documents"], ["dataset", "seq"])
    built.write(docs, "a/x", "index")
    with pytest.raises(artifacts.Conflict):
        artifacts.reingest(spark, tables, "a/x", {"documents": docs}, built)
    assert artifacts.reingest(spark, tables, "a/x", {"documents": docs.where("seq < 2")}, built, force=True) == {"documents": 2}
    assert not built.exists("a/x", "index") and spark.read.parquet(tables["documents"]).count() == 3
    assert artifacts.delete_dataset(spark, tables, "a/x", built) == {"documents": 2, "artifacts": 0}
    assert spark.read.parquet(tables["documents"]).count() == 1 and not artifacts.complete(built, "a/x")


def test_best_hits_made_by_document_are_those_of_all_scores(spark):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]) for i in range(300)] + [(None, ["a", "b"]), (0x7FFFFFFFFFFFFF01, ["c"])]
    index = ix.kept_index(spark.createDataFrame(rows, "doc_id bigint, tokens array<string>"))
    terms = spark.createDataFrame([("1", "a", 1), ("1", "c", 2), ("2", "b", 1), ("3", "h", 1), ("4", "zz", 1)], "query_id string, term string, qtf long")
    grid = [(0.9, 0.4), (1.5, 0.75)]
    every = lexical.bm25_scores(index, terms, params=spark.createDataFrame(grid, "k1 double, b double")).withColumn("score", F.round("score", 6)).toPandas()
    every["doc"] = [-1 if x != x or x is None else int(x) for x in every["doc_id"]]
    kinds = spark.createDataFrame([(i, f"k{i % 3}") for i in range(300)], "doc_id bigint, kind string")
    allowed = spark.createDataFrame([("1", "k0"), ("1", "k1"), ("2", "k2")], "query_id string, kind string")
    space = {"1": {0, 1}, "2": {2}}
    for inside, options in ((lambda q, i: True, {}), (lambda q, i: q not in space or 0 <= i < 300 and i % 3 in space[q], {"kinds": kinds, "allowed": allowed})):
        want = set()
        for (q, k1, b), part in every.groupby(["query_id", "k1", "b"]):
            part = sorted((-s, i) for s, i in zip(part["score"], part["doc"]) if inside(q, i))
            want |= {(q, k1, b, i, -s, r + 1) for r, (s, i) in enumerate(part[:7])}
        got = lexical.bm25_top(index, terms, 7, grid, **options).collect()
        assert {(r.query_id, r.k1, r.b, -1 if r.doc_id is None else r.doc_id, r.score, r["rank"]) for r in got} == want and len(got) == len(want) > 30
    assert lexical.bm25_top(index, terms.where("term = 'zz'"), 7).count() == 0


@pytest.mark.parametrize("name", ["bm25_sweep", "sweep_pivot", "pruned_bm25"])
def test_rankings_make_no_row_for_each_query_and_document(spark, monkeypatch, name):
    from corvane.plans import queries

    def all_pairs(*a, **k):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(lexical, "bm25_scores", all_pairs)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_pruning_compares_kinds_of_documents(spark, tmp_path, monkeypatch):
    from corvane.operators import fusion
    from corvane.plans import ranking

    docs = [(1, "a", "en"), (2, "a", "de"), (3, "b", "en"), (4, None, "fr"), (5, "c", None), (6, "c", "es"), (7, "d", "fr"), (8, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("100",), ("200",), ("300",), ("401",)], "query_id string").write.parquet(f"{tmp_path}/queries.parquet")
    judged = [("100", 1), ("100", 3), ("200", 4), ("200", 5), ("300", 8), ("300", 99), ("401", 1)]
    spark.createDataFrame(judged, "query_id string, doc_id bigint").write.parquet(f"{tmp_path}/qrels.parquet")
    compared = []
    prune = fusion.prune
    monkeypatch.setattr(fusion, "prune", lambda a, b, *key: compared.append(a.columns) or prune(a, b, *key))
    got = sorted((r.query_id, r.doc_id) for r in ranking.prune_intersect(spark, str(tmp_path)).collect())
    assert got == [("100", 1), ("100", 3)] + [("200", i) for i in (4, 5, 6, 7)]
    assert compared == [["query_id", "kind"]]


def test_word_vectors_are_fitted_by_all_cores(spark, monkeypatch):
    from corvane.operators import groups

    asked = {}
    real = groups.Word2Vec
    monkeypatch.setattr(groups, "Word2Vec", lambda **k: asked.update(k) or real(**k))
    tokens = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(40)], "doc_id bigint, tokens array<string>")
    model = groups.fit_word_vectors(tokens, size=4, iterations=1)
    assert asked["numPartitions"] == spark.sparkContext.defaultParallelism > 1
    assert groups.word_vector_documents(model, tokens).count() == 40
