"""Training-data operators against brute force, and their edge cases."""

import collections
import math
import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import canonical, clusters, encoding, mixing, neardup, subjects, terms, topn

SCHEMA = "doc_id bigint, text string, source string, lang string, note string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "en", "clash") for i, t in rows], SCHEMA)


def words(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.combining(c) == 0)
    return re.findall("[a-z0-9]+", re.sub("['’`]", "", t).lower())


# 1 near duplicates


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab[: 40 if rng.random() < 0.4 else 400]) for _ in range(rng.randint(60, 160))] for _ in range(60)]
    rows = []
    for b in base:
        rows.append(b)
        for _ in range(3):
            c = b[:]
            for _ in range(rng.randint(1, int(len(c) * 0.24))):
                kind, at = rng.random(), rng.randrange(len(c))
                if kind < 0.4:
                    c[at] = rng.choice(vocab)
                elif kind < 0.7:
                    c.insert(at, rng.choice(vocab))
                else:
                    del c[at]
            rng.shuffle(c)
            rows.append(c)
    rows.append(base[0][::-1])
    texts = [(i, " ".join(r)) for i, r in enumerate(rows)]
    bags = {i: collections.Counter(r) for i, r in enumerate(rows) if len(r) >= 60}
    want = {(a, b) for a in bags for b in bags if a < b and 5 * sum((bags[a] & bags[b]).values()) >= 4 * max(sum(bags[a].values()), sum(bags[b].values()))}
    docs = docs_of(spark, texts + [(500, None), (501, ""), (None, texts[0][1]), (502, "short text"), (0, texts[0][1])])
    sets = neardup.word_sets(docs).withColumnRenamed("doc_id", "rep")
    assert neardup.exact_pairs(sets).where("rep_a in (0, 1) or rep_b in (0, 1)").count() > 0
    members, pairs = neardup.near_duplicates(docs)
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.document_pairs(members, pairs).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 50


def test_large_bucket_of_near_copies_is_whole(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(base[:99] + [f"x{i}"])) for i in range(130)] + [(i, " ".join(base)) for i in range(200, 290)]
    rng.shuffle(rows)
    members, pairs = neardup.near_duplicates(docs_of(spark, rows))
    assert pairs.count() == 131 * 130 // 2
    found = neardup.document_pairs(members, pairs, expand=64)
    assert found.where("doc_id_a = 200").count() >= 89 and found.count() == found.distinct().count()


def test_pairs_of_large_classes_are_whole(spark):
    members = spark.createDataFrame([(i, 0) for i in range(600)] + [(700 + i, 700) for i in range(300)] + [(2000, 2000)], "doc_id bigint, rep bigint")
    pairs = spark.createDataFrame([(0, 700, 90), (0, 2000, 90)], "rep_a bigint, rep_b bigint, shared int")
    got = [(r.doc_id_a, r.doc_id_b) for r in neardup.document_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) == 600 * 599 // 2 + 300 * 299 // 2 + 600 * 300 + 600 and all(a < b for a, b in got)


def test_runs_are_planned_for_all_levels_and_the_weighted_share(spark):
    lost = 0.0
    for mean in [0.8 * neardup.FURTHER] * neardup.ROUNDS + [0.8 * neardup.BRANCH] * neardup.LEVELS:
        lost = math.exp(-mean * (1 - lost))
    assert lost ** neardup.planned_runs(0.8) <= 0.005
    sets = spark.createDataFrame([(i, list(range(50)) + [1000 + 50 * i + k for k in range(50)]) for i in range(20)], "rep bigint, toks array<bigint>")
    common = np.arange(50)
    # half the tokens weigh 0.25; the 20 lost ones weigh 1
    assert abs(neardup.weighted_share(sets, common, np.ones(50), 0.8) - (12.5 + 30) / 62.5) < 1e-9


def test_near_duplicates_of_nothing(spark):
    members, pairs = neardup.near_duplicates(docs_of(spark, []))
    assert members.count() == 0 and neardup.document_pairs(members, pairs).count() == 0
    assert neardup.planned_runs(target=0.999) > neardup.planned_runs(target=0.9)


# 2 top n


def test_top_n_with_ties_repeats_and_hot_groups(spark, tmp_path):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(30)}", rng.randrange(500), rng.choice([None, float("nan"), *map(float, range(-3, 40))]), 7) for _ in range(6000)]
    rows += [(None, 1, 2.0, 7), ("g1", None, 99.0, 7), ("z", 5, -0.0, 7), ("z", 4, 0.0, 7)]
    hits = spark.createDataFrame(rows, "g string, item bigint, value double, rank int")
    best = collections.defaultdict(dict)
    for g, i, v, _ in rows:
        if i is not None and v is not None and v == v:
            best[g][i] = max(v, best[g].get(i, v))
    want = {(g, i, r + 1) for g, x in best.items() for r, (i, v) in enumerate(sorted(x.items(), key=lambda t: (-t[1], t[0]))[:10])}
    for size in (600_000, 300):
        path = str(tmp_path / f"layout{size}")
        topn.cluster_by_group(hits, ["g"], "item", "value", path, file_rows=size, row_group_rows=50)
        got = topn.top_n_clustered(spark, path, ["g"], 10)
        assert {(r.g, r.item, r["rank"]) for r in got.collect()} == want
    seen = {}
    for f in spark.read.parquet(str(tmp_path / "layout600000")).inputFiles():
        one = {}
        topn.scan_file(f, ["g"], 10, one)
        for k, v in one.items():
            seen[k] = seen.get(k, 0) + v
    assert seen["read"] > 0
    assert topn.top_n(hits.limit(0), ["g"], "item", "value", 3).count() == 0
    only = spark.createDataFrame([("g1",), ("g1",), (None,)], "g string")
    assert {r.g for r in topn.top_n(hits, ["g"], "item", "value", 3, only).collect()} == {"g1"}


def test_row_groups_of_a_finished_group_are_skipped(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("a").alias("g"), F.col("id").alias("item"), F.col("id").cast("double").alias("value"))
    topn.cluster_by_group(rows.unionByName(rows.withColumn("g", F.lit("b"))), ["g"], "item", "value", str(tmp_path / "l"), row_group_rows=100)
    seen = {}
    for f in spark.read.parquet(str(tmp_path / "l")).inputFiles():
        topn.scan_file(f, ["g"], 10, seen)
    assert seen["skipped"] > seen["read"]


def test_stored_hits_have_row_groups_that_are_skipped(spark, tmp_path):
    hits = spark.read.parquet(f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/../sf0.1/search_hits.parquet")
    topn.cluster_by_group(hits, ["run_label", "query_id"], "doc_id", "score", str(tmp_path / "l"))
    read = skipped = 0
    for f in spark.read.parquet(str(tmp_path / "l")).inputFiles():
        seen = {}
        topn.scan_file(f, ["run_label", "query_id"], 10, seen)
        read, skipped = read + seen["read"], skipped + seen["skipped"]
    assert skipped > 0


# 3 terms


def test_terms_against_counting(spark):
    texts = [(1, "a a b"), (2, "B’s ｂ c"), (3, None), (4, ""), (5, "a"), (5, "a"), (6, "x" * 5000 + " a")]
    want_cf, want_df = collections.Counter(), collections.Counter()
    for _, t in texts:
        w = words(t or "")
        want_cf.update(w)
        want_df.update(set(w))
    docs = docs_of(spark, texts)
    got = {r.term: (r.cf, r.df) for r in terms.term_frequencies(docs).collect()}
    assert got == {t: (want_cf[t], want_df[t]) for t in want_cf}
    params = spark.createDataFrame([("p", 2, 0.5), ("none", None, None)], "param_set string, min_df int, max_df double")
    marks = {(r.param_set, r.term, r["mark"]) for r in terms.excluded_terms(docs, params).collect()}
    assert marks == {("p", t, "rare") for t in want_df if want_df[t] < 2} | {("p", t, "common") for t in want_df if want_df[t] > 0.5 * 6}
    assert terms.excluded_terms(docs.limit(0), params).count() == 0


# 4 canonical text


@pytest.mark.parametrize(
    "stored,seen",
    [("２２ ﬁne", "22 fine"), ("näive", "näive"), ("o​k⁠", "ok"), ("a b c", "a b c"), ("Воһеlаft һеrbѕ", "Bohelaft herbs"), ("добрый день", "добрый день"), ("m² ①", "m² ①"), ("", ""), (None, None), ("한국어", "한국어"), ("é", "é"), ("ｅ́", "é"), ("open‑source", "open-source")],
)
def test_canonical_form(stored, seen):
    assert canonical.canonical_text(stored) == seen
    assert canonical.canonical_text(seen) == seen


def test_splicing_equals_normalising_the_whole():
    to = canonical.tables()[0]
    rng = random.Random(2)
    some = [chr(c) for c in [*range(32, 1200), 0x1E9B, 0x323, 0xFB01, 0x2126, 0x1100, 0x1161, 0xAC00, 0x301, 0x308, 0x1F642, 0x1D400, 0x2F800] if unicodedata.category(chr(c))[0] != "C"]
    for _ in range(3000):
        t = "".join(rng.choice(some) for _ in range(rng.randint(1, 12)))
        whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(to))
        assert canonical.canonical_text(t) == (canonical._latinised(whole) if canonical._FOREIGN.search(whole) else whole)


def test_words_of_other_scripts_survive():
    for t in ("хаос", "ναι", "роса", "Ελλάδα και ναι", "Greek says ναι here"):
        assert canonical.canonical_text(t) == t
    assert canonical.canonical_text("А рорulаr guіdе оf ѕаllѕ") == "A popular guide of salls"
    assert canonical.canonical_text("Ελλάδα ﬁ και ναι") == "Ελλάδα fi και ναι"  # only the unstable segment


def test_classes_hold_every_row_that_can_be_seen(spark):
    rows = [(1, "a cat"), (2, "a\u200b cat"), (3, "a dog"), (4, None), (None, "x"), (5, "\u200b"), (1, "a cat")]
    got = {r.key: (r.look, r.form) for r in canonical.look_classes(docs_of(spark, rows), "doc_id").collect()}
    assert set(got) == {"1", "2", "3"} and got["1"][0] == got["2"][0] != got["3"][0] and got["1"][1] != got["2"][1]


def test_same_look_pairs(spark):
    rows = [(1, "a cat"), (2, "a cat"), (3, "a cat"), (4, "a Cat"), (5, "​"), (6, " "), (7, None), (None, "a cat"), (8, "ａ cat"), (1, "a cat")]
    got = {(r.key_a, r.key_b) for r in canonical.same_look(docs_of(spark, rows), "doc_id").collect()}
    assert got == {("1", "2"), ("2", "3"), ("1", "8"), ("3", "8"), ("2", "8")}
    many = docs_of(spark, [(i, "dog x") for i in range(20)] + [(100 + i, "dog x") for i in range(20)])
    star = {(r.key_a, r.key_b) for r in canonical.same_look(many, "doc_id", expand=5).collect()}
    assert {k for p in star for k in p} == {str(i) for i in [*range(20), *range(100, 120)]} and len(star) < 60
    assert canonical.same_look(many.limit(0), "doc_id").count() == 0


# 6 clusters


def test_markov_clusters_split_weak_bridges(spark):
    e = [(a, b, 0.9) for g in ((1, 2, 3), (7, 8, 9)) for a in g for b in g if a < b] + [(3, 7, 0.05)]
    first = clusters.first_flow(spark.createDataFrame(e, "i bigint, j bigint, s double"))
    got = collections.defaultdict(set)
    for r in clusters.markov_clusters(first).collect():
        got[r.cluster].add(r.node)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [7, 8, 9]]


def test_squaring_equals_matrix_product_with_hubs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.random((12, 12)) * (rng.random((12, 12)) < 0.4) + np.eye(12)
    entries = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i bigint, j bigint, v double")
    flow = clusters._columns(entries, 1.0, 0.0)
    scaled = m / m.sum(0)
    for hubs in (1024, 4):
        monkeypatch.setattr(clusters, "HUBS", hubs)
        got = np.zeros((12, 12))
        for r in clusters.squared(flow).collect():
            got[r.i, r.j] = r.v
        assert np.allclose(got, scaled @ scaled)


def test_similarity_with_few_pivots_links_every_node(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [(7, 0.5 + rng.random() / 2)]) for i in range(50)]
    nodes = spark.createDataFrame(rows, "node bigint, terms array<struct<term:bigint,x:double>>")
    x = {i: t[0][1] for i, t in rows}
    whole = {(r.i, r.j): r.s for r in clusters.similarity(nodes, 0.0).collect()}
    assert len(whole) == 50 * 49 // 2 and all(abs(s - min(1, x[i] * x[j])) < 1e-9 for (i, j), s in whole.items())
    monkeypatch.setattr(clusters, "PIVOTS", 5)
    monkeypatch.setattr(clusters, "SALT", 1)
    few = {(r.i, r.j): r.s for r in clusters.similarity(nodes, 0.0).collect()}
    purest = sorted(x, key=lambda i: (-x[i], i))[:5]
    assert set(few) == {(min(p, q), max(p, q)) for p in purest for q in x if p != q} and all(abs(few[k] - whole[k]) < 1e-9 for k in few)


def test_documents_about_one_thing(spark):
    rows = [(i, f"Visitors to the Kolupaft bridge near Dodunor admire stone number {i}.") for i in range(4)]
    rows += [(10 + i, f"The Vetukant album by Lijiping has {40 + i} songs.") for i in range(4)] + [(20, None), (21, ""), (0, rows[0][1])]
    rows += [(100 + i, f"nothing named here, only the words w{i} and v{i}") for i in range(80)]
    members = clusters.thing_clusters(docs_of(spark, rows))
    pairs = {(r.doc_id_a, r.doc_id_b) for r in clusters.cluster_pairs(members).collect()}
    assert pairs == {(a, b) for g in (range(4), range(10, 14)) for a in g for b in g if a < b}
    assert clusters.cluster_pairs(members, expand=2).count() == 6
    told = clusters.describe_clusters(members, docs_of(spark, rows)).collect()
    assert sorted(r["size"] for r in told) == [1] * 80 + [4, 4] and all(r.top_terms and r.typical for r in told)
    assert clusters.thing_clusters(docs_of(spark, [])).count() == 0


def test_a_thing_that_a_third_of_all_documents_treat_stays_one_cluster(spark):
    rng = random.Random(6)
    verbs = [f"verb{chr(97 + i)}" for i in range(26)]
    some = lambda: " ".join(rng.sample(verbs, 6))
    name = lambda i: "B" + "".join("aeiou"[(i // 5**k) % 5] + "dlmnr"[(i // 3**k) % 5] for k in range(4))
    rows = [(i, f"they {some()} the Kolupaft and {some()} again near Kolupaft while {name(i)} waits.") for i in range(100)]
    rows += [(1000 + i, f"they {some()} the {name(5000 + i // 4)} and {some()} again near {name(5000 + i // 4)} daily.") for i in range(200)]
    got = {r.doc_id: r.cluster for r in clusters.thing_clusters(docs_of(spark, rows)).collect()}
    assert len(got) == 300 and len({got[i] for i in range(100)}) == 1
    assert not {got[i] for i in range(100)} & {got[1000 + i] for i in range(200)}
    assert all(len({got[1000 + 4 * k + i] for i in range(4)}) == 1 for k in range(50))


def test_pairs_of_a_large_cluster_are_whole(spark):
    members = spark.createDataFrame([(i, "big", 1.0) for i in range(600)] + [(700 + i, "small", 1.0) for i in range(3)] + [(800, "one", 1.0)], "doc_id bigint, cluster string, strength double")
    got = [(r.doc_id_a, r.doc_id_b) for r in clusters.cluster_pairs(members).collect()]
    assert len(got) == len(set(got)) == 600 * 599 // 2 + 3 and all(a < b for a, b in got)


# 7 encoding


def test_encoding_equals_the_tokenizer_and_comes_back(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    texts = ["Hello  world's\n\n x", "", None, "  　 tab\t", "naïve 東京 🙂 ﬁ", "<|endoftext|>", "a" * 3000, "don't 123 !!", "добрый день"]
    docs = docs_of(spark, list(enumerate(texts)) + [(0, texts[0]), (None, "x")])
    rows = encoding.encode_corpus(docs).collect()
    got = {r.doc_id: r.ids for r in rows}
    assert len(rows) == len(texts) + 1
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)} | {None: tok.encode("x", add_special_tokens=False).ids}
    back = {r.doc_id: r.text for r in encoding.decode_corpus(encoding.encode_corpus(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} | {None: "x"}
    assert encoding.encode_corpus(docs.limit(0)).count() == 0


# 8 mixing


def test_mix_reaches_its_shares(spark):
    counts = spark.createDataFrame([(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(900)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "big", 1.0, 3), ("m", "small", 1.0, 9), ("m", "gone", 2.0, 5), ("k", "small", 9.0, 2), ("k", "big", 1.0, None)], "mix_id string, source string, weight double, max_repeats int")
    rows = {(r.mix_id, r.source): r for r in mixing.shares(targets, counts).collect()}
    assert {k for k, r in rows.items() if r.short} == {("m", "gone"), ("k", "small")}
    order = mixing.curriculum(targets, counts)
    placed = {(r.mix_id, r.source): r.n for r in order.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("n")).collect()}
    for key, r in rows.items():
        assert abs(placed.get(key, 0) - r.actual_tokens) <= 20
    assert order.groupBy("mix_id", "source", "doc_id").count().agg(F.max("count")).first()[0] <= 9
    assert order.where("position < 0 or position > 1").count() == 0
    assert mixing.shares(targets, counts.limit(0)).where("tokens > 0").count() == 0


def test_schedule_moves_a_source_to_the_end(spark):
    counts = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(400)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 1.0, 5), ("m", "b", 1.0, 5)], "mix_id string, source string, weight double, max_repeats int")
    ramp = spark.createDataFrame([("m", "a", 0.0, 1.0), ("m", "a", 1.0, 0.0), ("m", "b", 0.0, 0.0), ("m", "b", 1.0, 1.0)], "mix_id string, source string, t double, weight double")
    seg = mixing.demand(ramp, 4000)
    assert {r.source: r.d1 for r in seg.collect()} == {"a": 2000.0, "b": 2000.0}
    assert mixing.curriculum(targets, counts, ramp).count() == 400


def test_shares_come_from_the_demand(spark, monkeypatch):
    counts = spark.createDataFrame([(i, "aaab"[i % 4], 10) for i in range(400)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 3.0, 1), ("m", "b", 1.0, 1)], "mix_id string, source string, weight double, max_repeats int")
    # supply equals demand: a tie is no shortage, also where the schedule varies
    ramp = mixing.tilted_schedule(targets)
    for schedule in (None, ramp):
        got = {r.source: r for r in mixing.shares(targets, counts, schedule).collect()}
        assert not got["a"].short and not got["b"].short and abs(got["a"].target_tokens - 3000) < 1e-6
    mean = {r.source: r.p for r in mixing.curriculum(targets, counts, ramp).groupBy("source").agg(F.avg("position").alias("p")).collect()}
    assert mean["a"] < mean["b"]
    was = mixing.demand
    monkeypatch.setattr(mixing, "demand", lambda *a: was(*a).withColumn("d1", 2 * F.col("d1")))
    assert all(r.short for r in mixing.shares(targets, counts).collect())


# 9 subjects


def test_subjects_of_plain_and_mixed_documents(spark):
    rng = random.Random(4)
    vocab = {"food": [f"soup{c}x" for c in "abcdefghijklmnopqrst"], "law": [f"court{c}x" for c in "abcdefghijklmnopqrst"]}
    say = lambda s, n: " ".join(rng.choice(vocab[s]) for _ in range(n))
    rows = [(i, say("food", 40) if i % 2 else say("law", 40)) for i in range(120)] + [(500, say("food", 20) + " " + say("law", 20)), (501, say("food", 38) + " " + say("law", 2)), (502, None), (503, ""), (504, "!!")]
    labels = spark.createDataFrame([(i, ("Food " if i % 2 else "law")) for i in range(0, 120, 3)] + [(1, "law"), (None, "law"), (3, None), (999, "food")], "doc_id bigint, subject string")
    areas = spark.createDataFrame([("food", "d"), ("law", "d")], "subject string, description string")
    # every word is in half of the documents here, which a real corpus calls common
    old, subjects.COMMON = subjects.COMMON, 1.0
    try:
        got = collections.defaultdict(set)
        for r in subjects.subject_areas(docs_of(spark, rows), labels, areas).collect():
            got[r.doc_id].add(r.subject)
    finally:
        subjects.COMMON = old
    right = sum(got[i] == ({"food"} if i % 2 else {"law"}) for i in range(120))
    assert right >= 114 and got[500] == {"food", "law"} and got[501] == {"food"} and not {502, 503, 504} & set(got)
    assert subjects.subject_areas(docs_of(spark, []), labels, areas).count() == 0




def test_leaves_that_tell_nothing_give_no_subject(spark):
    vectors = spark.createDataFrame([(1, 3, [0, 1], [2, 1]), (2, 1, [2], [1])], "doc_id bigint, n int, ids array<int>, counts array<int>")
    owner, size = np.array([0, 1, -1]), np.array([10.0, 10.0, 10.0])
    told = np.array([[9.0, 9, 0], [0, 0, 9], [3, 3, 3]])
    got = {(r.doc_id, r.subject): round(r.share, 2) for r in subjects.mixtures(vectors, told, size, owner, ["food", "law"]).collect()}
    assert got == {(1, "food"): 1.0, (2, "law"): 1.0}
    assert subjects.mixtures(vectors, np.full((3, 3), 5.0), size, owner, ["food", "law"]).count() == 0


def test_the_tree_is_fitted_on_every_passage(spark, monkeypatch):
    fitted = []

    class Fit(subjects.BisectingKMeans):
        def fit(self, rows):
            fitted.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(subjects, "BisectingKMeans", Fit)
    found = spark.range(20_500).select("id", F.array_repeat(F.concat(F.lit("w"), F.col("id") % 7), 30).alias("words")).withColumnRenamed("id", "doc_id")
    assert len(subjects.fit_leaves(found, [f"w{i}" for i in range(7)], leaves=3)) >= 2
    assert fitted == [20_500]


def test_every_two_nodes_of_a_common_term_are_compared(spark):
    nodes = spark.range(300).select(F.col("id").alias("node"), F.array(F.struct(F.lit(1).cast("long").alias("term"), (0.6 + F.col("id") * 0.001).alias("x"))).alias("terms"))
    got = {(r.i, r.j): r.s for r in clusters.similarity(nodes, 0.15).collect()}
    assert set(got) == {(i, j) for i in range(300) for j in range(i + 1, 300)}
    assert got[3, 290] == pytest.approx(0.603 * 0.89)


def test_a_slip_of_the_pen_is_the_name_that_is_meant(spark):
    terms = [("kolupaft", 9), ("kolupfat", 1), ("kolupaaft", 2), ("koluaft", 3), ("kolupift", 1), ("kolupoft", 5), ("molupift", 1), ("koluppaft", 4), ("ab", 9), ("aab", 1), ("zimelard", 3), ("zimelards", 3), ("zimelad", 1), ("zimmelards", 1)]
    got = {r.term: r.meant for r in clusters.misspelt(spark.createDataFrame(terms, "term string, df bigint")).collect()}
    assert got == {"kolupfat": "kolupaft", "kolupaaft": "kolupaft", "koluaft": "kolupaft", "zimelad": "zimelard", "zimmelards": "zimelards"}
    rows = [(i, f"Visitors to the Kolupaft bridge near Dodunor admire stone number {i}.") for i in range(6)] + [(6, "nothing named here, only the Kolupfat words"), (7, "only the Koolupaft words, nothing named here")]
    rows += [(100 + i, f"nothing named here, only the words w{i} and v{i}") for i in range(80)]
    members = {r.doc_id: r.cluster for r in clusters.thing_clusters(docs_of(spark, rows)).collect()}
    assert len({members[i] for i in range(8)}) == 1 and len(set(members.values())) == 81


def test_two_things_of_one_name_are_told_apart_by_their_areas(spark):
    rows = [(i, f"Clients of the Kolupaft bank praise Kolupaft for rate number {i}.") for i in range(6)]
    rows += [(10 + i, f"Otters of the Kolupaft river swim through Kolupaft at hour number {i}.") for i in range(6)]
    rows += [(20, "Who owns Kolupaft?"), (21, "Who swims at Kolupaft?"), (22, "Old Kolupaft, praised by clients and by anglers.")]
    rows += [(100 + i, f"nothing named here, only the words w{i} and v{i}") for i in range(80)]
    areas = [(i, "finance", 1.0) for i in [*range(6), 20]] + [(i, "nature", 1.0) for i in [*range(10, 16), 21]] + [(22, "finance", 0.6), (22, "music", 0.4)]
    areas = spark.createDataFrame(areas, "doc_id bigint, subject string, share double")
    members = {r.doc_id: r.cluster for r in clusters.thing_clusters(docs_of(spark, rows), areas).collect()}
    assert len({members[i] for i in [*range(6), 20, 22]}) == 1 and len({members[i] for i in [*range(10, 16), 21]}) == 1
    assert members[0] != members[10]
