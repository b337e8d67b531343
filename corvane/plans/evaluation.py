"""Queries of evaluation, report analytics and refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.text import STOP_WORDS
from corvane.operators import evaluate as ev
from corvane.operators import index as ix
from corvane.operators import lexical, refine
from corvane.plans.common import ANALYZER, ASKED, asked, bm25_run, index_of, search_tokens, sql_bm25, sql_index, sql_list, sql_top, terms_asked
from corvane.plans.sqltext import quoted
from corvane.runtime import keep
from corvane.sources.tables import table

#: The runs in the order in which they were made.
RUNS = ("bm25", "tfidf", "bert", "hybrid_rrf")
DEPTHS = ("map", "ndcg@1", "ndcg@5", "ndcg@10", "ndcg@20", "recall@10", "recall@100", "precision@10", "p@5", "ndcg", "recall")
K1S, BS = [0.6, 1.2, 1.8], [0.3, 0.75]
#: Measured latencies stand in for a service that is not here.
LATENCY = [("bm25", 12.5), ("tfidf", 11.0), ("bert", 48.25), ("hybrid_rrf", 63.0)]
#: A thesaurus in miniature, in its own order.
THESAURUS = [("good", 1, "fine"), ("good", 2, "sound"), ("good", 3, "decent"), ("old", 1, "ancient"), ("old", 2, "aged"), ("rare", 1, "scarce"), ("rare", 2, "not common"), ("work", 1, "labour"), ("museum", 1, "gallery"), ("near", 1, "close"), ("find", 1, "discover"), ("find", 2, "locate")]


def _judged(s, d):
    return ev.judgments(table(s, d, "qrels"))


def _gold(s, d):
    return ev.gold_queries(_judged(s, d), table(s, d, "queries"))


def _per_query(s, d, metrics=ev.METRICS, linear=False):
    run = table(s, d, "search_hits").select("run_label", "query_id", "doc_id", "score")
    return ev.evaluate(run, _judged(s, d), _gold(s, d), metrics, linear)


def _report(s, d, metrics=ev.METRICS):
    return ev.report(_per_query(s, d, metrics))


def _one(*metrics):
    return lambda s, d: _per_query(s, d, metrics)


def report_delta(s, d):
    """Judgments of grade 2 alone against all of them."""
    strict = _judged(s, d).withColumn("relevance", F.when(F.col("relevance") >= 2, 2).otherwise(0))
    run = table(s, d, "search_hits").select("run_label", "query_id", "doc_id", "score")
    return ev.report_delta(_report(s, d), ev.report(ev.evaluate(run, strict, _gold(s, d))))


def sweep_pivot(s, d):
    index, terms = index_of(s, d), terms_asked(s, d)
    # the metric looks at the first ten, so no later rank is made
    scores = lexical.bm25_top(index, terms, 10, [(k, b) for k in K1S for b in BS])
    run = keep(scores.select(F.concat_ws("/", F.col("k1").cast("string"), F.col("b").cast("string")).alias("run_label"), "query_id", "doc_id", "score"), "sweep")
    gold = _gold(s, d).join(terms.select("query_id").distinct(), "query_id", "left_semi")
    rep = ev.report(ev.evaluate(run, _judged(s, d), gold, ("ndcg@10",)))
    parts = F.split("run_label", "/")
    return ev.sweep_pivot(rep.select(parts[0].cast("double").alias("k1"), parts[1].cast("double").alias("b"), "value"), K1S)


def eval_refined(s, d):
    """BM25 for the asked queries as they are and with their spelling corrected once."""
    index = index_of(s, d)
    fixed = refine.correct(asked(s, d), _dictionary(s, d)).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "corrected"))).alias("w"))
    fixed = fixed.select("query_id", F.array_join(F.transform("w", lambda x: x["corrected"]), " ").alias("text"))
    plain = bm25_run(s, d, 100, index).select(F.lit("plain").alias("run_label"), "query_id", "doc_id", "score")
    again = ix.top_k(lexical.positive(lexical.bm25_scores(index, ix.query_terms(fixed, ANALYZER))), 100).select(F.lit("refined").alias("run_label"), "query_id", "doc_id", "score")
    gold = _gold(s, d).join(asked(s, d).select("query_id"), "query_id", "left_semi")
    return ev.report(ev.evaluate(plain.unionByName(again), _judged(s, d), gold))


def _dictionary(s, d):
    """The corpus as its own dictionary: letter words of at least three letters that occur twice or more."""
    return index_of(s, d).terms.where("cf >= 2").where(F.col("term").rlike("^[a-z]{3,}$")).select("term", "cf")


def refine_tokens(s, d):
    return table(s, d, "queries").select("query_id", refine.refine_tokens(F.col("text")).alias("tokens"))


def refine_entities(s, d):
    words = table(s, d, "queries").select("query_id", F.posexplode(refine.refine_tokens(F.col("text"))).alias("pos", "word"))
    return words.withColumn("entity", refine.is_entity(F.col("word"), F.col("pos")))


def spell_correct(s, d):
    return refine.correct(table(s, d, "queries"), _dictionary(s, d))


def _thesaurus(s):
    return s.createDataFrame(THESAURUS, "term string, ord int, synonym string")


def synonym_expand(s, d):
    words = table(s, d, "queries").select("query_id", F.posexplode(refine.refine_tokens(F.col("text"))).alias("pos", "corrected"))
    return refine.synonyms(words, _thesaurus(s), STOP_WORDS, 1).drop("place")


def refine_query(s, d):
    return refine.refine(table(s, d, "queries"), _dictionary(s, d), _thesaurus(s), STOP_WORDS)


QUERIES = {
    "eval_gold": lambda s, d: _gold(s, d).select("query_id"),
    "eval_precision": _one("precision@10", "p@5"),
    "eval_recall": _one("recall@10", "recall@100", "recall"),
    "eval_map": _one("map", "map@10"),
    "eval_ndcg": _one("ndcg@1", "ndcg@10", "ndcg"),
    "eval_ndcg_linear": lambda s, d: _per_query(s, d, ("ndcg@10", "ndcg"), linear=True),
    "eval_per_query": lambda s, d: _per_query(s, d).where(F.col("run_label").isin("bm25", "tfidf")),
    "eval_report": _report,
    "report_tidy": lambda s, d: _report(s, d, DEPTHS),
    "best_per_metric": lambda s, d: ev.best_per_metric(_report(s, d), RUNS),
    "report_delta": report_delta,
    "depth_curve": lambda s, d: ev.depth_curves(_report(s, d, DEPTHS)),
    "win_tie_loss": lambda s, d: ev.win_tie_loss(_per_query(s, d), "bm25", "tfidf"),
    "top_diffs": lambda s, d: ev.top_differences(_per_query(s, d), "bm25", "tfidf", "ndcg@10"),
    "query_extremes": lambda s, d: ev.query_extremes(_per_query(s, d), "ndcg@10"),
    "quality_latency": lambda s, d: ev.quality_latency(_report(s, d), s.createDataFrame(LATENCY, "run_label string, avg_query_ms double"), "map"),
    "sweep_pivot": sweep_pivot,
    "eval_refined": eval_refined,
    "refine_tokens": refine_tokens,
    "refine_entities": refine_entities,
    "spell_correct": spell_correct,
    "synonym_expand": synonym_expand,
    "refine_query": refine_query,
}


def sql() -> dict[str, str]:
    judged = """jd AS MATERIALIZED (SELECT query_id, doc_id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY seq DESC, dataset DESC) AS r FROM qrels WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND relevance IS NOT NULL) WHERE r = 1),
gold AS MATERIALIZED (SELECT query_id FROM queries WHERE query_id IN (SELECT query_id FROM jd))"""
    hits = "run AS (SELECT run_label, query_id, doc_id, score FROM search_hits)"

    def value(metric: str, linear: bool) -> str:
        kind, k = ev.parse_metric(metric)
        inside = f"rank <= {k}" if k else "true"
        gain = "relevance" if linear else "(pow(2, relevance) - 1)"
        if kind == "precision":
            return f"coalesce(sum(CASE WHEN relevance IS NOT NULL AND {inside} THEN 1 ELSE 0 END), 0) / {k}::DOUBLE"
        if kind == "recall":
            return f"CASE WHEN any_value(relevant) > 0 THEN coalesce(sum(CASE WHEN relevance IS NOT NULL AND {inside} THEN 1 ELSE 0 END), 0) / any_value(relevant)::DOUBLE ELSE 0 END"
        if kind == "map":
            return f"CASE WHEN any_value(relevant) > 0 THEN coalesce(sum(CASE WHEN relevance IS NOT NULL AND {inside} THEN hits / rank::DOUBLE ELSE 0 END), 0) / any_value(relevant) ELSE 0 END"
        depth = str(k) if k else "greatest(coalesce(max(rank), 1), 1)"
        best = f"list_sum(list_transform(any_value(gains)[1:{depth}], lambda x: x))"
        return f"CASE WHEN any_value(relevant) > 0 THEN coalesce(sum(CASE WHEN relevance IS NOT NULL AND {inside} THEN {gain} / log2(rank + 1) ELSE 0 END), 0) / {best} ELSE 0 END"

    def per_query(metrics, linear=False, run=hits, truth="jd", base=None):
        gain = "relevance" if linear else "(pow(2, relevance) - 1)"
        rows = " UNION ALL ".join(f"SELECT run_label, query_id, '{m}' AS metric, round(({value(m, linear)})::DOUBLE, 6) AS value FROM al GROUP BY run_label, query_id" for m in metrics)
        return f"""{base or 'WITH ' + judged}, {run}, tr AS (SELECT query_id, doc_id, relevance FROM {truth} JOIN gold USING (query_id) WHERE relevance > 0),
rn AS (SELECT *, row_number() OVER (PARTITION BY run_label, query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT run_label, query_id, doc_id, max(score) AS score FROM run JOIN gold USING (query_id) WHERE doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)),
ht AS (SELECT rn.*, relevance, sum(CASE WHEN relevance IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run_label, query_id ORDER BY rank) AS hits FROM rn LEFT JOIN tr USING (query_id, doc_id)),
id AS (SELECT query_id, count(*) AS relevant, list(g ORDER BY ir) AS gains FROM (SELECT query_id, row_number() OVER w AS ir, {gain} / log2(row_number() OVER w + 1) AS g FROM tr WINDOW w AS (PARTITION BY query_id ORDER BY relevance DESC, doc_id)) GROUP BY query_id),
al AS MATERIALIZED (SELECT e.run_label, e.query_id, rank, relevance, hits, relevant, gains FROM (SELECT DISTINCT run_label, gold.query_id FROM run, gold) e LEFT JOIN ht USING (run_label, query_id) LEFT JOIN id USING (query_id)),
pq AS MATERIALIZED ({rows})"""

    mean = ", rp AS MATERIALIZED (SELECT run_label, metric, round(avg(value), 9) AS value FROM pq GROUP BY run_label, metric)"
    everything, standard = per_query(DEPTHS), per_query(ev.METRICS)
    plain = " SELECT run_label, query_id, metric, value FROM pq"
    pair = ", df AS (SELECT query_id, metric, x.value AS a, y.value AS b, round(x.value - y.value, 6) AS diff FROM pq x JOIN pq y USING (query_id, metric) WHERE x.run_label = 'bm25' AND y.run_label = 'tfidf')"
    strict = per_query(ev.METRICS, truth="(SELECT query_id, doc_id, CASE WHEN relevance >= 2 THEN 2 ELSE 0 END AS relevance FROM jd)") + mean
    i = sql_index()
    grid = ", (VALUES " + ", ".join(f"({k}::DOUBLE, {b}::DOUBLE)" for k in K1S for b in BS) + ") g(k1, b)"
    sweep_base = i + sql_bm25("k1", "b", ", k1, b", grid) + ", " + judged.replace("WHERE query_id IN (SELECT query_id FROM jd))", "WHERE query_id IN (SELECT query_id FROM jd) AND query_id IN (SELECT query_id FROM qt))")
    sweep = per_query(("ndcg@10",), run="run AS (SELECT k1::VARCHAR || '/' || b::VARCHAR AS run_label, query_id, doc_id, score FROM bm)", base=sweep_base) + mean
    tokens = "regexp_extract_all(translate(text, '’', ''''), '[A-Za-z'']+')[1:64]"
    words = f"wd AS (SELECT query_id, unnest(tk) AS word, generate_subscripts(tk, 1) - 1 AS pos FROM (SELECT query_id, coalesce({tokens}, []) AS tk FROM queries))"
    entity = "(contains(word, '''') OR regexp_full_match(word, '[A-Z]{2,}') OR regexp_matches(substring(word, 2), '[A-Z]') OR (regexp_matches(word, '^[A-Z]') AND pos > 0))"
    spell = i + f""", dc AS MATERIALIZED (SELECT term, cf FROM terms WHERE cf >= 2 AND regexp_full_match(term, '[a-z]{{3,}}')), {words},
ws AS MATERIALIZED (SELECT *, CASE WHEN length(word) >= 3 AND NOT {entity} THEN lower(word) END AS low FROM wd),
ct AS (SELECT low, term, cf, damerau_levenshtein(low, term) AS dist FROM (SELECT DISTINCT low FROM ws WHERE low IS NOT NULL), dc WHERE abs(length(low) - length(term)) <= 2),
bs AS (SELECT low, term FROM ct WHERE dist <= 2 QUALIFY row_number() OVER (PARTITION BY low ORDER BY dist, cf DESC, term) = 1),
sc AS MATERIALIZED (SELECT query_id, pos, word, CASE WHEN term IS NULL OR term = low THEN word WHEN regexp_matches(word, '^[A-Z]') THEN upper(term[1]) || term[2:] ELSE term END AS corrected FROM ws LEFT JOIN bs USING (low))"""
    th = "(VALUES " + ", ".join(f"({quoted(a)}, {b}, {quoted(c)})" for a, b, c in THESAURUS) + ") t(term, ord, synonym)"
    stops = sql_list(STOP_WORDS)

    def syn(source: str, most: int) -> str:
        named = entity.replace("word", "corrected")
        return f"""wt AS (SELECT query_id, pos, corrected, lower(corrected) AS term FROM {source}),
tn AS (SELECT term, lower(replace(synonym, '_', ' ')) AS synonym, min(ord) AS ord FROM {th} WHERE NOT contains(replace(synonym, '_', ' '), ' ') AND lower(synonym) <> term GROUP BY ALL),
ft AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ord, synonym) AS place FROM tn QUALIFY place <= {most}),
fs AS (SELECT wt.query_id, wt.pos, wt.term, place, synonym FROM wt JOIN ft USING (term)
  WHERE length(wt.term) >= 3 AND NOT list_contains({stops}, wt.term) AND NOT {named} AND NOT EXISTS (SELECT 1 FROM wt o WHERE o.query_id = wt.query_id AND o.term = synonym)),
sy AS (SELECT query_id, pos, place, term, synonym FROM fs QUALIFY row_number() OVER (PARTITION BY query_id, synonym ORDER BY pos, place) = 1)"""

    scored = sql_bm25()
    again = scored[scored.index("bm AS MATERIALIZED"):].replace("bm AS MATERIALIZED", "b2 AS MATERIALIZED").replace("FROM qt JOIN", "FROM q2 JOIN")
    fixed = f"""rq AS (SELECT query_id, string_agg(corrected, ' ' ORDER BY pos) AS text FROM sc WHERE query_id::BIGINT % {ASKED} = 0 GROUP BY query_id),
q2 AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({search_tokens('text')}) AS term FROM rq) GROUP BY query_id, term)"""
    refined_base = spell + scored + ", " + fixed + ", " + again + ", " + judged.replace("WHERE query_id IN (SELECT query_id FROM jd))", f"WHERE query_id IN (SELECT query_id FROM jd) AND query_id::BIGINT % {ASKED} = 0)")
    refined_run = f"run AS (SELECT 'plain' AS run_label, query_id, doc_id, score FROM ({sql_top('bm', 100)}) UNION ALL SELECT 'refined' AS run_label, query_id, doc_id, score FROM ({sql_top('b2', 100)}))"

    return {
        "eval_refined": per_query(ev.METRICS, run=refined_run, base=refined_base) + mean + " SELECT * FROM rp",
        "eval_gold": "WITH " + judged + " SELECT query_id FROM gold",
        "eval_precision": per_query(("precision@10", "p@5")) + plain,
        "eval_recall": per_query(("recall@10", "recall@100", "recall")) + plain,
        "eval_map": per_query(("map", "map@10")) + plain,
        "eval_ndcg": per_query(("ndcg@1", "ndcg@10", "ndcg")) + plain,
        "eval_ndcg_linear": per_query(("ndcg@10", "ndcg"), True) + plain,
        "eval_per_query": standard + plain + " WHERE run_label IN ('bm25', 'tfidf')",
        "eval_report": standard + mean + " SELECT * FROM rp",
        "report_tidy": everything + mean + " SELECT * FROM rp",
        "best_per_metric": standard + mean + " SELECT metric, run_label, value FROM rp QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, coalesce(list_position(" + sql_list(RUNS) + ", run_label), 99), run_label) = 1",
        "report_delta": f"SELECT run_label, metric, a.value AS before, b.value AS after, round(b.value - a.value, 9) AS delta, CASE WHEN round(b.value - a.value, 9) > 1e-6 THEN 'up' WHEN round(b.value - a.value, 9) < -1e-6 THEN 'down' ELSE 'same' END AS direction FROM ({standard + mean} SELECT * FROM rp) a JOIN ({strict} SELECT * FROM rp) b USING (run_label, metric)",
        "depth_curve": everything + mean + " SELECT run_label, split_part(metric, '@', 1) AS family, split_part(metric, '@', 2)::INT AS k, value FROM rp WHERE contains(metric, '@') QUALIFY count(*) OVER (PARTITION BY run_label, split_part(metric, '@', 1)) >= 2",
        "win_tie_loss": standard + pair + " SELECT metric, sum((diff > 1e-6)::INT)::BIGINT AS wins, sum((abs(diff) <= 1e-6)::INT)::BIGINT AS ties, sum((diff < -1e-6)::INT)::BIGINT AS losses FROM df GROUP BY metric",
        "top_diffs": standard + pair + " SELECT query_id, a, b, diff FROM df WHERE metric = 'ndcg@10' ORDER BY abs(diff) DESC, query_id LIMIT 10",
        "query_extremes": standard + """, x AS (SELECT * FROM pq WHERE metric = 'ndcg@10'), y AS (SELECT *, row_number() OVER (PARTITION BY run_label ORDER BY value, query_id)::INT AS lo, row_number() OVER (PARTITION BY run_label ORDER BY value DESC, query_id)::INT AS hi FROM x)
SELECT run_label, 'worst' AS kind, lo AS place, query_id, value FROM y WHERE lo <= 8 UNION ALL SELECT run_label, 'best' AS kind, hi AS place, query_id, value FROM y WHERE hi <= 8""",
        "quality_latency": standard + mean + " SELECT run_label, value, avg_query_ms FROM rp JOIN (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE)" for a, b in LATENCY) + ") l(run_label, avg_query_ms) USING (run_label) WHERE metric = 'map'",
        "sweep_pivot": sweep + " SELECT split_part(run_label, '/', 2)::DOUBLE AS b, " + ", ".join(f"max(CASE WHEN split_part(run_label, '/', 1)::DOUBLE = {k} THEN value END) AS k1_{str(k).replace('.', '_')}" for k in K1S) + " FROM rp GROUP BY 1",
        "refine_tokens": f"SELECT query_id, coalesce({tokens}, []) AS tokens FROM queries",
        "refine_entities": f"WITH {words} SELECT query_id, pos::INT AS pos, word, {entity} AS entity FROM wd",
        "spell_correct": spell + " SELECT query_id, pos::INT AS pos, word, corrected FROM sc",
        "synonym_expand": f"WITH {words}, {syn('(SELECT query_id, pos, word AS corrected FROM wd)', 1)} SELECT query_id, pos::INT AS pos, term, synonym FROM sy",
        "refine_query": spell + ", " + syn("sc", 2).replace("WITH ", "") + """, ln AS (SELECT query_id, string_agg(corrected, ' ' ORDER BY pos) AS corrected, bool_or(word <> corrected) AS spelled FROM sc GROUP BY query_id),
ad AS (SELECT query_id, string_agg(synonym, ' ' ORDER BY pos, place) AS added FROM sy GROUP BY query_id),
al AS (SELECT query_id, text AS original, coalesce(corrected, '') AS corrected, trim(concat_ws(' ', coalesce(corrected, ''), coalesce(added, '')), ' ') AS refined, coalesce(spelled, false) AS spelled, coalesce(added, '') <> '' AS expanded FROM queries LEFT JOIN ln USING (query_id) LEFT JOIN ad USING (query_id))
SELECT query_id, original, corrected, refined, CASE WHEN corrected <> '' AND lower(corrected) <> lower(trim(coalesce(original, ''), ' ')) THEN corrected END AS suggestion, concat_ws(',', CASE WHEN spelled THEN 'spell_correction' END, CASE WHEN expanded THEN 'synonym_expansion' END) AS applied FROM al""",
    }
