"""Subject areas of documents: bisecting k-means leaves, labelled by discriminative terms, mixed per document.

The tree is fitted on all passages; every document is then placed in it, and each leaf's term distribution is counted over all
documents. A leaf is named by its discriminative terms: by the subject whose labelled documents hold them most. Labels do nothing else. A document
is a mixture of leaves: the weights of the leaves whose term distributions explain its words best (by expectation maximisation), and
the weights of the leaves of a subject add up to the subject's share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.reading import read, words_of
from corvane.runtime import keep, rows_of

#: Terms that become dimensions are in less than COMMON of the documents of each language and in at least RARE of all: at
#: most 1/RARE x mean size of a document of them.
COMMON, RARE = 0.08, 0.0004
#: Leaves of the tree, passes over the passages for each split, and terms that name a leaf.
LEAVES, PASSES, NAMED = 200, 6, 40
#: Words a passage has at least.
PASSAGE = 30
#: A leaf is named when at least this part of its discriminative terms' weight speaks for one subject.
CLEAR = 0.4
#: Steps of the estimation of a mixture, and documents estimated at once.
STEPS, AT_ONCE = 6, 400
SHARE = 1 / 3


def _words(b: pd.DataFrame) -> pd.DataFrame:
    found = [words_of(t) for t in b["text"]]
    lang = b["lang"] if "lang" in b else pd.Series([None] * len(b), index=b.index)
    out = pd.DataFrame({"doc_id": b["doc_id"], "lang": lang.map(lambda x: x.lower(), na_action="ignore").astype(object), "words": found})
    return out[[len(w) > 0 for w in found]]


def document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, words) of the texts as they read; null ids, null texts and texts without words are left out."""
    return read(docs, ["doc_id", "lang"] if "lang" in docs.columns else ["doc_id"], _words, "doc_id bigint, lang string, words array<string>")


def vocabulary(found: DataFrame) -> pd.DataFrame:
    """(term, df) of the terms that become dimensions, counted over all documents.

    A term in more than COMMON of the documents of any language says nothing of their subject. Languages are as
    declared; a wrong or missing declaration only blurs the count, and languages under 1/1000 of all documents have no say.
    """
    n = found.count()
    sizes = found.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") * 1000 > n)
    by_lang = found.select("lang", F.explode(F.array_distinct("words")).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))
    part = F.when(F.col("df") >= 5, F.col("df") / F.col("docs"))
    df = by_lang.join(F.broadcast(sizes), "lang", "left").groupBy("term").agg(F.sum("df").alias("df"), F.coalesce(F.max(part), F.lit(0.0)).alias("part"))
    kept = df.where((F.col("df") >= max(3, RARE * n)) & (F.col("part") <= COMMON) & (F.length("term") > 2) & ~F.col("term").rlike("[0-9]"))
    return kept.select("term", "df").toPandas().sort_values("term", ignore_index=True)


def encoded(found: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, ids, counts): the known terms of each document by number, and the number of its words."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [Counter(number[w] for w in ws if w in number) for ws in b["words"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [len(w) for w in b["words"]], "ids": [list(c) for c in each], "counts": [list(c.values()) for c in each]})

    return found.select("doc_id", "words").mapInPandas(run, "doc_id bigint, n int, ids array<int>, counts array<int>")


def fit_leaves(found: DataFrame, vocab: list[str], leaves: int = LEAVES, seed: int = 7) -> np.ndarray:
    """Centres (leaf x term, unit length, inverse document frequency included) of a bisecting k-means tree of all passages.

    Vectors are binary, weighted by inverse document frequency and of length one. Texts under PASSAGE words say too
    little to shape the tree; without any passage the short texts shape it.
    """
    passages = found.where(F.size("words") >= PASSAGE)
    if passages.isEmpty():
        passages = found
    counted = CountVectorizerModel.from_vocabulary(vocab, "words", "counts").setBinary(True).transform(passages.select("words")).select("counts")
    idf = IDF(inputCol="counts", outputCol="weights").fit(counted)
    unit = keep(Normalizer(inputCol="weights", outputCol="features").transform(idf.transform(counted)).select("features"), "passages").persist()
    try:
        model = BisectingKMeans(k=leaves, maxIter=PASSES, seed=seed, minDivisibleClusterSize=8.0).fit(unit)
    finally:
        unit.unpersist()
    centres = np.array([np.asarray(c) for c in model.clusterCenters()])
    length = np.linalg.norm(centres, axis=1, keepdims=True)
    return (centres / np.where(length > 0, length, 1) * idf.idf.toArray()).astype(np.float32)


def _chunks(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents with a known term, some at once: rows, terms, counts, first term and owner of each."""
    b = b[[len(x) > 0 for x in b["ids"]]]
    for lo in range(0, len(b), AT_ONCE):
        part = b.iloc[lo : lo + AT_ONCE]
        sizes = np.fromiter(map(len, part["ids"]), np.int64, len(part))
        yield part, np.concatenate([*part["ids"]]).astype(np.int64), np.concatenate([*part["counts"]]).astype(np.float32), np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(part)), sizes)


def place(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(doc_id, leaf, ids): every document with a known term in its nearest leaf, by the cosine. ``centres`` has at most leaves x terms numbers."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.ascontiguousarray(centres.T))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_term = shared.value
        for b in batches:
            for part, ids, _, starts, _ in _chunks(b):
                yield pd.DataFrame({"doc_id": part["doc_id"], "leaf": np.add.reduceat(by_term[ids], starts).argmax(1).astype(np.int32), "ids": part["ids"]})

    return vectors.select("doc_id", "ids", "counts").mapInPandas(run, "doc_id bigint, leaf int, ids array<int>")


def _grid(counts: pd.DataFrame, rows: dict, row: str, terms: int) -> np.ndarray:
    out = np.zeros((len(rows), terms))
    out[[rows[x] for x in counts[row]], counts["term"]] = counts["n"]
    return out


def name_leaves(in_leaf: np.ndarray, size: np.ndarray, in_subject: np.ndarray, names: list[str], subjects: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """The subject of each leaf (its number, -1 for none), and rows (leaf, subject, size, top terms).

    A leaf's discriminative terms are those with the largest gain over their share in the corpus. Its subject is the one
    whose labelled documents hold these terms most, if it leads clearly; leaves of mixed or no subject stay without a name.
    """
    rate, overall = (in_leaf + 0.1) / (size[:, None] + 1), (in_leaf.sum(0) + 0.1) / (size.sum() + 1)
    gain = in_leaf * np.log(rate / overall)
    spread = (in_subject + 0.02) / (in_subject.sum(1, keepdims=True) + 1)
    spread = spread / spread.sum(0)
    owner, rows = np.full(len(size), -1), []
    for i in range(len(size)):
        top = [j for j in np.argsort(-gain[i], kind="stable")[:NAMED] if gain[i, j] > 0]
        seen = [j for j in top if in_subject[:, j].sum() > 0]
        score = (gain[i, seen] * spread[:, seen]).sum(1) if seen else np.zeros(len(subjects))
        if score.sum() > 0 and score.max() >= CLEAR * score.sum():
            owner[i] = score.argmax()
        rows.append((i, subjects[owner[i]] if owner[i] >= 0 else None, int(size[i]), [names[j] for j in top[:10]]))
    return owner, rows


def mixtures(vectors: DataFrame, in_leaf: np.ndarray, size: np.ndarray, owner: np.ndarray, subjects: list[str]) -> DataFrame:
    """(doc_id, subject, share): each document as a mixture of named leaves, added up by subject.

    The part of a leaf is estimated in STEPS steps of expectation maximisation from the leaf's size: a word is divided among the leaves by how often
    they hold it and by the leaves' parts so far; words count by what they tell of subjects. Shares of a document add up to one.
    """
    named = owner >= 0
    kinds = np.eye(len(subjects), dtype=np.float32)[owner[named]]
    held = in_leaf[named] + 1e-3
    by_subject = kinds.T @ (held / held.sum(1, keepdims=True) * size[named, None])
    part = by_subject / by_subject.sum(1, keepdims=True)
    given = part / part.sum(0)
    tells = (given * np.log(given * len(subjects) + 1e-12)).sum(0) / np.log(max(len(subjects), 2))
    tables = (held / held.sum(1, keepdims=True)).T.astype(np.float32), np.maximum(tells, 0).astype(np.float32), (size[named] / size[named].sum()).astype(np.float32), kinds
    shared = vectors.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        likely, weight, prior, kinds = shared.value
        for b in batches:
            for rows, ids, counts, starts, owner in _chunks(b):
                p, w = likely[ids], (counts * weight[ids])[:, None]
                parts = np.repeat(prior[None, :], len(rows), 0)
                for _ in range(STEPS):
                    r = p * parts[owner]
                    r *= w / np.maximum(r.sum(1, keepdims=True), 1e-30)
                    parts = np.add.reduceat(r, starts)
                    total = parts.sum(1, keepdims=True)
                    parts = parts / np.maximum(total, 1e-30)
                share = parts @ kinds
                d, s = np.nonzero((share >= 1e-3) & (total > 1e-6))
                if len(d):
                    yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[d], "subject": pd.Series([subjects[x] for x in s], dtype=object), "share": share[d, s].astype(float)})

    return vectors.select("doc_id", "ids", "counts").mapInPandas(run, "doc_id bigint, subject string, share double")


def subject_mixtures(docs: DataFrame, labels: DataFrame, subjects: DataFrame, leaves: int = LEAVES, shuffled: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, subject, share) with the part of each document that lies in each area, and the leaves (leaf, subject, size, top_terms).

    ``subjects`` is the table of areas, at most 1,000. Labels may be wrong, repeated, oddly spelled or null; those of unknown areas
    or documents are ignored. Documents without a known term have no row, and so have null or empty texts. ``shuffled`` is a seed by which
    documents are put into random leaves: a control, which must destroy the result.
    """
    spark = docs.sparkSession
    areas = sorted({r.subject for r in rows_of(subjects.select("subject").dropna(), 1000)})
    found = keep(document_words(docs), "words")
    vocab = vocabulary(found)
    mixture, leaf = "doc_id bigint, subject string, share double", "leaf int, subject string, size bigint, top_terms array<string>"
    if not areas or not len(vocab):
        return spark.createDataFrame([], mixture), spark.createDataFrame([], leaf)
    names = list(vocab["term"])
    vectors = keep(encoded(found, names), "vectors")
    centres = fit_leaves(found, names, leaves)
    placed = place(vectors, centres)
    if shuffled is not None:
        placed = placed.withColumn("leaf", F.pmod(F.xxhash64("doc_id", F.lit(shuffled)), F.lit(len(centres))).cast("int"))
    placed = keep(placed, "placed")
    known = {s.strip().lower(): i for i, s in enumerate(areas)}
    said = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(list(known))).distinct()
    count = lambda rows, key: rows.select(key, F.explode("ids").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")).toPandas()
    rows = {i: i for i in range(len(centres))}
    in_leaf, in_subject = _grid(count(placed, "leaf"), rows, "leaf", len(names)), _grid(count(placed.join(said, "doc_id"), "subject"), known, "subject", len(names))
    sizes = placed.groupBy("leaf").count().toPandas().set_index("leaf")["count"].reindex(range(len(centres)), fill_value=0).to_numpy(float)
    owner, named = name_leaves(in_leaf, sizes, in_subject, names, areas)
    shown = spark.createDataFrame(named, leaf)
    if (owner < 0).all():
        return spark.createDataFrame([], mixture), shown
    return mixtures(vectors, in_leaf, sizes, owner, areas), shown


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE, shuffled: int | None = None) -> DataFrame:
    """(doc_id, subject): each area that makes up at least ``share`` of a document."""
    return subject_mixtures(docs, labels, subjects, shuffled=shuffled)[0].where(F.col("share") >= share - 1e-9).select("doc_id", "subject").distinct()
