"""Clusters and topics: vocabularies, LSA with k-means, LDA, nearest groups, quality measures."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, KMeans, KMeansModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corvane.functions.records import record_terms
from corvane.functions.text import content_tokens
from corvane.runtime import keep

FEATURES, NONE = 20_000, -1
#: Matrices of columns x rank that reach the driver at once: a bound of its memory.
SVD_PARTS = 8


def not_blank(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"\S"))


def vocabulary(tokens: DataFrame, min_df: int = 2, max_df: float = 0.6, features: int = FEATURES) -> DataFrame:
    """(term, df, cf): the most frequent ``features`` terms with ``min_df <= df <= max_df * n``, ties by the smaller term."""
    n = tokens.count()
    every = record_terms(tokens, ["doc_id"], F.col("tokens")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return every.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n))).orderBy(F.desc("cf"), "term").limit(features)


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distances(vectors: DataFrame, centroids: DataFrame, item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(item, group_id, distance) to every centroid (group_id, vector); centroids are model parameters, a few hundred rows."""
    return vectors.select(item, F.col(vector).alias("v")).join(F.broadcast(centroids)).select(item, "group_id", F.round(F.sqrt(squared_distance(F.col("v"), F.col("vector"))), 6).alias("distance"))


def assign_nearest(vectors: DataFrame, centroids: DataFrame, item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(item, group_id, distance) of the nearest centroid, ties by the smaller group; an aggregate, so nothing is sorted."""
    d = distances(vectors, centroids, item, vector)
    return d.groupBy(item).agg(F.min(F.struct("distance", "group_id")).alias("m")).select(item, "m.group_id", "m.distance")


def group_sizes(members: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(group, size) of every group, 0 for those without members."""
    return groups.select(group).distinct().join(members.groupBy(group).agg(F.count(F.lit(1)).alias("size")), group, "left").select(group, F.coalesce("size", F.lit(0)).alias("size"))


def inertia(vectors: DataFrame, centroids: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """One row: the sum of squared distances to the own centroid."""
    c = centroids.select(F.col("group_id").alias(group), F.col("vector").alias("c"))
    return vectors.join(F.broadcast(c), group).agg(F.round(F.sum(squared_distance(F.col(vector), F.col("c"))), 4).alias("inertia"))


def silhouette(vectors: DataFrame, item: str = "vec_id", group: str = "label", vector: str = "embedding", most: int = 2000, seed: int = 42) -> DataFrame:
    """One row: the mean silhouette of a sample of at most ``most`` vectors, by Euclidean distance between all its pairs.

    The sample is the measure's own definition and bounds the pairs; it is broadcast.
    """
    sample = vectors.where(F.col(vector).isNotNull()).select(F.col(item).alias("i"), F.col(group).alias("g"), F.col(vector).alias("v")).orderBy(F.xxhash64(item, F.lit(seed)), item).limit(most)
    other = F.broadcast(sample.select(F.col("i").alias("j"), F.col("g").alias("h"), F.col("v").alias("w")))
    mean = sample.join(other, F.col("i") != F.col("j")).select("i", "g", "h", F.sqrt(squared_distance(F.col("v"), F.col("w"))).alias("d")).groupBy("i", "g", "h").agg(F.avg("d").alias("d"))
    each = mean.groupBy("i", "g").agg(F.min(F.when(F.col("g") == F.col("h"), F.col("d"))).alias("a"), F.min(F.when(F.col("g") != F.col("h"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.round(F.avg(s), 6).alias("silhouette"))


@dataclass
class Clusters:
    """A fitted cluster model with its vocabulary and the tables derived from it."""

    vocabulary: list[str]
    vectors: DataFrame
    model: KMeansModel
    components: list[list[float]]

    def members(self) -> DataFrame:
        """(doc_id, cluster): every document with a known term."""
        return self.model.transform(self.vectors.where("known")).select("doc_id", F.col("prediction").alias("cluster"))

    def assign(self) -> DataFrame:
        """As members, with -1 for documents without a known term."""
        return self.model.transform(self.vectors).select("doc_id", F.when(F.col("known"), F.col("prediction")).otherwise(NONE).alias("cluster"))

    def terms(self, top: int = 10) -> DataFrame:
        """(cluster, rank, term): the centroid mapped back to terms."""
        rows = []
        for c, centre in enumerate(self.model.clusterCenters()):
            weight = [sum(x * y for x, y in zip(centre, row)) for row in self.components]
            best = sorted(range(len(weight)), key=lambda j: (-weight[j], self.vocabulary[j]))[:top]
            rows += [(c, r + 1, self.vocabulary[j]) for r, j in enumerate(best)]
        return self.vectors.sparkSession.createDataFrame(rows, "cluster int, rank int, term string")

    def points(self, most: int = 1500, seed: int = 42) -> DataFrame:
        """(doc_id, x, y, cluster) of a sample for plotting: the first two dimensions before scaling."""
        placed = self.model.transform(self.vectors.where("known"))
        some = placed.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
        raw = vector_to_array("raw")
        return some.select("doc_id", F.round(raw[0], 4).alias("x"), F.round(raw[1], 4).alias("y"), F.col("prediction").alias("cluster"))


def _sample(tokens: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` documents by a hash of the id, written once to the shared folder over all cores."""
    some = tokens.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    return keep(some.repartition(tokens.sparkSession.sparkContext.defaultParallelism), "fit_sample")


def fit_clusters(docs: DataFrame, k: int = 8, features: int = FEATURES, dims: int = 128, max_docs: int = 20_000, seeds: int = 10, seed: int = 42) -> Clusters:
    """TF-IDF, a truncated SVD and k-means (the best of several starts), fitted on at most ``max_docs`` documents and
    applied to all. Fewer documents than clusters is an error; a vocabulary emptied by its bounds is tried without them.
    """
    tokens = not_blank(docs).select("doc_id", content_tokens(F.col("text")).alias("tokens"))
    part = _sample(tokens, max_docs, seed)
    n = part.count()
    if n < k:
        raise ValueError(f"{n} documents are too few for {k} clusters")
    vocab = vocabulary(part, features=features).collect() or vocabulary(part, 1, 1.0, features).collect()
    terms = sorted(r.term for r in vocab)
    idf = {r.term: r.df for r in vocab}
    weight = [math.log((1 + n) / (1 + idf[t])) + 1 for t in terms]
    counted = CountVectorizerModel.from_vocabulary(terms, "tokens", "counts")
    scaled = _scale(counted.transform(tokens), weight)
    fit = _scale(counted.transform(part), weight)
    v = right_singular_vectors(fit, len(terms), max(2, min(dims, len(terms) - 1, n - 1)), seed)
    space = v.tolist()
    project = _projector(v)
    normal = Normalizer(inputCol="raw", outputCol="features")
    vectors = normal.transform(project(scaled))
    train = keep(normal.transform(project(fit)).select("features"), "fit_vectors")
    best = min((KMeans(k=k, seed=seed + i, maxIter=30).fit(train) for i in range(seeds)), key=lambda m: m.summary.trainingCost)
    return Clusters(terms, vectors.select("doc_id", "raw", "features", "known"), best, space)


def _scale(df: DataFrame, weight: list[float]) -> DataFrame:
    product = ElementwiseProduct(scalingVec=Vectors.dense(weight), inputCol="counts", outputCol="weighted")
    return Normalizer(inputCol="weighted", outputCol="tfidf").transform(product.transform(df))


_PARTS = "tfidf struct<indices:array<int>,values:array<double>>"


def _sparse(df: DataFrame) -> DataFrame:
    """``df`` with ``_p``, the indices and values of its sparse vector: only the entries that are there travel to Python."""
    return df.withColumn("_p", F.from_json(F.to_json(F.struct("tfidf")), _PARTS)["tfidf"])


def right_singular_vectors(fit: DataFrame, columns: int, rank: int, seed: int = 42, passes: int = 5, extra: int = 10) -> np.ndarray:
    """The leading right singular vectors (columns x rank) of the rows' sparse vectors, by subspace iteration.

    Each pass adds up, for every part of the bounded fitting sample, its product with the current subspace; what reaches the
    driver is a matrix of columns x rank for each of at most SVD_PARTS parts, whatever the corpus.
    """
    width = min(rank + extra, columns)
    rows = keep(_sparse(fit).select("_p.indices", "_p.values"), "fit_entries").coalesce(SVD_PARTS)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, width)))[0]

    def product(v: np.ndarray) -> np.ndarray:
        def add(batches):
            total = np.zeros((columns, width))
            for b in batches:
                for i, x in zip(b["indices"], b["values"]):
                    if len(i):
                        at, x = np.asarray(i, int), np.asarray(x)
                        total[at] += np.outer(x, x @ v[at])
            yield pd.DataFrame({"m": [total.tobytes()]})

        return sum(np.frombuffer(r.m).reshape(columns, width) for r in rows.mapInPandas(add, "m binary").collect())

    for _ in range(passes):
        basis = np.linalg.qr(product(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    found = basis @ turn[:, np.argsort(-values)[:rank]]
    return found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])


def _projector(v):
    @F.pandas_udf(ArrayType(DoubleType()))
    def times(indices: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x) @ v[np.asarray(i, int)] if len(i) else np.zeros(v.shape[1]) for i, x in zip(indices, values)])

    def project(df: DataFrame) -> DataFrame:
        return _sparse(df).withColumn("raw", array_to_vector(times("_p.indices", "_p.values"))).withColumn("known", F.size("_p.indices") > 0).drop("_p")

    return project


def fit_topics(docs: DataFrame, topics: int = 10, features: int = FEATURES, max_df: float = 0.5, iterations: int = 10, max_docs: int = 20_000, seed: int = 42):
    """(terms, model, vectors): LDA fitted on at most ``max_docs`` documents, with the word counts of all.

    There is no retry without the frequency bounds: an empty vocabulary is an error.
    """
    tokens = not_blank(docs).select("doc_id", content_tokens(F.col("text")).alias("tokens"))
    part = _sample(tokens, max_docs, seed)
    terms = sorted(r.term for r in vocabulary(part, 2, max_df, features).collect())
    if not terms:
        raise ValueError("no term is left")
    counted = CountVectorizerModel.from_vocabulary(terms, "tokens", "features")
    model = LDA(k=topics, maxIter=iterations, seed=seed, optimizer="online", subsamplingRate=1.0).fit(counted.transform(part))
    return terms, model, counted.transform(tokens)


def topic_terms(terms: list[str], model, top: int = 12) -> DataFrame:
    """(topic, rank, term, weight): the heaviest terms of each topic and their part of its weight."""
    found = model.describeTopics(top)
    words = F.array(*map(F.lit, terms))
    pairs = F.transform(F.arrays_zip("termIndices", "termWeights"), lambda x: F.struct(F.get(words, x["termIndices"]).alias("term"), F.round(x["termWeights"], 5).alias("weight")))
    return found.select("topic", F.posexplode(pairs).alias("p", "x")).select("topic", (F.col("p") + 1).alias("rank"), "x.term", "x.weight")


def topic_mixtures(model, vectors: DataFrame) -> DataFrame:
    """(doc_id, mixture, topic): the rounded mixture and its largest part; -1 without a known term."""
    found = model.transform(vectors).select("doc_id", F.transform(vector_to_array("topicDistribution"), lambda x: F.round(x, 4)).alias("mixture"))
    top = F.array_position("mixture", F.array_max("mixture")).cast("int") - 1
    return found.select("doc_id", "mixture", F.when(F.array_max("mixture") > 0, top).otherwise(NONE).alias("topic"))


def topic_label(terms):
    """The first two terms as a label; a dash for no topic."""
    return F.when(F.size(terms) > 0, F.array_join(F.slice(terms, 1, 2), " / ")).otherwise("—")


def fit_word_vectors(tokens: DataFrame, size: int = 100, window: int = 5, min_count: int = 2, iterations: int = 5, seed: int = 42):
    """Skip-gram vectors. All cores fit at once: each pass trains every sentence in one part, and the parts' vectors are averaged after it."""
    parts = tokens.sparkSession.sparkContext.defaultParallelism
    return Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, seed=seed, numPartitions=parts, inputCol="tokens", outputCol="pooled").fit(tokens)


def word_vector_documents(model, tokens: DataFrame) -> DataFrame:
    """(doc_id, vector): mean of the known words' vectors at length one; zeros if none is known."""
    return Normalizer(inputCol="pooled", outputCol="unit").transform(model.transform(tokens)).select("doc_id", vector_to_array("unit").alias("vector"))


def group_distance_order(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(query_id, group_id, distance) for :func:`corvane.operators.fusion.nearest_members`."""
    return distances(queries.select("query_id", F.col("vector").alias("embedding")), centroids, "query_id")


