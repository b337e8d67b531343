"""Dense vectors: exact search in blocks, pooling, pluggable encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corvane.runtime import keep

#: Queries multiplied with all vectors at once; more queries take more passes over the vectors.
BLOCK = 4096


def unit(vector: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _blocks(files: list[str], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the stored queries, ``block`` at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for f in files:
        system, inside = fs.FileSystem.from_uri(f if "://" in f or f.startswith("file:/") else "file://" + f)
        with system.open_input_file(inside) as source:
            for part in pq.ParquetFile(source).iter_batches(block):
                rows = part.to_pandas()
                if len(rows):
                    yield rows["query_id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(float)


def _scan(files: list[str], block: int, k: int, least: float | None):
    """A function of batches (item, vector): the k best items of each batch for each stored query, one frame a batch and block of queries."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["vector"].notna()]
            if not len(b):
                continue
            vectors, items = np.stack(b["vector"].to_numpy()).astype(float).T, b["item"].to_numpy()
            for ids, matrix in _blocks(files, block):
                scores = np.round(matrix @ vectors, 6) + 0.0
                q, at = np.nonzero(scores > least) if least is not None else np.indices(scores.shape).reshape(2, -1)
                order = np.lexsort((items[at], -scores[q, at], q))
                q, at = q[order], at[order]
                first = np.searchsorted(q, q)
                best = np.arange(len(q)) - first < k
                if best.any():
                    yield pd.DataFrame({"query_id": ids[q[best]], "doc_id": items[at[best]], "score": scores[q[best], at[best]]})

    return scan


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, item: str = "vec_id", vector: str = "embedding", least: float | None = 0.0, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): the k vectors with the largest dot product above ``least`` for each of a stated
    set of queries (query_id, vector), ties by the smaller id.

    The queries are written to the shared folder and read by each task in blocks of bounded size; a task multiplies a block with its batch
    and passes on at most k rows a query, so the shuffle holds k rows for each query and batch. Null vectors match nothing.
    """
    rows = queries.where("vector is not null").select(F.col("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    source = vectors.select(F.col(item).alias("item"), F.col(vector).cast("array<float>").alias("vector"))
    kind = dict(rows.dtypes)["query_id"], dict(source.dtypes)["item"]
    schema = f"query_id {kind[0]}, doc_id {kind[1]}, score double"
    files = keep(rows, "vector_queries").inputFiles()
    out = source.mapInPandas(_scan(list(files), block, k, least), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_scores(vectors: DataFrame, queries: DataFrame, candidates: DataFrame, item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score) of exactly the known candidates, whatever the sign."""
    pool = candidates.select("query_id", "doc_id").distinct().join(vectors.select(F.col(item).alias("doc_id"), F.col(vector).alias("v")), "doc_id").join(queries.select("query_id", "vector"), "query_id")
    return pool.select("query_id", "doc_id", F.round(dot(F.col("v"), F.col("vector")), 6).alias("score"))


def mean_pool(members: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, vector): the mean of the members' vectors at length one; zeros stay zeros."""
    parts = members.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))
    mean = parts.groupBy(key, "d").agg(F.avg("x").alias("x"))
    vec = mean.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).select(key, F.transform("v", lambda s: s["x"]).alias("vector"))
    return vec.select(key, unit(F.col("vector")).alias("vector"))


def encode(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", batch: int = 64) -> DataFrame:
    """``texts`` with ``vector`` by a pluggable encoder: ``encoder()`` loads it once for each Python worker. Null texts count as empty."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for s in batches:
            parts = [model(s.iloc[i : i + batch].fillna("").tolist()) for i in range(0, len(s), batch)]
            rows = np.concatenate(parts) if parts else np.zeros((0, 1))
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list(np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0).astype("float32")))

    return texts.withColumn("vector", run(F.col(text)))


def hashing_encoder(dim: int = 64):
    """A stand-in for tests and demonstrations: hashed words, no trained model."""

    def load():
        import zlib

        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h & 1024 else -1
            return out

        return model

    return load
