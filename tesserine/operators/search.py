"""Top-k by cosine: exact for one query or many, and through graphs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions import vectors as vx

#: Numbers in the queries that a batch search sends to every task, at most; beyond it queries go in rounds.
QUERY_NUMBERS = 8_000_000


def _checked(k: int) -> int:
    if k < 0:
        raise ValueError("k must not be negative")
    return k


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 5, key: str = "chunk_idx", vec: str = "vec") -> DataFrame:
    """(key, score) of the k best for one unit query, ties by key. The query is a literal, so nothing is joined or shuffled but the k of each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, vx.dot(F.col(vec), q).cast("float").alias("score")).orderBy(F.desc("score"), key).limit(_checked(k))


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vec: str = "vec", decimals: int | None = None) -> DataFrame:
    """(query_key, key, score, rank) for every query of a table, in one pass over the vectors.

    Queries are a bounded set: they are collected, and multiplied with each block of vectors. Each block keeps k for each query, so the shuffle has k
    rows for each query and block however many vectors there are. More queries than QUERY_NUMBERS allow go in rounds.
    """
    _checked(k)
    rows = queries.select(query_key, vec).toArrow()
    ids, dims = rows.column(0), len(rows.column(1)[0]) if len(rows) else 0
    every = max(1, QUERY_NUMBERS // max(dims, 1))
    out = None
    for at in range(0, max(len(rows), 1), every):
        part = rows.slice(at, every)
        own = _block_top_k(vectors, ids.slice(at, every).to_pylist(), np.array(part.column(1).to_pylist(), np.float64).reshape(len(part), dims), k, key, query_key, queries.schema[query_key].dataType, vec, decimals)
        out = own if out is None else out.unionByName(own)
    by = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _block_top_k(vectors: DataFrame, ids: list, q: np.ndarray, k: int, key: str, query_key: str, query_type: T.DataType, vec: str, decimals: int | None) -> DataFrame:
    import pyarrow as pa

    held = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):  # noqa: ANN001, ANN202
        names, matrix = held.value
        best_s = np.full((len(names), 0), 0.0)
        best_k = np.empty((len(names), 0), np.int64)
        for batch in batches:
            if not len(batch) or not names:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            s = matrix @ x.T
            s = np.round(s, decimals) if decimals is not None else s
            s, ids = np.hstack([best_s, s]), np.hstack([best_k, np.broadcast_to(own, s.shape)])
            order = np.lexsort((ids, -s), axis=1)[:, :k]
            best_s, best_k = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)
        n = best_s.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x for x in names for _ in range(n)]), pa.array(best_k.ravel()), pa.array(best_s.ravel())], names=[query_key, key, "score"])

    return vectors.select(F.col(key).cast("long"), vec).mapInArrow(run, T.StructType([T.StructField(query_key, query_type), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())]))


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks; a hit without one is dropped."""
    return chunks.join(F.broadcast(hits), "chunk_idx").orderBy(F.desc("score"), "chunk_idx")


def sparse_top_k(docs: DataFrame, query: Column | DataFrame, k: int, key: str) -> DataFrame:
    """The k best of sparse unit vectors (key, bucket, w) for one sparse query (bucket, q)."""
    scores = docs.join(F.broadcast(query), "bucket").groupBy(key).agg(F.round(F.sum(F.col("w") * F.col("q")), 6).alias("score"))
    return scores.orderBy(F.desc("score"), key).limit(_checked(k))


def hit_share(found: DataFrame, truth: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query_key, share): the share of the true hits that were found."""
    a = found.groupBy(query_key).agg(F.collect_set(key).alias("f"))
    b = truth.groupBy(query_key).agg(F.collect_set(key).alias("t"))
    return b.join(a, query_key, "left").select(query_key, (F.coalesce(F.size(F.array_intersect("f", "t")), F.lit(0)) / F.size("t")).alias("share"))
