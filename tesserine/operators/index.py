"""Indexes as tables: rows (id, vec, chunk_idx) that can be added to, searched, listed, saved and loaded. Each change makes a new index."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.operators import hnsw, search
from tesserine.schema import HnswConfig

ENTRY = T.StructType([T.StructField("id", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("chunk_idx", T.LongType())])


class Index(Protocol):
    def add(self, entries: DataFrame) -> Index: ...

    def search(self, query: Sequence[float], k: int) -> DataFrame: ...

    def entries(self) -> DataFrame: ...

    def save(self, path: str) -> None: ...

    def __len__(self) -> int: ...


class FlatIndex:
    """Exact search. The first vectors settle the length; others are refused."""

    def __init__(self, spark: SparkSession, entries: DataFrame | None = None, dims: int = 0):
        self.spark, self.dims = spark, dims
        self._entries = entries if entries is not None else spark.createDataFrame([], ENTRY)

    def add(self, entries: DataFrame) -> FlatIndex:
        entries = entries.select(ENTRY.names)
        sizes = [r["d"] for r in entries.select(F.size("vec").alias("d")).distinct().limit(2).collect()]
        if sizes and (len(sizes) > 1 or sizes[0] != (self.dims or sizes[0])):
            raise ValueError(f"vectors of {sizes} numbers in an index of {self.dims}")
        return type(self)(self.spark, self._entries.unionByName(entries), self.dims or (sizes[0] if sizes else 0))

    def _checked(self, query: Sequence[float]) -> Sequence[float]:
        if self.dims and len(query) != self.dims:
            raise ValueError(f"query of {len(query)} numbers in an index of {self.dims}")
        return query

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """(id, score, chunk_idx), best first, ties by chunk_idx."""
        hits = search.top_k(self._entries, self._checked(query), k)
        return self._entries.select("id", "chunk_idx").join(F.broadcast(hits), "chunk_idx").select("id", "score", "chunk_idx").orderBy(F.desc("score"), "chunk_idx")

    def entries(self) -> DataFrame:
        return self._entries.select(ENTRY.names)

    def __len__(self) -> int:
        return self._entries.count()

    def save(self, path: str) -> None:
        self.entries().write.parquet(f"{path}/entries")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FlatIndex:
        entries = spark.read.schema(ENTRY).parquet(f"{path}/entries")
        first = entries.select(F.size("vec").alias("d")).first()
        return cls(spark, entries, first["d"] if first else 0)


class GraphIndex(FlatIndex):
    """Approximate search through graphs, built when the index is saved or first searched."""

    def __init__(self, spark: SparkSession, entries: DataFrame | None = None, dims: int = 0, config: HnswConfig | None = None, graphs: DataFrame | None = None):
        super().__init__(spark, entries, dims)
        self.config, self._graphs = config or HnswConfig(), graphs

    def graphs(self) -> DataFrame:
        if self._graphs is None:
            self._graphs = hnsw.build(self._entries, max(1, -(-len(self) // hnsw.SHARD)), self.config).persist()
        return self._graphs

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        q = self.spark.createDataFrame([(0, [float(x) for x in self._checked(query)])], "query_id long, vec array<float>")
        hits = hnsw.search(self.graphs(), q, k).select("chunk_idx", F.col("score").cast("float").alias("score"))
        return self._entries.select("id", "chunk_idx").join(F.broadcast(hits), "chunk_idx").select("id", "score", "chunk_idx").orderBy(F.desc("score"), "chunk_idx")

    def save(self, path: str) -> None:
        super().save(path)
        self.graphs().write.parquet(f"{path}/graphs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphIndex:
        flat = FlatIndex.load(spark, path)
        return cls(spark, flat.entries(), flat.dims, graphs=spark.read.schema(hnsw.GRAPHS).parquet(f"{path}/graphs"))
