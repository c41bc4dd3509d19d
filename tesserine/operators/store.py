"""Chunks, vectors and manifest as Parquet tables in immutable segments.

A segment is a folder with chunks/, vectors/ and, for the graph index, graphs/. Indexing adds a segment; removing rewrites only the
segments that hold what goes; many small segments are merged into one. A version is a list of segments and a manifest. It becomes
current when the pointer file is replaced, in one step. Readers keep what they opened; no path being read is ever
overwritten. One writer at a time: a lock file guards a change.
"""

from __future__ import annotations

import json
import os
import shutil
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine import schema
from tesserine.operators import hnsw, search
from tesserine.schema import HnswConfig
from tesserine.sources.files import clean, under

KEY = T.StructField("chunk_idx", T.LongType(), False)
CHUNKS = T.StructType([KEY, *schema.CHUNK.fields])
MARKS = T.StructType([*schema.MANIFEST.fields, T.StructField("segment", T.StringType())])
#: Segments beyond which all are merged.
MOST_SEGMENTS = 32


@dataclass(frozen=True)
class Snapshot:
    """One version's tables. chunk_idx is a surrogate key: it never changes and is not used again."""

    chunks: DataFrame
    vectors: DataFrame
    manifest: DataFrame
    graphs: DataFrame | None
    index_type: str
    dims: int
    next_idx: int
    segments: tuple[str, ...] = ()


class Store:
    def __init__(self, spark: SparkSession, path: str, index_type: str = "hnsw", hnsw_config: HnswConfig | None = None):
        if index_type not in ("flat", "hnsw"):
            raise ValueError(f"index type {index_type!r}; there are flat and hnsw")
        self.spark, self.path, self.index_type, self.config = spark, clean(path), index_type, hnsw_config or HnswConfig()
        self._lock, self._depth = threading.RLock(), 0

    def _pointer(self) -> str:
        return os.path.join(self.path, "CURRENT")

    def _current(self) -> dict:
        try:
            with open(self._pointer(), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"segments": [], "manifest": None, "index_type": self.index_type, "dims": 0, "next_idx": 0}

    def _read(self, kind: T.StructType, *parts: str) -> DataFrame:
        return self.spark.read.schema(kind).parquet(*(os.path.join(self.path, p) for p in parts)) if parts else self.spark.createDataFrame([], kind)

    def snapshot(self) -> Snapshot:
        """The current version; an empty one where nothing was saved."""
        now = self._current()
        names = now["segments"]
        tables = [self._read(kind, *(f"{n}/{part}" for n in names)) for part, kind in (("chunks", CHUNKS), ("vectors", schema.VECTOR))]
        graphs = self._read(hnsw.GRAPHS, *(f"{n}/graphs" for n in names)) if now["index_type"] == "hnsw" and names else None
        manifest = self._read(MARKS, now["manifest"]) if now["manifest"] else self._read(MARKS)
        return Snapshot(*tables, manifest, graphs, now["index_type"], now["dims"], now["next_idx"], tuple(names))

    @contextmanager
    def writing(self) -> Iterator[None]:
        """Hold the lock, against other threads and processes; within it again it is free."""
        import fcntl

        os.makedirs(self.path, exist_ok=True)
        with self._lock, open(os.path.join(self.path, "LOCK"), "w") as f:
            if not self._depth:
                fcntl.flock(f, fcntl.LOCK_EX)
            self._depth += 1
            try:
                yield
            finally:
                self._depth -= 1

    def _segment(self, rows: DataFrame) -> tuple[str, int]:
        """Write a segment of rows (chunk_idx, chunk columns, vec), and its graphs: its name, and how many rows. Every chunk has a vector of one length."""
        name = f"s-{uuid.uuid4().hex}"
        at = os.path.join(self.path, name)
        try:
            rows.select(CHUNKS.names).write.parquet(os.path.join(at, "chunks"))
            rows.select("chunk_idx", "vec").write.parquet(os.path.join(at, "vectors"))
            saved = self._read(schema.VECTOR, f"{name}/vectors")
            n = saved.count()
            if self.index_type == "hnsw":
                graphs = hnsw.build(saved, max(1, -(-n // hnsw.SHARD)), self.config) if n else self._read(hnsw.GRAPHS)
                graphs.write.parquet(os.path.join(at, "graphs"))
        except BaseException:
            shutil.rmtree(at, ignore_errors=True)
            raise
        return name, n

    def _rows(self, *segments: str) -> DataFrame:
        return self._read(CHUNKS, *(f"{n}/chunks" for n in segments)).join(self._read(schema.VECTOR, *(f"{n}/vectors" for n in segments)), "chunk_idx")

    def _commit(self, segments: Sequence[str], manifest: DataFrame, next_idx: int, dims: int) -> Snapshot:
        """Make segments and a manifest the current version. What neither it nor the version before needs goes."""
        was = self._current()
        name = f"m-{uuid.uuid4().hex}"
        manifest.select(MARKS.names).write.parquet(os.path.join(self.path, name))
        now = {"segments": list(segments), "manifest": name, "index_type": self.index_type, "dims": dims if segments else 0, "next_idx": next_idx, "before": [*was["segments"], was["manifest"]]}
        temporary = f"{self._pointer()}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(now, f)
        os.replace(temporary, self._pointer())
        keep = {*segments, name, *now["before"]}
        for found in os.listdir(self.path):
            if found.startswith(("s-", "m-")) and found not in keep:
                shutil.rmtree(os.path.join(self.path, found), ignore_errors=True)
        return self.snapshot()

    def _without(self, now: Snapshot, paths: DataFrame) -> tuple[list[str], DataFrame]:
        """Segments and manifest when some paths go: only segments that hold one of them are written again."""
        paths = paths.select("path").distinct()
        hit = {r["segment"] for r in now.manifest.join(paths, "path", "left_semi").select("segment").distinct().collect()}
        gone, moved = paths.select(F.col("path").alias("source")), {}
        for old in now.segments:
            if old in hit:
                name, n = self._segment(self._rows(old).join(gone, "source", "left_anti"))
                moved[old] = name if n else None
        left = now.manifest.join(paths, "path", "left_anti")
        for old, name in moved.items():
            left = left.withColumn("segment", F.when(F.col("segment") == old, F.lit(name)).otherwise(F.col("segment")))
        return [n for n in (moved.get(x, x) for x in now.segments) if n], left

    def add(self, chunks: DataFrame, marked: DataFrame, replaced: DataFrame | None = None) -> Snapshot:
        """A version with more chunks (with `vec`) and files marked as indexed; what was there of replaced paths goes first."""
        with self.writing():
            now = self.snapshot()
            # Keys follow (source, page, ord) and are unique without any task seeing all rows.
            ordered = chunks.repartitionByRange("source").sortWithinPartitions("source", "page_num", "ord")
            fresh = ordered.withColumn("chunk_idx", F.monotonically_increasing_id() + F.lit(now.next_idx))
            at = os.path.join(self.path, f"new-{uuid.uuid4().hex}")
            try:
                fresh.write.parquet(at)
                fresh = self.spark.read.parquet(at)
                stats = fresh.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"), F.max("chunk_idx").alias("last")).first()
                dims = now.dims or stats["high"] or 0
                if stats["n"] and not stats["low"] == stats["high"] == dims:
                    raise ValueError(f"vectors of {stats['low']} to {stats['high']} numbers in a store of {dims}")
                segments, manifest = self._without(now, replaced) if replaced is not None and now.segments else (list(now.segments), now.manifest)
                name = self._segment(fresh)[0] if stats["n"] else None
                marks = marked.select("path", "modified_ns").dropDuplicates(["path"])
                manifest = manifest.join(marks.select("path"), "path", "left_anti").unionByName(marks.withColumn("segment", F.lit(name).cast("string")))
                segments += [name] if name else []
                if len(segments) > MOST_SEGMENTS:
                    whole, _ = self._segment(self._rows(*segments))
                    segments, manifest = [whole], manifest.withColumn("segment", F.when(F.col("segment").isNotNull(), F.lit(whole)))
                return self._commit(segments, manifest, stats["last"] + 1 if stats["n"] else now.next_idx, dims)
            finally:
                shutil.rmtree(at, ignore_errors=True)

    def _remove(self, wanted: Column) -> tuple[list[str], int]:
        """Drop the files that fulfil a condition on `path`: their names, and how many chunks went."""
        with self.writing():
            now = self.snapshot()
            known = now.manifest.select("path")
            files = [r["path"] for r in known.filter(wanted).orderBy("path").collect()]
            if not files:
                return [], 0
            gone = self.spark.createDataFrame([(f,) for f in files], "path string")
            lost = now.chunks.join(gone.select(F.col("path").alias("source")), "source", "left_semi").count()
            self._commit(*self._without(now, gone), now.next_idx, now.dims)
            return files, lost

    def remove(self, target: str) -> tuple[list[str], int]:
        """A file, or all in a folder; /x/a does not mean /x/ab."""
        return self._remove(under(F.col("path"), clean(target)))

    def remove_files(self, paths: Sequence[str]) -> tuple[list[str], int]:
        return self._remove(F.col("path").isin(*map(clean, paths))) if paths else ([], 0)

    def clear(self) -> None:
        with self.writing():
            self._commit([], self._read(MARKS), self.snapshot().next_idx, 0)

    def files(self) -> DataFrame:
        """(path, modified_ns, chunks) by path; files without a chunk count 0."""
        now = self.snapshot()
        counts = now.chunks.groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("chunks"))
        return now.manifest.join(counts, "path", "left").select("path", "modified_ns", F.coalesce("chunks", F.lit(0)).alias("chunks")).orderBy("path")

    def status(self) -> dict:
        now = self.snapshot()
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(self.path) for f in names)
        return {"files": now.manifest.count(), "chunks": now.chunks.count(), "index_type": now.index_type, "dims": now.dims, "bytes": size}

    def search(self, query: Sequence[float], k: int = 5) -> DataFrame:
        """Chunks with scores, best first. Empty where the store is."""
        now = self.snapshot()
        if now.dims and len(query) != now.dims:
            raise ValueError(f"query of {len(query)} numbers in a store of {now.dims}")
        if now.graphs is None or not k:
            hits = search.top_k(now.vectors, query, k)
        else:
            q = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, vec array<float>")
            hits = hnsw.search(now.graphs, q, k).select("chunk_idx", F.col("score").cast("float").alias("score"))
        return search.with_chunks(hits, now.chunks)
