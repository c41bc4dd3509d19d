"""Row types of the retrieval engine and its settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: File types by extension, and folders that a scan passes over.
MARKDOWN = (".md", ".markdown", ".mdown")
CODE = (".go", ".py", ".js", ".ts", ".rs", ".cpp", ".c", ".h", ".java", ".rb", ".sh")
TEXT = (".txt", ".text", ".log", ".rst", "")
SKIPPED_FOLDERS = (".git", "node_modules", ".svn", ".hg", "vendor", "third_party", "__pycache__", ".venv", "dist", "build")

LISTING = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("modified_ns", T.LongType(), False), T.StructField("length", T.LongType())])
DOCUMENT = T.StructType([
    T.StructField("path", T.StringType(), False), T.StructField("format", T.StringType(), False), T.StructField("content", T.StringType()),
    T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("modified_ns", T.LongType()),
])
CHUNK = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("source", T.StringType(), False), T.StructField("page_num", T.IntegerType(), False), T.StructField("ord", T.IntegerType(), False),
    T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False), T.StructField("text", T.StringType(), False),
])
VECTOR = T.StructType([T.StructField("chunk_idx", T.LongType(), False), T.StructField("vec", T.ArrayType(T.FloatType(), False), False)])
MANIFEST = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("modified_ns", T.LongType(), False)])


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in bytes. What is out of range takes a default, as does an overlap of 0."""

    chunk_size: int = 512
    overlap: int = 64
    min_chunk_size: int = 50

    def __post_init__(self) -> None:
        size = self.chunk_size if self.chunk_size > 0 else 512
        lap = self.overlap if self.overlap > 0 else 64
        object.__setattr__(self, "chunk_size", size)
        object.__setattr__(self, "overlap", lap if lap < size else size // 4)
        object.__setattr__(self, "min_chunk_size", self.min_chunk_size if self.min_chunk_size > 0 else 50)


@dataclass(frozen=True)
class GenOptions:
    n_predict: int = 512
    temp: float = 0.1
    repeat_penalty: float = 1.1


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 100
    seed: int = 1
