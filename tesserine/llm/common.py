"""Helpers the operators share: scratch tables, Arrow limits, column names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that one Arrow batch holds at most, so that a Python worker's memory is bounded.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small; a smaller value that is set already stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and there is one machine
    only, as in tests. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tesserine-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle() -> None:
    """Give back the memory that a Python worker no longer needs; workers stay for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Scratch:
    """Written tables that cut lineage. Each survives the loss of any executor; drop() removes one that no plan needs any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tesserine/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.live: set[str] = set()

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.root}/{self.count}"
        kept = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = self.spark.conf.get(kept)
        self.spark.conf.set(kept, "true")  # what is written needs its shuffle files no more
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(kept, was)
        self.live.add(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        self.live.discard(path)
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def release(self, df: DataFrame) -> DataFrame:
        """df, when all tables that it does not read are gone."""
        used = {f.rpartition("/")[0].rpartition("/tesserine/")[2] for f in df.inputFiles()}
        for path in [p for p in self.live if p.rpartition("/tesserine/")[2] not in used]:
            self.drop(path)
        return df

    def close(self) -> None:
        self.drop(self.root)


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df does not have, compared as Spark compares names."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want = "_" + want
    return want


def text_of(name: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def struct_type(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])
