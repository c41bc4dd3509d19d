"""Discovery of new files by Structured Streaming. The stream only says that something is there; the manifest decides what to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserine.plans.engine import Engine
from tesserine.sources.files import clean, plain_path


def watch(engine: Engine, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index files of a folder as they come: what is there now if once, else on until stopped. A batch that is run again finds its files
    unchanged. Files changed in place or deleted are for Engine.refresh."""
    spark = engine.spark
    found = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(clean(folder))

    def batch(rows: DataFrame, _: int) -> None:
        listing = rows.select(plain_path(F.col("path")).alias("path"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), "length")
        from tesserine.sources.files import pruned, wanted_extension

        engine._index([folder], listing.filter(wanted_extension(F.col("path"), engine.extensions) & ~pruned(F.col("path"), clean(folder))))

    out = found.select("path", "modificationTime", "length").writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (out.trigger(availableNow=True) if once else out).start()
