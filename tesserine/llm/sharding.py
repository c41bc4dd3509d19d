"""Sharding by a two-pass external shuffle.

Pass one scatters the records, by seeded hashes, over buckets small enough for memory. Pass two puts each bucket in a
fixed order and shuffles it; Spark's shuffle() draws a Fisher-Yates permutation from a seed. A shard is a run of
buckets, so slots are gapless: a bucket's records follow those of the buckets before it.

Law `key`: shard s is the one whose hash of (key, s) is largest. A further shard can only win records for itself, and
nothing but the key and the number of shards decides. Copies of one text fall apart over all shards, as do the records
of one source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import free_name, text_of

#: Text that one bucket holds on average; text that one task holds, of several buckets, where there are more tasks than the session asks for.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 64 << 20


def shard_of(key: str, shards: int, seed: int) -> Column:
    """The shard 0 to shards-1 with the largest hash of the key. A null key is a key like any other."""
    best = F.array_max(F.array(*[F.struct(F.xxhash64(F.col(key), F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))
    return best["s"]


def record_size(text: str) -> Column:
    return F.octet_length(text_of(text)).cast("long") + 8


def shuffled_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every record with `shard`, `slot` (gapless from 0 in each shard) and `grown_shard` (with one shard more).

    Repeated records all stay, each with a slot of its own; null texts count 8 bytes; an empty
    table gives no rows. Columns of df called shard, slot or grown_shard are replaced. The permutation depends on the seed,
    the keys, the texts and the number of buckets; records of equal key and text stand in any order among themselves.
    The bucket depends on key and text, so that the records of one key, or without a key, are spread over their shard's buckets.
    The number of buckets grows with the table; their sizes meet them in a join that is a broadcast only if Spark finds them small.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    df = df.drop("shard", "slot", "grown_shard")
    total = df.agg(F.sum(record_size(text)).alias("n")).first()["n"] or 0
    each = max(1, math.ceil(total / (shards * bucket_bytes)))
    tasks = min(shards * each, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES), shards))
    bucket, many, at = (free_name(df, x) for x in ("bucket", "many", "at"))
    where = [shard_of(key, shards, seed).alias("shard"), F.pmod(F.xxhash64(F.col(key), text_of(text), F.lit(seed), F.lit("bucket")), F.lit(each)).cast("int").alias(bucket)]

    sizes = df.select(*where).groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(many))
    before = F.coalesce(F.sum(many).over(Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("shard", bucket, before.alias(at))

    scattered = df.select("*", *where).repartition(tasks, "shard", bucket).sortWithinPartitions("shard", bucket, key, F.xxhash64(text_of(text)))
    own = scattered.groupBy("shard", bucket).agg(F.collect_list(F.struct(*[F.col(c) for c in df.columns])).alias(many))
    own = own.join(begins, ["shard", bucket])
    pos, rec = free_name(df, "pos"), free_name(df, "rec")
    rows = own.select("shard", at, F.posexplode(F.shuffle(many, seed)).alias(pos, rec))
    out = rows.select(*[F.col(rec)[c].alias(c) for c in df.columns], "shard", (F.col(at) + F.col(pos)).cast("long").alias("slot"))
    more = F.xxhash64(F.col(key), F.lit(seed), F.lit(shards))
    stays = F.xxhash64(F.col(key), F.lit(seed), F.col("shard"))
    return out.withColumn("grown_shard", F.when(more >= stays, F.lit(shards)).otherwise(F.col("shard")))


def write_shards(df: DataFrame, path: str, shards: int, **options) -> None:
    """One folder for each shard, one file for each of its buckets, records in slot order."""
    shuffled_shards(df, shards, **options).write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, CRC-32 of the text and place of each record."""
    return sharded.select(
        key, record_size(text).alias("size"), F.crc32(text_of(text).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", "grown_shard",
    )
