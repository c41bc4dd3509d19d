import collections
import zlib

from pyspark.sql import functions as F

from tesserine.llm import queries, sharding
from tests.llm.conftest import ALL, SF, keys


def test_laws(spark, docs):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}
    rows = queries.op2_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_one_more_shard_takes_rows_only_into_itself(docs):
    at = lambda n: {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shuffled_shards(docs, n).select("doc_id", "shard", "grown_shard").collect()}
    few, more = at(7), at(8)
    assert all(more[k][0] == grown for k, (_, grown) in few.items())


def test_small_buckets_and_the_same_again(docs):
    read = lambda: sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffled_shards(docs, 3, bucket_bytes=20_000).collect())
    first = read()
    assert first == read()
    by = collections.defaultdict(list)
    for i, s, slot in first:
        by[s].append((slot, i))
    assert all([x for x, _ in sorted(v)] == list(range(len(v))) for v in by.values())
    assert all([i for _, i in sorted(v)] != sorted(i for _, i in v) for v in by.values())


def test_odd_rows(odd, none):
    out = sharding.shuffled_shards(odd, 4)
    assert keys(out.collect()) == ALL and sorted(out.columns) == sorted({*odd.columns, "grown_shard"})
    assert dict(out.dtypes)["shard"] == "int" and dict(out.dtypes)["slot"] == "bigint"
    assert {r["size"] for r in sharding.digest(out).filter("doc_id in (3, 4)").collect()} == {8}
    assert sharding.shuffled_shards(none, 4).collect() == []


def test_written_shards_hold_every_record(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()
    assert back.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).filter("not ok").isEmpty()


def test_no_python_in_the_plan(docs):
    plan = sharding.digest(sharding.shuffled_shards(docs, 24))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
