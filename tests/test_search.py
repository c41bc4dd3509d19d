import numpy as np
import pytest

from tesserine.operators import hnsw, search
from tesserine.schema import HnswConfig


def vectors(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, step=1):
    return spark.createDataFrame([(i * step, v.tolist()) for i, v in enumerate(x)], "chunk_idx long, vec array<float>")


def test_a_vector_finds_itself(spark):
    x = vectors(300, 64, 42)
    hit = search.top_k(frame(spark, x), x[17].tolist(), 1).first()
    assert hit["chunk_idx"] == 17 and abs(hit["score"] - 1) < 1e-4


def test_graph_finds_the_hits():
    x, q = vectors(2000, 64, 7), vectors(200, 64, 1234)
    g = hnsw.Graph.load(hnsw.Graph.build(np.arange(2000), x, HnswConfig(seed=99)).dump())
    best = (q @ x.T).argmax(1)
    assert np.mean([g.search(v, 5)[0][0] == b for v, b in zip(q, best)]) >= 0.95


def test_graph_of_none_and_wrong_lengths():
    empty = hnsw.Graph.build(np.empty(0, int), np.empty((0, 4)))
    assert empty.search(np.zeros(4), 3) == []
    g = hnsw.Graph.build(np.arange(5), vectors(5, 4, 1))
    with pytest.raises(ValueError):
        g.search(np.zeros(3), 1)
    assert g.search(vectors(1, 4, 2)[0], 0) == [] and len(g.search(vectors(1, 4, 2)[0], 9)) == 5


def test_sharded_search_agrees_with_the_exact_one(spark):
    x, q = vectors(1200, 32, 11), vectors(20, 32, 12)
    df = frame(spark, x, 2)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<float>")
    near = hnsw.search(hnsw.build(df, 3), queries, 5)
    true = search.batch_top_k(df, queries, 5, "chunk_idx", "query_id")
    assert search.hit_share(near, true, "query_id", "chunk_idx").agg({"share": "avg"}).first()[0] >= 0.94
    assert near.agg({"rank": "max"}).first()[0] == 5


def test_checked_graph_search_is_the_sql(spark, tmp_path):
    """Vectors without clusters, of which the beam misses some, and scores that differ beyond the sixth decimal only."""
    from tesserine.plans import catalog
    from tests.oracle import plain

    x = vectors(2500, 64, 4)
    for key in range(1, 30):  # about as close to the first vector, the closest last
        x[key] = x[0] + np.float32(1e-3) * x[key] * (1 + (30 - key) * np.float32(1e-4))
    x[:30] /= np.linalg.norm(x[:30], axis=1, keepdims=True)
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(path)
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    theirs = sorted(tuple(map(plain, r)) for r in con.sql(catalog.SQL["ann_topk"]).fetchall())
    assert sorted(tuple(r) for r in catalog.ann_topk(spark, str(tmp_path)).collect()) == theirs and len(theirs) == 250


def test_checked_graph_search_at_the_edges():
    x = vectors(7, 4, 2)
    g = hnsw.Graph.build(np.arange(7), x)
    assert [len(c) for c in g.search_whole(x[:2], 0, 6)] == [0, 0, 0]
    assert g.search_whole(x[:2], 20, 6)[0].tolist() == [0] * 7 + [1] * 7
    assert [len(c) for c in hnsw.Graph.build(np.empty(0, int), np.empty((0, 4))).search_whole(x, 3, 6)] == [0, 0, 0]
    copies = hnsw.Graph.build(np.arange(300), np.repeat(x[:1], 300, axis=0))
    assert copies.search_whole(x[:1], 5, 6)[1].tolist() == [0, 1, 2, 3, 4]


def test_batch_in_rounds_equals_one_round(spark, monkeypatch):
    x = vectors(200, 8, 3)
    df = frame(spark, x)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:7])], "query_id long, vec array<float>")
    key = lambda d: sorted((r["query_id"], r["rank"], r["chunk_idx"]) for r in d.collect())
    one = key(search.batch_top_k(df, queries, 3, "chunk_idx", "query_id"))
    monkeypatch.setattr(search, "QUERY_NUMBERS", 16)
    assert key(search.batch_top_k(df, queries, 3, "chunk_idx", "query_id")) == one and len(one) == 21


def test_ties_and_edges_of_k(spark):
    df = frame(spark, np.array([[1, 0], [1, 0], [0, 1]], np.float32))
    assert [r["chunk_idx"] for r in search.top_k(df, [1.0, 0.0], 2).collect()] == [0, 1]
    assert search.top_k(df, [1.0, 0.0], 0).collect() == []
    with pytest.raises(ValueError):
        search.top_k(df, [1.0, 0.0], -1)
    assert search.batch_top_k(df, df.limit(0).select("chunk_idx", "vec").withColumnRenamed("chunk_idx", "q"), 2, "chunk_idx", "q").collect() == []


@pytest.mark.parametrize("kind", ["FlatIndex", "GraphIndex"])
def test_index_adds_searches_saves_and_loads(spark, tmp_path, kind):
    from tesserine.operators import index

    cls = getattr(index, kind)
    x = vectors(100, 32, 3)
    rows = spark.createDataFrame([(f"v{i}", v.tolist(), 2 * i) for i, v in enumerate(x)], index.ENTRY)
    made = cls(spark).add(rows.filter("chunk_idx < 100")).add(rows.filter("chunk_idx >= 100"))
    hits = made.search(x[40].tolist(), 3).collect()
    assert len(made) == 100 and (hits[0]["id"], hits[0]["chunk_idx"]) == ("v40", 80) and abs(hits[0]["score"] - 1) < 1e-4 and len(hits) == 3
    made.save(str(tmp_path / "i"))
    back = cls.load(spark, str(tmp_path / "i"))
    assert [tuple(r) for r in back.search(x[40].tolist(), 3).collect()] == [tuple(r) for r in hits] and back.entries().count() == 100
    with pytest.raises(ValueError):
        back.add(spark.createDataFrame([("w", [1.0], 1)], index.ENTRY))
    with pytest.raises(ValueError):
        back.search([1.0], 1)
    assert cls(spark).search([1.0], 2).collect() == []
