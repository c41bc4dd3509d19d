import numpy as np
import pytest

from tesserine.llm import embeddup


def brute(ids, vectors, cosine):
    ok = [i for i, v in enumerate(vectors) if ids[i] is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = [0] * len(ids), {i: i for i in range(len(ids))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            if a != b and len(vectors[a]) == len(vectors[b]):
                x, y = (np.array(vectors[i], float) for i in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a] += 1
                    parent[root(a)] = root(b)
    low = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return sorted(((ids[i], links[i], low[root(i)] if ids[i] is not None else None) for i in range(len(ids))), key=str)


def run(spark, ids, vectors):
    df = spark.createDataFrame([(i, v, "a", 2) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, id string, w long")
    out = embeddup.near_vectors(df)
    rows = out.collect()
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    near = [b + rng.normal(size=16) * 0.18 for b in base[:12] for _ in range(12)]
    return np.float32(np.vstack([base, near])).astype(float)


def test_links_and_components(spark, clustered):
    vectors = [v.tolist() for v in clustered]
    ids = [3 * i + 1 for i in range(len(vectors))]
    want, got = brute(ids, vectors, 0.95), run(spark, ids, vectors)
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert there > 300 and found >= 0.9 * there
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_hot_group_is_cut_into_blocks(spark, clustered, monkeypatch):
    monkeypatch.setattr(embeddup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    hot = [(clustered[0] + rng.normal(size=16) * 0.02).astype(np.float32).astype(float).tolist() for _ in range(150)]
    vectors = hot + [v.tolist() for v in clustered[20:60]]
    ids = list(range(len(vectors)))
    assert run(spark, ids, vectors) == brute(ids, vectors, 0.95)


@pytest.mark.parametrize("kind", ["gaussian", "clustered"])
def test_share_of_links_found_on_a_grid_of_many_cells(spark, monkeypatch, kind):
    """Pairs planted right at the threshold, found by cells: at least 0.9 of what brute force finds."""
    monkeypatch.setattr(embeddup, "PER_CELL", 8)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(2400, 32)) if kind == "gaussian" else (rng.normal(size=(60, 32))[rng.integers(0, 60, 2400)] + 0.5 * rng.normal(size=(2400, 32)))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=(600, 32))
    away -= (away * base[:600]).sum(1, keepdims=True) * base[:600]
    cos = rng.uniform(0.95, 0.965, size=(600, 1))
    near = cos * base[:600] + np.sqrt(1 - cos**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    x = np.float32(np.vstack([base, near])).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    index = embeddup.fit(u, len(u), 0.95)
    visits = index.visits(u[:500])
    assert len(index.words[0]) * len(index.words[1]) > 300 and np.mean([len(v) for v in visits]) < 120  # of all cells, few are visited
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embeddup.near_vectors(df).collect()}
    want = links.sum(1)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.97 * want.sum() > 1000


def test_many_lengths_and_extreme_numbers(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=d).tolist() for d in range(1, 40) for _ in range(2)]
    vectors += [[1e-40, 0.0, 1e-40], [2e-40, 0.0, 2e-40], [3e38, 3e38, 0.0], [1e38, 1e38, 0.0]]
    vectors = [np.float32(v).astype(float).tolist() for v in vectors]
    links = {r["vec_id"]: r["n_links"] for r in embeddup.near_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")).collect()}
    n = len(vectors)
    assert [links[n - k] for k in (4, 3, 2, 1)] == [1, 1, 1, 1]
    assert run(spark, list(range(n - 4)), vectors[:-4]) == brute(list(range(n - 4)), vectors[:-4], 0.95)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [], [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [1.0, 0.0], [3.0], [-1.0, 0.0]]
    ids = [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, None, 16, 17]
    assert run(spark, ids, vectors) == brute(ids, vectors, 0.95)


def test_empty_table_and_one_vector(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddup.near_vectors(empty).collect() == []
    assert run(spark, [4], [[0.5, 0.5]]) == [(4, 0, 4)]


def test_repeated_keys_are_vectors_of_their_own(spark):
    assert run(spark, [1, 1, 2], [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_multi_sequence_visits_in_order():
    a, b = [0.0, 1.0, 4.0], [0.0, 2.0, 3.0]
    cells = embeddup.multi_sequence(a, b, [0, 1, 2], [0, 1, 2], 3, 100.0)
    sums = [a[c // 3] + b[c % 3] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == list(range(9))
    assert embeddup.multi_sequence(a, b, [0, 1, 2], [0, 1, 2], 3, 2.0) == [0, 3, 1]
