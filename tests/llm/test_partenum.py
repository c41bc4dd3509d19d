import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tesserine.llm import partenum, queries
from tests.llm.conftest import ALL, SF, keys


def word_set(text, n=4):
    words = (text or "").encode().lower().split()
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(rows):
    """n_shingles and component of each document, from all pairs."""
    sets = [(i, word_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for i, s in sets:
        for x in s:
            by[x].append((i, s))
    for i, s in sets:
        near = collections.Counter(j for x in s for j, _ in by[x])
        size = {j: len(o) for x in s for j, o in by[x]}
        for j, both in near.items():
            if j != i and 100 * both >= 85 * (len(s) + size[j] - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(s), root(i)) for i, s in sets)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.near_groups(df).collect())


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


def test_query_over_the_table(spark, docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op5_jaccard_join(spark, SF).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_near_copies_around_the_threshold(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for base in range(4):
        words = [f"w{base}x{rng.randrange(200)}" for _ in range(150)]
        rows += [" ".join(edited(rng, words, rng.randrange(9))) for _ in range(40)]
    rows += [" ".join(f"s{rng.randrange(6)}" for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(partenum, "HOT", 3)
    monkeypatch.setattr(partenum, "HELD", 4000)
    monkeypatch.setattr(partenum, "ITEMS", 700)
    monkeypatch.setattr(partenum, "PAIRS", 50)
    monkeypatch.setattr(partenum, "FEW", 2)
    assert run(spark, rows) == want
    monkeypatch.setattr(partenum, "WEIGHTS", 64)  # so crowded that every cell weighs something
    assert run(spark, rows) == want


def test_one_document_beside_a_hot_chunk(spark, monkeypatch):
    monkeypatch.setattr(partenum, "HOT", 8)
    words = [f"w{i}" for i in range(151)]
    put = lambda *at: " ".join(f"new{at[0]}" if i in at else w for i, w in enumerate(words))
    spots = [i for i in range(151) if all(abs(i - x) > 4 for x in (20, 70, 120))]
    chunk = [(k, put(spots[k])) for k in range(90)] + [(90, " ".join(words))]
    alone = [(91, put(20, 70, 120))]  # 0.85 with 90 and less with all others
    want = brute(chunk + alone)
    assert {c for _, _, c in want} == {0} and {c for i, _, c in brute(chunk[:-1] + alone) if i == 91} == {91}
    parts = [spark.createDataFrame(x, "doc_id long, text string").coalesce(1) for x in (chunk, alone)]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.near_groups(parts[0].unionByName(parts[1])).collect()) == want


def test_chains_across_components(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = [" ".join(words)]
    for _ in range(25):  # each close to the one before, the ends far apart
        words = edited(rng, words, 3)
        rows.append(" ".join(words))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("num", [80, 85])
@pytest.mark.parametrize("size", [6, 7, 13, 20, 47, 160, 700, 2500])
def test_similar_sets_share_a_signature(size, num):
    rng = np.random.default_rng(size)
    scheme = partenum.Scheme(num)
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        most = (100 - num) * 2 * len(a) // (100 + num) + 2
        lost, won = rng.integers(0, most), rng.integers(0, most)
        b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 2**63, won).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        x, y = (np.frombuffer(partenum.sketch(v), np.uint8).astype(np.int32) for v in (a, b))
        assert partenum.apart(x, y) <= len(a) + len(b) - 2 * both
        if len(b) and 100 * both >= num * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            sigs, ids = scheme.signatures([a, b], np.array([0, 1]))
            assert set(sigs[ids == 0].tolist()) & set(sigs[ids == 1].tolist())


@pytest.mark.parametrize("size", [20, 60, 200, 700, 3000])
def test_unrelated_sets_share_no_signature(size):
    """Nothing in common is no signature, in large sets either, many of whose parts are weak by chance."""
    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(300)]
    sigs, ids = partenum.Scheme(80).signatures(sets, np.arange(300))
    assert len(np.unique(sigs)) == len(sigs) and set(ids.tolist()) == set(range(300))


@pytest.mark.parametrize("levels", [1, 2, 4])
@pytest.mark.parametrize("size", [14, 60, 160, 700])
def test_sets_dealt_anew_share_a_signature(size, levels, monkeypatch):
    """With one spare part and thin signatures of two items nearly every large set is dealt anew, and some to the last."""
    monkeypatch.setattr(partenum, "LEVELS", levels)
    rng = np.random.default_rng(size)
    scheme = partenum.Scheme(80)
    scheme.band(np.array([10**5]))
    for tag in range(1, len(scheme.low)):
        n1, spare, _ = scheme.parts(tag)
        scheme.shapes[tag] = (n1 - spare + 1, 1, 2) if n1 else (0, 0, 1)
    near = 0
    for _ in range(150):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        lost, won = rng.multinomial(len(a) // 5, [0.5, 0.5])
        b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 2**63, won).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            near += 1
            sigs, ids = scheme.signatures([a, b], np.array([0, 1]))
            assert set(sigs[ids == 0].tolist()) & set(sigs[ids == 1].tolist())
    assert near > 100


def rows_made(spark, since):
    """(operator with its arguments, rows made) of the operators of SQL executions after the first `since`."""
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    for k in range(since, store.executionsCount()):
        execution = store.executionsList().apply(k).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    out.append((node.desc(), int(values.apply(metric.accumulatorId()).replace(",", ""))))
    return out


def test_many_documents_of_a_signature_are_not_multiplied(spark, monkeypatch):
    """Sets that share signatures and are not similar: no row for each item, none for each pair and signature."""
    rng = random.Random(10)
    phrase = [f"p{i}" for i in range(60)]
    rows = list(enumerate(" ".join([*phrase, *(f"d{k}x{i}" for i in range(rng.randrange(9, 16)))]) for k in range(50)))
    monkeypatch.setattr(partenum, "FEW", 2)
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert run(spark, rows) == brute(rows)
    made = rows_made(spark, since)
    assert not [x for x in made if "explode(items" in x[0] or "inline(head" in x[0]]
    joined = [n for desc, n in made if "Join [a#" in desc]
    assert joined and 0 < max(joined) <= len(rows) * (len(rows) - 1) // 2


@pytest.mark.parametrize("seed", range(4))
def test_heads_meet_as_by_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(partenum, "PAIRS", rng.choice([1, 7, 1 << 19]))
    monkeypatch.setattr(partenum, "HELD", rng.choice([3, 50, 300_000]))
    docs = []
    for k in range(60):
        n = rng.randrange(1, 40)
        docs.append((k * 5 - 40, n, rng.randrange(4), [(x, r + 1) for r, x in enumerate(rng.sample([i * 2**60 for i in range(-8, 8)], min(n, 6)))]))
    want = set()
    for a, b in itertools.combinations(docs, 2):
        for (x, r), (y, q) in itertools.product(a[3], b[3]):
            most = 1 + min(a[1] - r, b[1] - q)
            if x == y and a[2] != b[2] and 100 * most >= 80 * (a[1] + b[1] - most):
                want.add((a[0], b[0]))
    heads = pa.array([[{"item": x, "rank": r} for x, r in d[3]] for d in docs], pa.list_(pa.struct([("item", pa.int64()), ("rank", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([*(pa.array([d[k] for d in docs], pa.int64()) for k in range(3)), heads], names=["id", "n", "part", "head"])
    dealt = partenum._heads_blocks(5)(iter([batch.slice(0, 20), batch.slice(20)]))
    blocks = pa.Table.from_batches(dealt).sort_by("bucket").combine_chunks().to_batches()
    met = [(r["a"], r["b"]) for x in partenum._meet(80, 100)(iter(blocks)) for r in x.to_pylist()]
    assert want and set(met) == want


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_weights_of_cells(spark, size, monkeypatch):
    rng = random.Random(size)
    monkeypatch.setattr(partenum, "WEIGHTS", size)
    monkeypatch.setattr(partenum, "ITEMS", 70)
    sets = [[rng.randrange(-(2**63), 2**63) for _ in range(30)] + [5, size - 1] for _ in range(20)]
    table = partenum._weights(spark.createDataFrame(list(enumerate(sets)), "id long, items array<long>").repartition(3))
    count = collections.Counter(x & (size - 1) for x in itertools.chain(*sets))
    assert {k: int(table[k]) for k in np.flatnonzero(table).tolist()} == {k: int(8 * np.log2(n)) for k, n in count.items() if n > 1}


def test_pack():
    x = np.array([0, 1, -1, 2**62, 255, 256])
    assert partenum.unpack(partenum.pack(x), len(x)).tolist() == x.tolist()


def test_odd_rows(odd, none):
    rows = partenum.near_groups(odd).collect()
    assert keys(rows) == ALL and {len(r) for r in rows} == {3}
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by[3] == (0, 3) and by[4] == (0, 4) and by[5] == (0, 5) and by[9] == (1, 9) and by[1][1] == by[2][1] == 1
    assert sorted(r["n_shingles"] for r in rows if r["doc_id"] is None) == [0, by[1][0]]
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert partenum.near_groups(none).collect() == []


def test_word_hashes_by_spans_and_bytes(monkeypatch):
    powers = partenum.Powers()
    text = "One TWO\tthree\x0bone  été two. ab ba a b\n" * 7
    words = text.encode().lower().split()
    h = partenum.word_hashes(text.lower().encode(), powers)
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words)) and all(len({x for w, x in zip(words, h.tolist()) if w == v}) == 1 for v in words)
    whole = partenum.shingles(text, powers)
    assert len(whole) == len(word_set(text))
    monkeypatch.setattr(partenum, "SPAN", 5)
    assert (partenum.shingles(text, partenum.Powers()) == whole).all()
