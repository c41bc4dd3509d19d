import collections

import pytest
from pyspark.sql import functions as F

from tesserine.llm import mixing, queries
from tests.llm.conftest import ALL, SF


def fill(budget, kids):
    """Shares of siblings, by giving out and taking back until nobody is over."""
    out, live = {}, dict(kids)
    while live:
        weight = sum(w for _, w in live.values())
        full = [k for k, (cap, w) in live.items() if not weight or not w or cap <= budget * w / weight + 1e-9]
        if not full:
            return out | {k: budget * w / weight for k, (_, w) in live.items()}
        out |= {k: live[k][0] if live[k][1] else 0 for k in full}
        budget -= sum(out[k] for k in full)
        live = {k: v for k, v in live.items() if k not in full}
    return out


def spread(supply, weights, total, epochs):
    cap = lambda p: epochs * sum(v for k, v in supply.items() if k[: len(p)] == p)

    def below(p, budget):
        if len(p) == len(weights):
            return {p: budget}
        own, out = weights[len(p)] or {}, {}
        kids = {k[: len(p) + 1] for k in supply if k[: len(p)] == p}
        for k, x in fill(budget, {k: (cap(k), own.get(k[-1], own.get(None, 1.0))) for k in kids}).items():
            out |= below(k, x)
        return out

    return below((), min(total, cap(())))


SUPPLY = {("web", "en", "a"): 1000, ("web", "en", "b"): 10, ("web", "de", "c"): 50, ("book", "en", "d"): 200, ("book", "fr", "e"): 5, ("book", None, "f"): 70}


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.8, 1), (0.9, 2), (2.5, 2), (1.0, 1)])
def test_budgets_equal_the_recursion(spark, share, epochs):
    weights = [{"web": 3.0, "book": 1.0}, {"en": 5.0, "de": 2.0, None: 1.0}, {"b": 4.0, "f": 0.5}]
    leaves = spark.createDataFrame([(*k, v) for k, v in SUPPLY.items()], "domain string, lang string, source string, supply long")
    total = int(share * sum(SUPPLY.values()))
    got = mixing.budgets(leaves, ["domain", "lang", "source"], weights, F.lit(float(total)), epochs)
    want = spread(SUPPLY, weights, total, epochs)
    found = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) <= 1 for k in want)


def test_query_over_the_table(spark, docs):
    rows = queries.op8_mixing(spark, SF).collect()
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    epochs, used = collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert r["tokens"] == size[r["doc_id"]]
        epochs[r["doc_id"]].append(r["epoch"])
        used[r["domain"], r["lang"], r["source"]] += r["tokens"]
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 3 for v in epochs.values())
    leaf = {r["doc_id"]: k for r in docs.withColumns({f"l{n}": c for n, c in queries.mix_levels().items()}).collect() for k in [(r["ldomain"], r["llang"], r["lsource"])]}
    supply, most = collections.Counter(), collections.Counter()
    for i, k in leaf.items():
        supply[k] += size[i]
        most[k] = max(most[k], size[i])
    want = spread(supply, queries.MIX_WEIGHTS, int(0.8 * sum(supply.values())), 3)
    assert all(abs(used[k] - want[k]) <= most[k] / 2 + 1 for k in want)


def test_prefix_follows_the_order_and_slices_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "s") for i in range(400)], "doc_id long, text string, source string")
    run = lambda share: {r["doc_id"] for r in mixing.mix(df, {"source": F.col("source")}, [None], share, keep=[]).collect()}
    few, more = run(0.3), run(0.6)
    assert few < more and len(run(1.0)) == 400 and run(0.0) == set()
    monkeypatch.setattr(mixing, "SLICE_BITS", 2)
    assert run(0.3) == few


def test_odd_rows(odd, none):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(odd, levels, [None, None], 1.0, epochs=2)
    assert out.columns == [*odd.columns, "_epoch"]
    got = [r["doc_id"] for r in out.collect()]
    assert {x for x in ALL if x in (1, 2, 6, 7, 8, 9, 10)} <= set(got)
    assert mixing.mix(none, levels, [None, None], 0.5).collect() == []
    assert mixing.mix(odd, levels, [{"en": 0.0}, None], 0.5, keep=[]).filter("lang = 'en'").collect() == []


def test_no_python_in_the_plan(docs):
    plan = mixing.mix(docs, queries.mix_levels(), queries.MIX_WEIGHTS, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan
