import collections
import math
import random
import re

import pytest

from tesserine.llm import quality, queries
from tests.llm.conftest import ALL, SF, keys


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_query_over_the_table(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op6_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize("text", ["a b a b a b", "a a a a", "a b c d a b c", "x\n\nx\n x\nx", "##<>| é b\x0bc\x0c", "one", "w " * 500])
def test_measures(spark, text):
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert tuple(quality.measures(df).select(*quality.BASE).first()) == base(text)


def test_upper_bound_is_exact():
    for k, n, delta in [(0, 50, 0.05), (3, 200, 0.01), (40, 45, 0.1)]:
        p = quality.upper_bound(k, n, delta)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(delta, rel=1e-6)
    assert quality.upper_bound(0, 0, 0.1) == quality.upper_bound(5, 5, 0.1) == 1.0


def test_levels_keep_the_risk_of_all_rules_together(spark):
    rng = random.Random(4)
    prose = lambda n, sign="": " ".join(f"w{rng.randrange(10**6)}{sign}" for _ in range(n))
    good = [(i, prose(80, "#" if i % 40 == 0 else ""), "en") for i in range(800)]  # 1 in 40 good ones has as many signs as a bad one
    bad = [(1000 + i, prose(80, "###"), "en") for i in range(60)]
    few = [(2000 + i, prose(80, "###"), "xx") for i in range(5)]
    long = [(3000 + i, prose(60, "y" * (6 if i % 25 == 0 else 0)), "yy") for i in range(500)]
    docs = spark.createDataFrame(good + bad + few + long, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good + long] + [(i, 0) for i, *_ in bad + few] + [(1, 0), (None, 0), (5, None)], "doc_id long, quality int")
    m = quality.measures(docs)
    got = quality.levels(m, labels)
    # Brute force: the tail of the binomial at the risk, level by level.
    rows = {r["doc_id"]: r for r in m.collect()}

    def rejects(doc, level):
        return any((rows[doc][rule] or 0) > cuts[level - 1] for rule, cuts in quality.LADDER.items())

    for stratum, own in (("en", good), ("yy", long), ("xx", [])):
        want = 0
        for level in range(1, quality.LEVELS + 1):
            k, n = sum(rejects(i, level) for i, *_ in own), len(own)
            tail = sum(math.comb(n, i) * quality.RISK**i * (1 - quality.RISK) ** (n - i) for i in range(k + 1))
            if tail > quality.DELTA / 3:
                break
            want = level
        assert got[stratum] == want
    assert 0 < got["en"] < quality.LEVELS and got["xx"] == 0
    kept = {r["doc_id"]: r["kept"] for r in quality.apply_rules(m, got).collect()}
    assert not any(kept[i] for i, *_ in bad) and all(kept[i] for i, *_ in few)
    assert sum(not kept[i] for i, *_ in good) <= quality.RISK * len(good)


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = quality.quality(odd, labels).collect()
    assert keys(rows) == ALL and {tuple(r[c] for c in quality.BASE) for r in rows if r["doc_id"] in (3, 4, 5)} == {(0,) * 5}
    assert quality.quality(none, labels).collect() == [] and keys(quality.quality(odd, labels.limit(0)).collect()) == ALL


def test_no_python_in_the_plan(docs):
    plan = quality.measures(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
