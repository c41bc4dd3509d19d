import random
import zlib

import pytest

from tesserine.llm import queries
from tesserine.llm import toxicity as tx
from tests.llm.conftest import ALL, keys


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def slow(word, terms):
    """The same by distances: a first letter holds, one edit at most, and none for short terms."""
    best = None
    for n, term in enumerate(terms):
        body = term.rstrip("$")
        ends = [word] if term.endswith("$") else [word[:k] for k in range(len(word) + 1)]
        for e in ends:
            d = distance(e, body)
            if d <= (1 if len(body) >= tx.FUZZY_FROM else 0) and (d == 0 or e[:1] == body[:1]):
                best = min(best, (d, n)) if best else (d, n)
    return best


def test_automaton_equals_distances():
    rng = random.Random(3)
    terms = ["idiot$", "moron$", "lowei", "abc$", "stupid$", "chlla", "ab"]
    match = tx.Matcher(terms)
    words = ["idiot", "idiots", "idot", "idiiot", "1diot", "xdiot", "idoit", "moron", "marcon", "loweich", "lweich", "lowi", "loei", "abc", "abd", "stupid", "stupd", "stupidd", "chllax", "chla", "a", "i"]
    words += ["".join(rng.choice("abcdiotlowemn") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    for w in words:
        got, want = match[w], slow(w, terms)
        assert (got is None) == (want is None) and (got is None or got[0] == want[0]), (w, got, want)


def test_quotation_is_not_abuse():
    import numpy as np

    match, weight = tx.Matcher(["idiot$"]), np.array([5.0])
    abuse, quoted, said, none = (tx.features(t, match, weight) for t in ("you are an idiot today", 'the word "idiot" is old', "he was called idiot by them", "nothing here"))
    assert abuse[0] > 0 and abuse[2] == 0 and quoted[0] == said[0] == 0 and quoted[2] > 0 and said[2] > 0 and not any(none[:6])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}n" for _ in range(60)]
        for _ in range(4 if bad else 0):
            words[rng.randrange(60)] = rng.choice(["scumbag", "moronic", "vequaire", "vequoir", "vequta"])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(labelled):
    docs, labels = labelled
    rows = tx.toxicity(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows} == {True}
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    wrong = sum(r["predicted"] != (r["doc_id"] % 6 == 0) for r in held)
    assert len(held) > 300 and wrong <= 0.02 * len(held)


def test_held_out_labels_are_not_learned_from(labelled, spark):
    from pyspark.sql import functions as F

    docs, labels = labelled
    twisted = labels.withColumn("toxic", F.when(tx.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tx.fit(docs, labels), tx.fit(docs, twisted)
    assert a.terms == b.terms and (a.beta == b.beta).all()


def test_odd_rows(odd, none, labelled):
    docs, labels = labelled
    model = tx.fit(docs, labels)
    assert keys(tx.score(odd, model).collect()) == ALL and tx.score(none, model).collect() == []
    blank = tx.fit(none, labels)
    assert {r["score"] for r in tx.score(odd, blank).collect()} == {0.5}
    assert keys(tx.toxicity(odd, labels).collect()) == ALL


def test_query_on_held_out_documents(spark):
    """Labels of the third that is held out are never learned from: most of its toxic documents are caught, clean ones left alone."""
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_toxicity(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    by = {r["doc_id"]: r["predicted"] for r in rows if r["held_out"]}
    seen = [(bool(r["toxic"]), by[r["doc_id"]]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in by]
    caught, false = [p for t, p in seen if t], [p for t, p in seen if not t]
    print(len(caught), sum(caught), len(false), sum(false))
    assert sum(caught) >= 0.7 * len(caught) > 0 and sum(false) <= 0.02 * len(false)
