from pyspark.sql import functions as F

from tesserine.llm import langid, queries
from tests.llm.conftest import ALL, SF, keys


def test_documents_are_identified(spark, docs):
    label = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op10_language_id(spark, SF).collect()
    assert len(rows) == len(label) and sum(r["kept"] for r in rows) >= 0.99 * len(rows)
    assert sum(r["language"] == label[r["doc_id"]] for r in rows if r["kept"]) >= 0.98 * len(rows)


def test_text_alone_identifies_held_out_documents(spark, docs):

    known = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    label = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.identify(docs.filter("doc_id % 2 = 1"), langid.fit(known)).collect()
    assert sum(r["language"] == label[r["doc_id"]] for r in rows) >= 0.95 * len(rows) > 50


def test_pages_use_their_evidence(spark):
    rows = queries.langid_pages(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert sum(r["kept"] for r in rows) > 0.95 * len(rows)


def test_evidence_decides_where_the_text_does_not(spark, docs):
    more = spark.createDataFrame([(10**6 + i, "ab", x, None, 2) for i, x in enumerate(["fr", "de", None])], docs.schema)
    both = docs.unionByName(more)
    rows = langid.identify(both, langid.fit(docs), declared=both["lang"], host=both["source"]).filter("doc_id >= 1000000").orderBy("doc_id").collect()
    assert [r["language"] for r in rows] == ["fr", "de", "en"] and rows[0]["confidence"] > 0.85 > rows[2]["confidence"]


def test_page_evidence(spark):
    rows = [("http://www.Ex.example.de/x", '<html class=a LANG="DE-de">'), ("https://host", "<html lang=fr>"), (None, None), ("x", "<html>")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = [tuple(r) for r in df.select(*langid.page_evidence().values()).collect()]
    assert got[0] == ("de", "de", "www.ex.example.de", "example.de") and got[1][0] == "fr" and got[1][2] == "host" and got[2] == (None,) * 4 and got[3][0] is None


def test_odd_rows(odd, none, docs):
    model = langid.fit(docs)
    out = langid.identify(odd, model, declared=odd["lang"], host=odd["source"])
    rows = out.collect()
    assert keys(rows) == ALL and out.columns == ["doc_id", "language", "confidence", "kept"]
    assert not any(r["kept"] for r in rows if r["doc_id"] in (3, 4, 5)) and [r["language"] for r in rows if r["doc_id"] == 7] == ["de"]
    assert langid.identify(none, model, declared=none["lang"], host=none["source"]).collect() == []
    blank = langid.fit(none)
    assert blank.languages == () and {r["language"] for r in langid.identify(odd, blank).collect()} == {"und"}


def test_a_rare_language_is_in_the_model(spark):
    many = [(i, f"the quick brown fox {i} jumps over the lazy dog", "en") for i in range(4000)]
    rare = [(10**6 + i, "βραδιάζει και ο ουρανός είναι κόκκινος πάνω από τη θάλασσα", "el") for i in range(6)]
    df = spark.createDataFrame(many + rare, "doc_id long, text string, lang string")
    model = langid.fit(df, sample=50)
    assert model.languages == ("el", "en")
    rows = langid.identify(df.filter("lang = 'el'"), model).collect()
    assert len(rows) == 6 and all(r["kept"] and r["language"] == "el" for r in rows)


def test_held_out_documents_by_text_and_host_alone(spark):
    """The model sees half of the documents; the others are identified without what they declare."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    model = langid.fit(docs.filter("half = 0"))
    out = langid.identify(docs.filter("half = 1"), model, host=F.col("source")).withColumnRenamed("doc_id", "id")
    both = out.join(docs.filter("length(text) >= 40 and lang is not null"), F.col("id") == F.col("doc_id"))
    n, kept, right = both.agg(F.count("*"), F.count_if("kept"), F.count_if(F.col("language") == F.col("lang"))).first()
    print(n, kept, right)
    assert n > 300 and kept >= 0.97 * n and right >= 0.97 * n


def test_ties_go_to_the_first_language(spark):
    rows = [(1, "abc def ghi", "xx"), (2, "abc def ghi", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df, langid.fit(df)).collect()
    assert {r["language"] for r in out} == {"xx"} and {round(r["confidence"], 6) for r in out} == {0.5}
