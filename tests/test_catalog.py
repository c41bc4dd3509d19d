"""Every query of the reference's operators against its SQL, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from tesserine.plans import catalog
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    mine, theirs = same(catalog.QUERIES[name](spark, SF), catalog.SQL[name], con)
    assert mine == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score", "source", "snippet"] and df.count() == 10


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_llm_part():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "tesserine.llm" in p.read_text()]


def test_chunk_documents_over_the_table(spark):
    rows = catalog.chunk_documents(spark, SF).collect()
    keys = {(r["source"], r["page_num"], r["ord"]) for r in rows}
    assert len(keys) == len(rows) and all(len(r["id"]) == 32 for r in rows)


def test_topk_plan_has_no_join_or_exchange(spark):
    from tesserine.operators.search import top_k

    plan = top_k(spark.read.parquet(f"{SF}/embeddings.parquet"), [0.1] * 64, 5, "vec_id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Join" not in plan and "Exchange" not in plan


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from tesserine.sources.files import under

    df = spark.read.parquet(f"{SF}/documents.parquet").filter(under(F.col("source"), "src1")).select("doc_id", "source")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(source,src1),StringStartsWith(source,src1/))]" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan
