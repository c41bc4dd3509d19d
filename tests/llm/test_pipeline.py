"""The pipeline against the stages' brute-force versions."""

from tokenizers import Tokenizer

import corpus_pipeline
from tesserine.llm import queries
from tests.llm import test_linededup, test_partenum
from tests.llm.conftest import SF


def test_stages_in_turn(spark, docs):
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame((out := stage(spark, now, SF)).collect(), out.schema)
        assert name == "encode" or now.columns == docs.columns
        seen.append({r["doc_id"]: r for r in now.collect()})
    one, two, three, four, five = seen
    assert len(one) >= 0.99 * docs.count()
    gone = test_linededup.brute([(i, r["text"]) for i, r in one.items()])
    texts = {i: "\n".join(x for n, x in enumerate(r["text"].split("\n")) if n not in gone[i]) for i, r in one.items()}
    assert {i: r["text"] for i, r in two.items()} == {i: t for i, t in texts.items() if t.strip() or not gone[i]}
    assert all(r["n_chars"] == len(r["text"]) for r in two.values())
    assert set(three) == {i for i, _, c in test_partenum.brute([(i, r["text"]) for i, r in two.items()]) if i == c}
    size = lambda d: sum(len(r["text"].split()) for r in d.values())
    assert set(four) < set(three) and 0.7 * size(three) < size(four) < 0.85 * size(three)
    library = Tokenizer.from_file(queries.vocabulary())
    assert set(five) == set(four) and all(list(r["ids"]) == library.encode(four[i]["text"], add_special_tokens=False).ids for i, r in five.items())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((i, r["n_tokens"]) for i, r in five.items())


def test_odd_rows_pass_through(spark, odd):
    now = odd.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame((out := stage(spark, now, SF)).collect(), out.schema)
        assert now.count()


def test_an_empty_table_passes_through(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame((out := stage(spark, now, SF)).collect(), out.schema)
        assert now.isEmpty()


def test_near_copies_are_those_of_five_words_and_four_fifths(spark, docs):
    words = [f"w{i}" for i in range(49)]
    near = ["new" if i == 24 else w for i, w in enumerate(words)]  # 40 of 50 shingles of five words; 42 of 50 of four
    far = ["new" if i in (12, 36) else w for i, w in enumerate(words)]
    rows = [(i, " ".join(x), "en", "src1", 1) for i, x in enumerate((words, near, far))]
    assert [r["doc_id"] for r in corpus_pipeline.jaccard_join(spark, spark.createDataFrame(rows, docs.schema), SF).orderBy("doc_id").collect()] == [0, 2]


def test_rows_without_a_key_stay_beside_near_copies(spark, odd):
    rows = corpus_pipeline.jaccard_join(spark, odd.select(*corpus_pipeline.COLUMNS), SF).collect()
    assert sum(r["doc_id"] is None for r in rows) == 2 and {r["doc_id"] for r in rows} >= {1, 3, 4, 5} and 2 not in {r["doc_id"] for r in rows}
