import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank texts, a very long one, repeated rows and texts, and columns with names that operators use themselves."""
    long = " ".join(f"word{i % 977} {i * 7919 % 100003}" for i in range(60_000))
    base = "the quick brown fox jumps over the lazy dog while seven more foxes watch from the far side of the old river bank"
    rows = [
        (1, base, "en", "src1", 1), (2, base, "en", "src1", 1), (2, base, "en", "src1", 1), (3, None, None, None, None), (4, "", "en", "src2", 0),
        (5, " \n\t ", "de", None, 4), (6, long, "en", "src3", 9), (None, base, "fr", "src1", 1), (None, None, None, None, None), (7, "Wörter über Straßen und Häuser, die ich gern sehe", None, "src9", 3),
        (8, "\n".join([base] * 3), "en", "src1", 2), (9, "x", "es", "", 1), (10, "12 34 !!", "en", "src2", 8),
    ]
    extra = ["id string", "ids string", "shard string", "slot string", "n_lines string", "items string", "bucket string", "w string", "_key string", "_text string", "tokens string", "epoch string", "runs string", "score string", "kept string", "host string", "rec string", "pos string", "key string", "mark string"]
    return spark.createDataFrame([(*r, *["z"] * len(extra)) for r in rows], f"{SCHEMA}, {', '.join(extra)}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def keys(rows, c="doc_id"):
    return sorted((r[c] for r in rows), key=lambda x: (x is not None, x))


ALL = [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
