import random

import pytest

from tesserine.operators.chunking import chunk, repair, split
from tesserine.schema import ChunkConfig


def texts(raw, config=None, source="f"):
    return [t for *_, t in split(raw, source, config or ChunkConfig())]


def test_one_short_paragraph_is_one_chunk():
    raw = b"One paragraph of more than fifty bytes, and of fewer than five hundred and twelve."
    assert list(split(raw, "f", ChunkConfig()))[0][1:] == (0, len(raw), raw)


def test_sizes_hold():
    out = texts(b"The quick brown fox jumps over the lazy dog. " * 40, ChunkConfig(200, 20))
    assert len(out) == 10 and max(map(len, out)) == 201


def test_each_chunk_begins_with_the_tail_of_the_one_before():
    config = ChunkConfig(150, 24)
    out = texts(b"Sentence number is here now. " * 30, config)
    assert len(out) > 2
    assert all(b.startswith(a[-24:] + b"\n\n") for a, b in zip(out, out[1:]))


def test_small_pieces_are_dropped():
    out = texts(b"tiny.\n\n" + b"word " * 200, ChunkConfig(300, 20, 50))
    assert all(len(x) >= 50 for x in out)


def test_ids():
    a, b = (list(split(b"hello world. " * 50, s, ChunkConfig())) for s in ("same.txt", "other.txt"))
    assert [k for k, *_ in a] == [k for k, *_ in split(b"hello world. " * 50, "same.txt", ChunkConfig())]
    assert a[0][0] != b[0][0]
    assert [len(t) for *_, t in a] == [506, 208] and a[0][0] == a[1][0] and a[0][0].startswith("615ec213")
    assert next(split(b"abc", "x.txt", ChunkConfig(min_chunk_size=1)))[0] == "535b9f30a289220061242b0aa494405a"


def test_hard_windows_overlap_twice():
    assert [len(x) for x in texts(b"x" * 1200)] == [512, 578, 370]


@pytest.mark.parametrize("raw", [b"", b" \n\t\n ", "  \n\n\u0085".encode()])
def test_nothing_from_nothing(raw):
    assert texts(raw) == []


def test_defaults():
    assert ChunkConfig(0, 0, 0) == ChunkConfig(512, 64, 50) and ChunkConfig(100, 100).overlap == 25 and ChunkConfig(overlap=-3).overlap == 64


def test_every_broken_byte_is_replaced():
    assert repair(b"a\xe2\x82b") == "a��b" and repair("é".encode()) == "é"


def test_paragraphs_keep_their_places():
    raw = b"\n\n  First paragraph, long enough to be kept by itself, it is hoped.\n \t\nSecond one.  \n"
    out = list(split(raw, "f", ChunkConfig(70, 10, 5)))
    assert [raw[s:e] for _, s, e, _ in out] == [b"First paragraph, long enough to be kept by itself, it is hoped.", b"Second one."]


def test_random_texts_keep_within_bounds():
    rng = random.Random(4)
    for _ in range(200):
        raw = "".join(rng.choice(["a", "é", ". ", "\n", "\n\n", " ", "word "]) for _ in range(rng.randrange(600))).encode()
        config = ChunkConfig(rng.randrange(8, 90), rng.randrange(1, 40), 1)
        assert all(0 <= s < e <= len(raw) for _, s, e, _ in split(raw, "f", config))
        assert all(len(t) <= config.chunk_size + config.overlap + 2 for t in texts(raw, config))


def test_pages_are_chunked_apart(spark):
    page = "Page text that is long enough to be a chunk of its own, surely so."
    docs = spark.createDataFrame([("a.pdf", "x", [page, "", page]), ("b.txt", page, None)], "path string, content string, pages array<string>")
    rows = sorted((r["source"], r["page_num"], r["ord"], r["text"]) for r in chunk(docs).collect())
    assert rows == [("a.pdf", 1, 0, page), ("a.pdf", 3, 0, page), ("b.txt", 0, 0, page)]


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", None), (None, "x" * 60)], "path string, content string")
    assert [(r["source"], r["text"]) for r in chunk(docs).collect()] == [("", "x" * 60)]
    assert chunk(docs.limit(0)).collect() == []
