import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserine.llm import bpe, queries
from tests.llm.conftest import ALL, SF, keys

PATH = queries.vocabulary()


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_spec(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert list(codec.encode(text)) == want
    assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "  ", "Hello  World's café", "ÀÉİ ﬁ  x\xa0y \x00 \x85 \x1c", "ΣΑΣ Σ", "a <|endoftext|> x<|startoftext|>y 1234 it's I'LL", "日本語" * 80, "a" * 3000 + "!" * 501, "😀👍🏽 é́", "<|endoftext", "﻿abc​def"])
def test_equals_the_library(codec, library, text):
    check(codec, library, text)


def test_every_code_point_equals_the_library(codec, library):
    points = [x for x in range(0x40000) if not 0xD800 <= x < 0xE000] + list(range(0xE0000, 0xE0200))
    texts = [f"a{chr(x)}b" for x in points]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [hex(x) for x, t, w in zip(points, texts, want) if list(codec.encode(t)) != w.ids] == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=80))
def test_any_text_equals_the_library(codec, library, text):
    import unicodedata

    if unicodedata.unidata_version and any(unicodedata.category(x) in ("Cn", "Co") for x in text):
        return
    check(codec, library, text)


def test_fragments_are_cut_only_where_nothing_merges(codec):
    cuts = 0
    for word in ["qxzj", "hello", "erthshanrewh", "straße", "日本語", "zzzzqqqq"]:
        parts = list(codec.fragments(word))
        cuts += len(parts) - 1
        whole = sum(parts, ())
        assert codec.merge(whole) == sum(map(codec.merge, parts), ())
    assert cuts > 0


def test_long_and_short_merges_agree(codec, monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdestrhin"), 45)) for _ in range(50)]
    short = [codec.merge(next(iter([sum(codec.fragments(w), ())]))) for w in words]
    monkeypatch.setattr(bpe, "LONG", 0)
    assert [codec.merge(sum(codec.fragments(w), ())) for w in words] == short


def test_query_over_the_table(spark, docs, library):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    rows = queries.op1_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, none, codec):
    spec = bpe.read_spec(PATH)
    rows = bpe.round_trip(odd, spec).collect()
    assert keys(rows) == ALL
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    full = bpe.decode(bpe.encode(odd, spec), spec)
    assert set(odd.columns) < set(full.columns) and keys(full.collect()) == ALL
    assert {r["decoded"] for r in full.filter("doc_id in (3, 4)").collect()} == {""}
    assert bpe.round_trip(none, spec).collect() == [] and bpe.encode(none, spec).collect() == []
