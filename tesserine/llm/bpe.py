"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that stand next to each other inside no token of the vocabulary can never be merged, whatever
surrounds them. Each such place is a certain cut: the fragments between cuts are encoded on their own and their ids
concatenated, which equals the encoding of the whole. Fragments are short and recur, so each is merged once and kept.

The vocabulary file is read on the driver and broadcast; its size does not depend on the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.llm.common import arrow_limits

#: Words and fragments that one worker keeps at most; beyond that it starts afresh.
KEPT = 250_000
#: Fragments of more symbols are merged with a heap, in O(n log n).
LONG = 48


#: Code points that are letters by newer tables than the library's, and capitals that the library's newer tables know,
#: with their small letters. (Its patterns and its lower-casing go by different versions of Unicode.)
NO_LETTERS = """
0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7cf a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1
16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
CAPITALS = {
    **{0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B},
    **{x: x + 0x20 for x in range(0x10D50, 0x10D66)},
    **{x: x + 0x1B for x in range(0x16EA0, 0x16EB9)},
}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class Words(dict):
    """Ids by word, packed; what is missing is encoded and kept."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        out = array("i", self.codec.word(word)).tobytes()
        if len(self) >= KEPT:
            self.clear()
        if len(word) <= LONG:
            self[word] = out
        return out


class Codec:
    """Encoder and decoder for a tokenizers file with a byte-level BPE model, word-end suffix and lower-casing normalizer."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model = conf["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in conf["added_tokens"]}
        self.names = {i: s for s, i in (self.vocab | self.added).items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (n, self.vocab[a + b]) for n, (a, b) in enumerate(pairs)}
        split = next(x for x in conf["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        no_letters = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in NO_LETTERS.split())
        ranges = [[int(x, 16) for x in part.split("-")] for part in NO_LETTERS.split()]
        self.rare = frozenset(chr(c) for r in ranges for c in range(r[0], r[-1] + 1)) | frozenset(map(chr, CAPITALS))
        pattern = pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{no_letters}]]").replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{no_letters}]]")
        self.find_rare = regex.compile(pattern, regex.V1).findall
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]
        self.joined = self._joined(letters)
        self.words = Words(self)
        self.parts: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.space = regex.compile(r"[^\S ]\s*| \s+")  # all white space but a single blank

    def _joined(self, letters: list[str]) -> set[tuple[int, int]]:
        """The pairs of neighbouring one-byte symbols inside some token; every other pair is a forced boundary."""
        of, out = {x: b for b, x in enumerate(letters)}, set()
        for token in self.vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            if not all(x in of for x in body):
                continue
            own = [self.inner[of[x]] for x in body]
            if ends and body:
                own[-1] = self.last[of[body[-1]]]
            out.update(zip(own, own[1:]))
        return out

    def normalize(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def fragments(self, word: str) -> Iterator[tuple[int, ...]]:
        """The word's one-byte symbols, cut at every forced boundary."""
        data = word.encode("utf-8", "surrogatepass")
        own = [self.inner[b] for b in data]
        own[-1] = self.last[data[-1]]
        begin = 0
        for k in range(1, len(own)):
            if (own[k - 1], own[k]) not in self.joined:
                yield tuple(own[begin:k])
                begin = k
        yield tuple(own[begin:])

    def merge(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Join the neighbouring pair of lowest rank, leftmost first, until none can be joined."""
        if len(ids) > LONG:
            return self._merge_long(ids)
        own, rank = list(ids), self.rank
        while len(own) > 1:
            best, at, to = 1 << 60, -1, 0
            for k in range(len(own) - 1):
                r = rank.get((own[k], own[k + 1]))
                if r is not None and r[0] < best:
                    best, at, to = r[0], k, r[1]
            if at < 0:
                break
            own[at : at + 2] = [to]
        return tuple(own)

    def _merge_long(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        own, rank, n = list(ids), self.rank, len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(k: int) -> None:
            j = after[k]
            if j < n and (r := rank.get((own[k], own[j]))) is not None:
                heapq.heappush(heap, (r[0], k, own[k], own[j], r[1]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, a, b, to = heapq.heappop(heap)
            j = after[k]
            if own[k] != a or j >= n or own[j] != b:
                continue
            own[k], own[j] = to, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            if before[k] >= 0:
                offer(before[k])
            offer(k)
        return tuple(x for x in own if x >= 0)

    def word(self, word: str) -> tuple[int, ...]:
        out: tuple[int, ...] = ()
        for part in self.fragments(word):
            ids = self.parts.get(part)
            if ids is None:
                if len(self.parts) >= KEPT:
                    self.parts.clear()
                ids = self.merge(part)
                if len(part) <= LONG:
                    self.parts[part] = ids
            out += ids
        return out

    def encode(self, text: str) -> array:
        """The ids of the whole text."""
        out, known = array("i"), self.words.__getitem__
        for n, piece in enumerate(self.special.split(text) if any(x in text for x in self.added) else [text]):
            if n % 2:
                out.append(self.added[piece])
            elif piece.isascii() or self.rare.isdisjoint(set(piece)):
                out.frombytes(b"".join(map(known, self.find(self.normalize(piece)))))
            else:
                out.frombytes(b"".join(map(known, self.find_rare(self.normalize(piece).translate(CAPITALS)))))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by one space, as the library does where a file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec_of(spec: str) -> Codec:
    """One codec for each worker and vocabulary."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, spec: str, text: str = "text", to: str = "ids") -> DataFrame:
    """df with the ids of the whole text as array<int>. A null text counts as empty; an empty text has no ids. A column
    called like `to` is replaced; all others stay as they are."""
    arrow_limits(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(spec)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts):  # noqa: ANN001, ANN202
        codec = codec_of(held.value)
        return texts.map(lambda x: list(codec.encode(x or "")), na_action=None)

    return df.withColumn(to, ids(F.col(text)))


def decode(df: DataFrame, spec: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the decoded text. Null or empty ids give the empty text."""
    arrow_limits(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(spec)

    @F.pandas_udf(T.StringType())
    def back(rows):  # noqa: ANN001, ANN202
        codec = codec_of(held.value)
        return rows.map(lambda x: codec.decode([] if x is None else x), na_action=None)

    return df.withColumn(to, back(F.col(ids)))


def round_trip(df: DataFrame, spec: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each whole text in one pass over the rows, without a shuffle, and return the key, the number of
    tokens and SHA-256 of the ids (decimal, joined by one space) and of the decoded text (UTF-8). Null texts count as
    empty: no tokens. Repeated rows give repeated results; an empty table gives none; other columns are not read."""
    import pyarrow as pa

    arrow_limits(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(spec)
    kind = df.schema[key].dataType

    def run(batches):  # noqa: ANN001, ANN202
        codec = codec_of(held.value)
        numbers = {i: str(i) for i in codec.names}
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for x in batch.column(1).to_pylist():
                ids = codec.encode(x or "")
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                text_hex.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
