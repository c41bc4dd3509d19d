"""Embedders: text to unit vectors. The bag of words needs no model; adapters run a program or ask a server."""

from __future__ import annotations

import json
import math
import shutil
import subprocess
import tempfile
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions import text as tx

#: Texts for each call of a model.
BATCH = 32


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def dims(self) -> int: ...


def unit(v: Sequence[float]) -> list[float]:
    """The vector at length 1, in float; a zero vector stays."""
    x = np.asarray(v, np.float32)
    size = math.sqrt(float((x.astype(np.float64) ** 2).sum()))
    return (x * np.float32(1.0 / size)).tolist() if size else x.tolist()


def one_line(text: str) -> str:
    for mark in ("\r\n", "\n", "\r", tx.SEPARATOR):
        text = text.replace(mark, " ")
    return text.strip()


class BagOfWords:
    """Counts of lower-cased words by FNV-1a bucket, at length 1."""

    def __init__(self, dims: int = 256):
        self._dims = dims

    def dims(self) -> int:
        return self._dims

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = np.zeros(self._dims)
        for word in text.lower().split():
            h = 2166136261
            for b in word.encode("utf-8", "surrogatepass"):
                h = ((h ^ b) * 16777619) & 0xFFFFFFFF
            out[h % self._dims] += 1
        return unit(out)


def _floats(x: Any) -> list[float]:
    if isinstance(x, list) and x and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in x):
        return [float(v) for v in x]
    raise ValueError("not a vector")


def _field(x: Any) -> list[float]:
    """A vector, or the first of a list of vectors."""
    try:
        return _floats(x)
    except ValueError:
        if isinstance(x, list) and x:
            return _floats(x[0])
        raise


def parse_program_output(raw: str | bytes) -> list[list[float]]:
    """Vectors from a program: a list under data, one object, nested or flat arrays, or lines of numbers, others left out."""
    text = (raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw).strip()
    if not text:
        raise ValueError("no output")
    if text[0] in "{[":
        try:
            value = json.loads(text)
            if isinstance(value, dict):
                return [_floats(x["embedding"]) for x in value["data"]] if value.get("data") else [_floats(value["embedding"])]
            return [_floats(x) for x in value] if isinstance(value[0], list) else [_floats(value)]
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise ValueError("output of no known shape") from e
    out = []
    for line in text.split("\n"):
        try:
            out.append([float(x) for x in line.split()])
        except ValueError:
            continue
    out = [v for v in out if v]
    if not out:
        raise ValueError("no vectors in the output")
    return out


def parse_server_response(raw: str | bytes) -> list[list[float]]:
    """Vectors from a server: a list of objects, one object, or a list under data; each vector flat, or the first of a list."""
    text = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw
    try:
        value = json.loads(text)
        if isinstance(value, list) and value:
            return [_field(x["embedding"]) for x in value]
        if value.get("embedding"):
            return [_field(value["embedding"])]
        return [_floats(x["embedding"]) for x in value["data"]]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"response of no known shape: {text[:120]}{'...' if len(text) > 120 else ''}") from e


class ProgramEmbedder:
    """A program that embeds prompts from a file, set apart by a separator, and prints the vectors."""

    def __init__(self, model: str, program: str = "llama-embedding", probe: bool = True):
        self.model, self.program, self._dims = model, program, 0
        if probe:
            self._dims = len(self.embed(["probe"])[0])

    def dims(self) -> int:
        return self._dims

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), BATCH):
            part = [one_line(t) for t in texts[k : k + BATCH]]
            with tempfile.NamedTemporaryFile("w", suffix=".txt", encoding="utf-8") as f:
                f.write(tx.SEPARATOR.join(part) + "\n")
                f.flush()
                done = subprocess.run([self.program, "--model", self.model, "--file", f.name, "--embd-normalize", "2", "--embd-output-format", "json", "--embd-separator", tx.SEPARATOR], capture_output=True, check=False)
            if done.returncode:
                raise RuntimeError(f"{self.program}: {done.stderr.decode(errors='replace').strip()}")
            got = parse_program_output(done.stdout)
            if len(got) != len(part):
                raise RuntimeError(f"{self.program} made {len(got)} vectors of {len(part)} texts")
            out += map(unit, got)
        return out


class ServerEmbedder:
    """A server that embeds the texts of a POST to /embedding."""

    def __init__(self, url: str, timeout: float = 60.0, probe: bool = True):
        self.url, self.timeout, self._dims = url.rstrip("/"), timeout, 0
        if probe:
            self._dims = len(self.embed(["probe"])[0])

    def dims(self) -> int:
        return self._dims

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), BATCH):
            body = json.dumps({"content": [one_line(t) for t in texts[k : k + BATCH]]}).encode()
            request = urllib.request.Request(f"{self.url}/embedding", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                out += map(unit, parse_server_response(answer.read()))
        return out


def detect(model: str = "", program: str = "llama-embedding", url: str = "") -> Embedder:
    """The program if it is there and works, else the server; the program's own error if neither does."""
    failed: Exception | None = None
    if shutil.which(program):
        try:
            return ProgramEmbedder(model, program)
        except Exception as e:  # noqa: BLE001
            failed = e
    if url:
        try:
            return ServerEmbedder(url)
        except Exception as e:  # noqa: BLE001
            failed = failed or e
    raise RuntimeError(f"no embedder: needs {program} or a server" + (f" ({failed})" if failed else "")) from failed


def embed(df: DataFrame, embedder: Embedder, text: str = "text", to: str = "vec") -> DataFrame:
    """df with each text's vector, in batches on the executors."""
    import pyarrow as pa

    names = [c for c in df.columns if c != to]

    def run(batches) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                vectors = embedder.embed([t or "" for t in part.column(names.index(text)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, to])

    return df.select(*names).mapInArrow(run, T.StructType([*df.select(*names).schema.fields, T.StructField(to, T.ArrayType(T.FloatType()))]))


def buckets(df: DataFrame, key: str, words: Column, dims: int = 256) -> DataFrame:
    """(key, bucket, w): the bag of words as sparse unit vectors, without Python. Each distinct word is hashed once."""
    seen = df.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    spread = seen.select("word").distinct().select("word", (tx.fnv1a(F.col("word")) % dims).alias("bucket"))
    counts = seen.join(spread, "word").groupBy(key, "bucket").agg(F.sum("n").cast("double").alias("n"))
    size = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    return counts.join(size, key).select(key, "bucket", (F.col("n") / F.col("size")).alias("w"))


class Buckets(dict):
    """Buckets by word, a bounded number of words at a time."""

    MOST = 200_000

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, word: str) -> int:
        h = 2166136261
        for b in word.encode("utf-8", "surrogatepass"):
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h % self.dims
        return self[word]


def bags(df: DataFrame, key: str, text: str = "text", dims: int = 256) -> DataFrame:
    """(key, bucket, w): the same in one pass over the texts, without a shuffle of their words."""
    import pyarrow as pa

    def run(batches) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        known = Buckets(dims)
        for batch in batches:
            own = [np.unique(np.fromiter(map(known.__getitem__, (t or "").lower().split()), np.int64), return_counts=True) for t in batch.column(1).to_pylist()]
            sizes = [len(b) for b, _ in own]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(own)), sizes)))
            weights = [n / np.sqrt((n.astype(np.float64) ** 2).sum()) for _, n in own]
            join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
            yield pa.RecordBatch.from_arrays([ids, pa.array(join([b for b, _ in own], np.int64)), pa.array(join(weights, np.float64))], names=[key, "bucket", "w"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField("bucket", T.LongType()), T.StructField("w", T.DoubleType())]))


EmbedFunction = Callable[[Sequence[str]], list[list[float]]]
