"""Toxicity by a learned lexicon, matched through Levenshtein automata and weighed in context.

The lexicon holds words and word stems that labelled toxic documents use far more often than others. Its trie is
intersected with the Levenshtein automata of all terms at once: a state is the set of trie nodes a word may have reached with the edits spent, made
when first met. A word dies as soon as no term is within reach, so most words cost a few steps; results are kept by word.

Each hit is scored within its context window: quotation marks around it, or a verb of saying near it, make it a
quotation rather than abuse. A logistic regression over the hits of a whole text gives the probability.

Lexicon and regression are fitted on a bounded sample of labelled rows. Language, source and key are no inputs.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import Scratch, arrow_limits

#: Labelled rows of each kind to learn from; terms considered and kept.
TOXIC_ROWS, OTHER_ROWS, MOST_SEEN, MOST_TERMS = 2000, 4000, 20_000, 500
#: Stems' lengths; terms of at least so many letters may be misspelled by one edit.
STEMS, FUZZY_FROM = range(3, 9), 5
LEAST_ODDS = math.log(8.0)
WINDOW = 40
#: Marks of quotation and verbs of saying.
QUOTES = "\"“”„«»‹›‘’"
SAYING = re.compile(r"\b(said|says|wrote|writes|called|quote|quoted|sagte|schrieb|nannte|zitat|dit|écrit|appelé|citation|dijo|escribió|llamó|cita)\b")
WORD = re.compile(r"[^\W\d_]+")
KEPT = 400_000
ENDS = "$"


def terms_of(text: str) -> set[str]:
    """A text's words, ended by $, and their stems."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w + ENDS)
        out.update(w[:k] for k in STEMS if len(w) > k)
    return out


class Matcher(dict):
    """Best (term, edits) by word, or None. A stem matches words that begin with it, a term ended by $ whole words."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.fuzzy: list[bool] = [False]
        for n, term in enumerate(terms):
            at = 0
            for x in term:
                if x not in self.child[at]:
                    self.child[at][x] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                    self.fuzzy.append(False)
                at = self.child[at][x]
                self.fuzzy[at] |= len(term.rstrip(ENDS)) >= FUZZY_FROM
            self.ends[at] = n
        self.fuzzy[0] = any(len(t.rstrip(ENDS)) >= FUZZY_FROM for t in terms)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.hits: list[tuple[int, int] | None] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With letters of a term left out, and without what a cheaper way reaches."""
        out = set(pairs)
        for node, spent in pairs:
            if spent == 0:
                out.update((c, 1) for c in self.child[node].values() if self.fuzzy[c])
        return frozenset((n, s) for n, s in out if not (s == 1 and (n, 0) in out))

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            found = [(s, self.ends[n]) for n, s in pairs if self.ends[n] >= 0 and (s == 0 or self.fits(self.ends[n]))]
            self.hits.append(min(found) if found else None)
            self.steps.append({})
        return self.states[pairs]

    def fits(self, term: int) -> bool:
        return len(self.terms[term].rstrip(ENDS)) >= FUZZY_FROM

    def _step(self, state: int, x: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, spent in self.sets[state]:
            to = self.child[node].get(x)
            if to is not None:
                out.add((to, spent))
            if spent == 0 and node and x != ENDS:  # the first letter holds
                if self.fuzzy[node]:
                    out.add((node, 1))
                out.update((c, 1) for y, c in self.child[node].items() if y != ENDS and self.fuzzy[c])
        return self._state(self._closed(out)) if out else -1

    def __missing__(self, word: str) -> tuple[int, int] | None:
        if len(self) >= KEPT:
            self.clear()
        if len(self.sets) > 50_000:
            self._reset()
        best, state = None, self.start
        for x in word + ENDS:
            to = self.steps[state].get(x)
            if to is None:
                to = self.steps[state][x] = self._step(state, x)
            if to < 0:
                break
            state = to
            hit = self.hits[state]
            if hit is not None and (best is None or hit < best):
                best = hit
        self[word] = best
        return best


def features(text: str, matcher: Matcher, weight: np.ndarray) -> list[float]:
    """Numbers for the regression from the whole text."""
    low = text.lower()
    words = WORD.findall(low)
    if not any(map(matcher.__getitem__, words)):
        return [0.0] * 6 + [math.log1p(len(words))]
    abuse = quoted = loose = heavy = most = 0.0
    kinds = set()
    for m in WORD.finditer(low):
        hit = matcher[m[0]]
        if hit is None:
            continue
        edits, term = hit
        before, after = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
        inside = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        if inside or SAYING.search(before[-20:]):
            quoted += 1
        elif edits:
            loose += 1
        else:
            abuse += 1
            heavy += weight[term]
            most = max(most, weight[term])
            kinds.add(term)
    n = len(words)
    return [math.log1p(abuse), math.log1p(loose), math.log1p(quoted), most, math.log1p(100 * heavy / n), math.log1p(len(kinds)), math.log1p(n)]


@dataclass(frozen=True)
class Model:
    terms: list[str]
    weight: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray  # the last is the constant

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.mean) / self.scale @ self.beta[:-1] + self.beta[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(key: str = "doc_id") -> Column:
    """Rows no label of which is learned from; a null key is the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def choose(seen: list[tuple[str, int, int]], toxic: int, other: int) -> tuple[list[str], np.ndarray]:
    """Terms by toxic documents times log-odds, longest first among equals; none begins with another."""
    odds = lambda t, o: math.log((t + 0.5) / (toxic + 1) / ((o + 0.5) / (other + 1)))
    rows = sorted(((t * odds(t, o), len(x), x, odds(t, o)) for x, t, o in seen if odds(t, o) >= LEAST_ODDS), key=lambda r: (-r[0], -r[1], r[2]))
    kept: dict[str, float] = {}
    stems: set[str] = set()
    for _, _, x, w in rows:
        if len(kept) >= MOST_TERMS:
            break
        if x in stems or any(x[:k] in kept for k in range(STEMS.start, len(x))):
            continue
        kept[x] = w
        stems.update(x[:k] for k in range(STEMS.start, len(x)))
    return list(kept), np.array(list(kept.values()))


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: mean, scale, coefficients."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta, hold = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    hold[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (y - p) - hold @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Lexicon and regression from TOXIC_ROWS toxic and OTHER_ROWS other labelled rows at most, those with the smallest hashes of the
    key, none of them held out. Without rows of both kinds the model knows no term and scores one half."""
    import pyarrow as pa

    spark = docs.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "toxicity")
    own = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg((F.max(label) > 0).alias("_toxic")).withColumn("_h", F.xxhash64(key))
    ids = own.filter("_toxic").orderBy("_h", key).limit(TOXIC_ROWS).unionByName(own.filter("not _toxic").orderBy("_h", key).limit(OTHER_ROWS))
    ids = ids.select(F.col(key).alias("_id"), "_toxic")
    rows = scratch(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(ids), F.col("_key") == F.col("_id")).select("_toxic", "t"))
    many = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    toxic, other = many.get(True, 0), many.get(False, 0)
    if not toxic or not other:
        return Model([], np.empty(0), np.zeros(7), np.ones(7), np.zeros(8))

    def count(batches):  # noqa: ANN001, ANN202
        from collections import Counter

        yes: Counter[str] = Counter()
        no: Counter[str] = Counter()
        for batch in batches:
            for bad, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (yes if bad else no).update(terms_of(t))
        names = list(yes.keys() | no.keys())
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([yes[x] for x in part], pa.int64()), pa.array([no[x] for x in part], pa.int64())], names=["term", "yes", "no"])

    least = max(4, toxic * 3 // 1000)
    seen = rows.mapInArrow(count, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).filter(F.col("yes") >= least)
    gain = F.col("yes") * F.log((F.col("yes") + 0.5) / F.lit(toxic + 1) / ((F.col("no") + 0.5) / F.lit(other + 1)))
    seen = seen.orderBy(gain.desc(), "term").limit(MOST_SEEN).toArrow()
    terms, weight = choose(list(zip(*(seen.column(c).to_pylist() for c in ("term", "yes", "no")))), toxic, other)

    def describe(batches):  # noqa: ANN001, ANN202
        matcher = Matcher(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t, matcher, weight) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["toxic", "x"])

    got = rows.mapInArrow(describe, "toxic boolean, x array<double>").toArrow()
    x, y = np.array(got.column("x").to_pylist()), np.array(got.column("toxic").to_pylist(), float)
    scratch.close()
    return Model(terms, weight, *regress(x, y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) for every row of docs, in one pass over whole texts, without a shuffle. Null texts count as
    empty, which have a score too. Repeated rows give repeated results, an empty table none; other columns are not read."""
    import pyarrow as pa

    spark = docs.sparkSession
    arrow_limits(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):  # noqa: ANN001, ANN202
        own = held.value
        matcher = Matcher(own.terms)
        for batch in batches:
            rows = [features(t or "", matcher, own.weight) for t in batch.column(2).to_pylist()]
            s = own.score(np.array(rows).reshape(-1, 7))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    from pyspark.sql import types as T

    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).cast("string")).mapInArrow(run, out)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return score(docs, fit(docs, labels, key, text), key, text)
