"""Embedding near-duplicates through an inverted multi-index.

Each half of a unit vector has its own codebook; a pair of codewords is a cell of the product grid, and every vector lies in
its nearest cell. For each vector the multi-sequence algorithm visits cells in order of distance until the distance
exceeds that of its own cell by a margin. The margin is calibrated on vectors moved to the very threshold:
it reaches the target share of them from one side or the other. Two vectors meet if either visits the other's cell.

Who meets is verified by cosine in double precision. Cells are cut into blocks of bounded size, block meets block, and
only counts and a spanning forest of the links come out: no list of pairs. Equal vectors are one, with a weight.

Codebooks and margin are fitted on a bounded sample; the grid grows with the number of vectors. Vectors of each length have a
grid of their own, all in the same jobs. A dense cell's pairs of blocks are dealt over many keys, the smaller side
repeated.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.llm.common import Scratch, arrow_limits, settle
from tesserine.llm.components import components

#: Vectors that codebooks are fitted on, about, for all lengths together; vectors in a cell, about, and in a block; pairs of blocks of one key, about.
SAMPLE, PER_CELL, BLOCK, PAIRS = 20_000, 64, 512, 16
TARGET = 0.99
#: Vectors of a length from which on it has a grid.
LEAST = 16


@dataclass(frozen=True)
class Index:
    words: tuple[np.ndarray, np.ndarray]
    margin: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return tuple(((p * p).sum(1)[:, None] - 2 * p @ w.T + (w * w).sum(1)) for p, w in zip((x[:, :h], x[:, h:]), self.words))

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """Each vector's cells from the nearest on."""
        one, two = self.distances(x)
        width = len(self.words[1])
        rank1, rank2 = np.argsort(one, axis=1), np.argsort(two, axis=1)
        return [multi_sequence(a[p].tolist(), b[q].tolist(), p.tolist(), q.tolist(), width, self.margin) for a, b, p, q in zip(one, two, rank1, rank2)]


def multi_sequence(a: list[float], b: list[float], p: list[int], q: list[int], width: int, margin: float) -> list[int]:
    """Cells (p[i], q[j]) in order of a[i] + b[j], both ascending, up to the first sum plus margin."""
    out, most = [], a[0] + b[0] + margin
    heap, done = [(a[0] + b[0], 0, 0)], set()
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > most:
            break
        out.append(p[i] * width + q[j])
        done.add((i, j))
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in done):
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in done):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(12):
        near = ((words * words).sum(1) - 2 * x @ words.T).argmin(1)
        sums, n = np.zeros_like(words), np.bincount(near, minlength=len(words))
        np.add.at(sums, near, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def fit(sample: np.ndarray, total: int, cosine: float, target: float = TARGET, seed: int = 3) -> Index:
    """Codebooks of both halves and the margin, from unit vectors."""
    rng = np.random.default_rng(seed)
    k = max(2, int(math.sqrt(total / PER_CELL)))
    h = sample.shape[1] // 2
    plain = Index((_kmeans(sample[:, :h], k, rng), _kmeans(sample[:, h:], k, rng)), 0.0)
    x = sample[rng.choice(len(sample), min(len(sample), 2000), replace=False)]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)

    def beyond(here: np.ndarray, there: np.ndarray) -> np.ndarray:
        own, other, at = plain.distances(here), plain.distances(there), np.arange(len(here))
        return sum(d[at, o.argmin(1)] - d.min(1) for d, o in zip(own, other))

    return Index(plain.words, float(np.quantile(np.minimum(beyond(x, y), beyond(y, x)), target)) + 1e-9)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(raw: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)


def _placed(indexes: dict[int, Index], kind: type):  # noqa: ANN202
    """Cells are numbered by length and place in its grid; vectors of a length without an index are in one cell."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            rows = batch.column(2).to_pylist()
            cells: list[list[int]] = [[]] * len(rows)
            for d in set(map(len, rows)):
                at = [k for k, x in enumerate(rows) if len(x) == d]
                found = indexes[d].visits(_unit(np.array([rows[k] for k in at], np.float64))) if d in indexes else [[0]] * len(at)
                for k, own in zip(at, found):
                    cells[k] = [(d << 32) + c for c in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c[0] for c in cells], pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array([np.array(r, kind).tobytes() for r in rows], pa.binary())], names=["id", "w", "home", "cells", "raw"])
        settle()

    return run


def _met(cosine: float, kind: type):  # noqa: ANN202
    """Block against block: (id, n) counts of links and (id, to) links that connect the same vectors."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            ids, counts, joined, to = [], [], [], []
            for same, p, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = (np.array([r["id"] for r in x], np.int64) for x in (p, m))
                link = _unit(_matrix([r["raw"] for r in p], kind)) @ _unit(_matrix([r["raw"] for r in m], kind)).T >= cosine
                link &= a[:, None] != b[None, :]
                rows, cols = link.any(1), link.any(0)
                if not rows.any():
                    continue
                wa, wb = (np.array([r["w"] for r in x], np.int64) for x in (p, m))
                n_a = link[rows] @ wb
                back = link[:, cols]
                if same != 1:  # who is found from both cells counts in its own visit
                    home = np.array([r["home"] for r in p])
                    back = back & ~np.array([np.isin(home, r["cells"]) for r, c in zip(m, cols) if c]).T
                n_b = wa @ back
                if same != 2:
                    ids += [a[rows], b[cols]]
                    counts += [n_a, n_b]
                else:  # a block against itself has every pair twice
                    ids.append(a[rows])
                    counts.append(n_a)
                u, v = _forest(link[np.ix_(rows, cols)], a[rows], b[cols])
                joined.append(u)
                to.append(v)
            if ids:
                u, v = np.concatenate(joined), np.concatenate(to)
                i, n = np.concatenate(ids), np.concatenate(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, u])), pa.array(np.concatenate([n, np.zeros(len(u), np.int64)])), pa.array([None] * len(i) + v.tolist(), pa.int64())], names=["id", "n", "to"])
        settle()

    return run


def _dealt(one: DataFrame, two: DataFrame, n: str, m: str) -> DataFrame:
    """one and two met by cell; n and m are their numbers of blocks there. The side of more blocks is dealt over keys, the other repeated."""
    keys = F.ceil(F.col(n) * F.col(m) / PAIRS)
    keys = F.least(keys, F.greatest(n, m))
    dealt = F.array(F.pmod("block", keys).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), keys.cast("long") - 1)
    left = one.withColumn("salt", F.explode(F.when(F.col(n) >= F.col(m), dealt).otherwise(every)))
    right = two.withColumn("salt", F.explode(F.when(F.col(n) >= F.col(m), every).otherwise(dealt)))
    right = right.select("cell", "salt", F.col("block").alias("other"), F.col("m").alias("p"))
    return left.select("cell", "salt", "block", "m").join(right, ["cell", "salt"])


def _forest(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector with the smallest id it reaches within the blocks."""
    la, lb, big = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(link, lb[None, :], big).min(1))
        nb = np.minimum(lb, np.where(link, na[:, None], big).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    u, v = np.concatenate([a, b]), np.concatenate([la, lb])
    return u[u != v], v[u != v]


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, target: float = TARGET) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of df.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths link with none of the others' length. Rows with a null key have no component and are not kept; they
    link with nothing. Rows that repeat a vector link with each other, whatever their keys. An empty table gives none; other columns are
    not read.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "embeddup")
    v = F.col(vector).cast("array<double>")
    kind = np.float32 if df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull) else np.float64  # floats travel as they are
    fine = F.col(key).isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(key).cast("long").alias("id"), F.when(fine, v).alias("v"))
    rows = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(1))))
    one = scratch(rows.filter(F.col("v").isNotNull()).groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v")))
    # The sample and the grid of each length; the lengths of a few vectors need none.
    lengths = {r["d"]: r["n"] for r in one.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST).collect()}
    every = max(1, sum(lengths.values()) // SAMPLE)
    sample = one.filter((F.pmod(F.col("h1"), F.lit(every)) == 0) & F.size("v").isin(list(lengths))).select("v").limit(2 * SAMPLE).toArrow().column("v").to_pylist() if lengths else []
    indexes = {d: fit(_unit(np.array(own, np.float64)), n, cosine, target) for d, n in lengths.items() if (own := [x for x in sample if len(x) == d])}
    placed = scratch(one.select("id", "w", "v").mapInArrow(_placed(indexes, kind), T.StructType([T.StructField("id", T.LongType()), T.StructField("w", T.LongType()), T.StructField("home", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("raw", T.BinaryType())])))
    there = placed.select(F.explode("cells").alias("cell"), "*").withColumn("guest", F.col("cell") != F.col("home"))
    blocks_of = lambda guest: F.ceil(F.count_if(F.col("guest") == guest) / BLOCK).cast("long")
    sizes = scratch(there.groupBy("cell").agg(blocks_of(False).alias("homes"), blocks_of(True).alias("guests")))
    there = there.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))))
    blocks = there.groupBy("cell", "guest", "block", "homes", "guests").agg(F.collect_list(F.struct("id", "w", "home", F.when(~F.col("guest"), F.col("cells")).alias("cells"), "raw")).alias("m"))
    blocks = scratch(blocks)
    home, guests = blocks.filter(~F.col("guest")), blocks.filter("guest")
    foreign = _dealt(home.filter("guests > 0"), guests.filter("homes > 0"), "homes", "guests").select(F.lit(0).alias("same"), "p", "m")
    within = _dealt(home, home, "homes", "homes").filter(F.col("block") <= F.col("other"))
    within = within.select(F.when(F.col("block") == F.col("other"), 2).otherwise(1).alias("same"), "p", "m")
    found = foreign.unionByName(within).mapInArrow(_met(cosine, kind), "id long, n long, to long")
    found = scratch(found)
    counts = found.filter(F.col("to").isNull()).groupBy("id").agg(F.sum("n").alias("n")).select(F.col("id").alias("rep"), "n")
    parts = components(found.filter(F.col("to").isNotNull()), "id", "to", scratch).select(F.col("node").alias("rep"), "component")
    classes = one.select("h1", "h2", F.col("id").alias("rep"), "w")
    out = rows.select("id", "h1", "h2").join(classes, ["h1", "h2"], "left").join(counts, "rep", "left").join(parts, "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return scratch.release(out.select(F.col("id").alias(key), (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")))
