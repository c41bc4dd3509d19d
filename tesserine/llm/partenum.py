"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word n-grams. Sizes fall into bands so that a set and any set similar to it lie in the same
or neighbouring bands; within a tag (a band and the next) similar sets differ in at most k elements. The feature domain
is hashed into n1 parts of three pieces each. With n1 = k//2 + 1 + spare, at least 1 + spare parts hold at most one
difference, and there two of the three pieces agree: of the three signatures that part gives, one for each
pair of pieces, similar sets share one. A signature of one item or none says little: thin ones are left out. Where no more than
`spare` parts of a set have one, one of its 1 + spare parts has none, and what is shared of
it is thick in both, so that similar sets still share a signature for certain. A set with more such parts is dealt anew by another hash and
has both dealings' thick signatures, until few enough parts are weak: with the set that stops first, all similar ones share one.
Only what is weak LEVELS times has its thin signatures too, at the last. In small sets, and where spare parts would be too many, thin means empty.

Signatures travel as packed blocks sorted by hash. Sets with one signature are paired with the smallest of
them, not with each other. Where that leaves a signature in several components, its sets are joined by prefix filter, so
no link is lost that could join two components. A signature that is frequent within one task is cut into chunks that go to other tasks; only the chunk's smallest goes on,
marked as a HEAD, so that whatever else has the signature joins the chunk's group.
Tests compare the sets whole. Equal sets stand for one another throughout.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.llm.common import Scratch, arrow_limits, settle
from tesserine.llm.components import components

#: Signatures that a task holds before it sends them on; copies of one signature therein beyond which they are a chunk of their own.
HELD, HOT = 300_000, 64
#: Items whose signatures are computed at a time, unless one set has more; pairs that a gathering task holds before it sends them on.
ITEMS, PAIRS = 1 << 18, 1 << 19
#: Cells of a set's sketch at most; sets of one signature, beyond its largest component, that are compared by sketch. More take the prefix filter.
CELLS, FEW = 4096, 32
#: Times that a set with too many weak parts is dealt into parts anew before its thin signatures are used.
LEVELS = 4
#: Cells of the table of items' weights, by which the prefix filter orders them: a byte each.
WEIGHTS = 1 << 24
#: Bits of a cell's number within the slice of that table that one task adds up.
SLICE = 18
#: Text bytes for each task that gathers signatures.
TASK_BYTES = 16 << 20
SPLITS = 16
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
META, TEST, GROUP, HEAD = 0, 1, 2, 3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that scatters them (SplitMix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)  # what a byte weighs
_BASE = np.uint64(0x9E6C63D0876A9A55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: Bytes that are hashed at a time.
SPAN = 1 << 18


class Powers:
    """Powers of the base and of its inverse, as far as they are needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(max(n, 2 * len(self.up)), _BASE)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = _INVERSE
            self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


def word_hashes(raw: bytes, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each word between blanks, in order: a polynomial over its bytes, mixed with its length."""
    b = np.frombuffer(raw, np.uint8)
    blank = _BLANK[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    begin, end = edge[::2], edge[1::2]
    up, down = powers.of(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LETTERS[b] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _GOLD)


def shingles(text: str | None, powers: Powers, n: int = 4) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of words, A-Z lower-cased; of the whole sequence if it is shorter."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + SPAN)
        while to < len(raw) and not _BLANK[raw[to]]:  # a word stays in one span
            to += 1
        parts.append(word_hashes(raw[at:to], powers))
        at = to
    h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * _GOLD + h[k : k + len(out)])
    return np.unique(out)


def weak_share(items: float, least: int = 2) -> float:
    """How often two of three pieces together hold fewer than `least` items, one or two, of pieces with so many items on average."""
    none, one = math.exp(-items), items * math.exp(-items)
    empty = 3 * none * none * (1 - none) + none**3
    return empty + (3 * none * ((1 - none) ** 2 - (1 - none - one) ** 2) if least == 2 else 0)


class Scheme:
    """Bands and parts for a similarity of num/den."""

    def __init__(self, num: int = 85, den: int = 100):
        self.num, self.den = num, den
        self.low, self.high = [0], [0]
        self.shapes: dict[int, tuple[int, int, int]] = {}

    def band(self, sizes: np.ndarray) -> np.ndarray:
        while self.high[-1] < (int(sizes.max()) if len(sizes) else 0):
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], self.low[-1] * self.den // self.num))
        return np.searchsorted(np.array(self.high), sizes)

    def parts(self, tag: int) -> tuple[int, int, int]:
        """n1, spare and least of a tag; n1 is 0 where only equal sets are similar. Signatures of fewer items than `least` are thin."""
        if tag not in self.shapes:
            a = self.high[tag]
            b = a * self.den // self.num
            k = (self.den - self.num) * (a + b) // (self.den + self.num)
            base = k // 2 + 1
            shape = (base + (0 if base <= 2 else 1 if base <= 12 else 2), 0 if base <= 2 else 1 if base <= 12 else 2, 1)
            for spare, least in [(s, n) for n in (2, 1) for s in range(2, base // 4 + 1)]:  # enough spare parts for the weak ones that chance makes
                weak = (base + spare) * weak_share(self.low[tag] / (3 * (base + spare)), least)
                if spare >= weak + 2.3 * math.sqrt(weak):
                    shape = (base + spare, spare, least)
                    break
            self.shapes[tag] = shape if k else (0, 0, 1)
        return self.shapes[tag]

    def signatures(self, sets: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, id) for sets that are not empty, a bounded number of items at a time."""
        part = np.cumsum([len(x) for x in sets]) // ITEMS
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sets)]
        found = [self._signatures(sets[a:b], ids[a:b]) for a, b in zip(cut, cut[1:])]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _signatures(self, sets: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in sets])
        bands, all_sigs, all_ids = self.band(sizes), [np.empty(0, np.uint64)], [ids[:0]]
        for step in (0, 1):
            tags = bands - step
            shape = {t: self.parts(t) for t in set(tags.tolist()) if t > 0}
            shapes = np.array([shape.get(t, (0, 0, 1)) for t in tags.tolist()], np.int64).reshape(-1, 3)
            todo = np.flatnonzero(shapes[:, 0])
            for level in range(LEVELS):
                if not len(todo):
                    break
                n1, spare, least = shapes[todo].T
                begin = np.concatenate([[0], np.cumsum(n1)])
                f = np.concatenate([sets[i] for i in todo.tolist()])
                f = mix(f + np.full(1, level, np.uint64) * _M1) if level else f
                g = mix(f + _GOLD)
                doc = np.repeat(np.arange(len(todo)), sizes[todo])
                part = begin[doc] + ((f >> np.uint64(33)) % n1[doc].astype(np.uint64)).astype(np.int64)
                piece = part * 3 + (g % np.uint64(3)).astype(np.int64)
                sums = np.zeros(begin[-1] * 3, np.uint64)
                np.add.at(sums, piece, g)
                held = np.bincount(piece, minlength=begin[-1] * 3).reshape(-1, 3)
                sums = mix(sums).reshape(-1, 3)
                of = np.repeat(np.arange(len(todo)), n1)
                index = np.arange(begin[-1]) - begin[of]
                fewest = held.sum(axis=1) - held.max(axis=1)  # of the part's three signatures, the thinnest one's items
                tight = np.bincount(of, fewest < least[of], minlength=len(todo)).astype(np.int64) > spare
                whole = tight[of] & (level == LEVELS - 1)
                head = mix(tags[todo[of]].astype(np.uint64) * np.uint64(1_000_003) + index.astype(np.uint64) + (np.uint64(level) << np.uint64(56)))
                for x, (y, z) in enumerate(((1, 2), (0, 2), (0, 1))):
                    keep = (held[:, y] + held[:, z] >= least[of]) | whole
                    sig = mix(mix(head + np.uint64(x) + sums[:, y]) + sums[:, z])
                    all_sigs.append(sig[keep])
                    all_ids.append(ids[todo[of[keep]]])
                todo = todo[tight]
        return np.concatenate(all_sigs), np.concatenate(all_ids)


def pack(ids: np.ndarray) -> bytes:
    """Eight planes of bytes: the high ones, nearly all zero, compress to almost nothing."""
    return ids.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).view(np.int64).ravel()


_BLOCK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())])
_FOUND = T.StructType([T.StructField("kind", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in "abcd"], T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def _blocks(num: int, den: int, width: int, buckets: int):  # noqa: ANN202
    """The task that reads texts and sends sets' hashes (META), hot chunks (GROUP), their smallest (HEAD) and other signatures (TEST)."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        known, scheme = Powers(), Scheme(num, den)
        turn = np.random.default_rng(7)

        def send(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=_BLOCK.names)

        def flush(sigs: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = []
            order = np.lexsort((ids, sigs))
            sigs, ids = sigs[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
            count = np.diff(np.concatenate([first, [len(sigs)]]))
            hot = np.flatnonzero(count > HOT)
            keep = np.ones(len(sigs), bool)
            heads = sigs[first[hot]], ids[first[hot]]
            for h in hot.tolist():
                at, to = int(first[h]), int(first[h] + count[h])
                keep[at:to] = False
                rows.append((int(turn.integers(buckets)), GROUP, to - at, sigs[at : at + 1].tobytes() + pack(ids[at:to])))
                if len(rows) >= 200:
                    yield send(rows)
                    rows = []
            for kind, (sigs, ids) in ((HEAD, heads), (TEST, (sigs[keep], ids[keep]))):
                own = _bucket(sigs, buckets)
                cut = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(sigs)] if len(sigs) else []
                for at, to in zip(cut, cut[1:]):
                    rows.append((int(own[at]), kind, to - at, sigs[at:to].tobytes() + pack(ids[at:to])))
                    if len(rows) >= 2000:
                        yield send(rows)
                        rows = []
            if rows:
                yield send(rows)

        held, n = [], 0
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            sets = [shingles(x, known, width) for x in batch.column(1).to_pylist()]
            rows = []
            for part in np.array_split(np.arange(len(ids)), max(1, len(ids) // 128)):
                own, full = np.array(ids[part], np.int64), [sets[i] for i in part]
                marks = [np.array([set_hash(x, seed) for x in full], np.uint64) for seed in (1, 2)]
                drawn = [sketch(x) for x in full]
                sizes = np.array([len(x) for x in full], np.int64)
                if len(part):
                    to = int(turn.integers(buckets))
                    rows.append((to, META, len(part), b"".join([pack(own), sizes.tobytes(), *(x.tobytes() for x in marks), np.cumsum([len(x) for x in drawn]).astype(np.int64).tobytes(), *drawn])))
            if rows:
                yield send(rows)
            some = [i for i in range(len(ids)) if len(sets[i])]
            if some:
                s, d = scheme.signatures([sets[i] for i in some], np.array([ids[i] for i in some], np.int64))
                held.append((s, d))
                n += len(s)
            if n >= HELD:
                yield from flush(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from flush(*map(np.concatenate, zip(*held)))
        del held, known
        settle()

    return run


def _bucket(sigs: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each signature, by its high bits: in the order of signatures."""
    return (((sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def sketch(x: np.ndarray) -> bytes:
    """How many items fall into each cell, 255 at most; about four a cell. The differences of two sketches add up to no more than those of the sets."""
    if not len(x):
        return b""
    cells = min(CELLS, 1 << max(3, (len(x) // 4).bit_length()))
    return np.minimum(np.bincount((mix(x ^ _GOLD) & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least so many items are in one of two sets only, for rows of sketches of one or two widths."""
    while a.shape[-1] > b.shape[-1]:
        a = a[..., : a.shape[-1] // 2] + a[..., a.shape[-1] // 2 :]
    while b.shape[-1] > a.shape[-1]:
        b = b[..., : b.shape[-1] // 2] + b[..., b.shape[-1] // 2 :]
    return np.abs(a - b).sum(axis=-1)


def set_hash(x: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix(x + np.uint64(seed) * _GOLD).sum(dtype=np.uint64))


def _gather(batches):  # noqa: ANN001, ANN202
    """The task that has all signatures of its buckets, one bucket after the other: tests and groups from them, and the sets' hashes as rows."""
    import pyarrow as pa

    def rows(kind: int, *cols, docs=None, drawn=None) -> pa.RecordBatch:  # noqa: ANN001
        n = len(cols[0])
        full = [pa.array(np.asarray(c).astype(np.int64), pa.int64()) for c in cols] + [pa.nulls(n, pa.int64())] * (4 - len(cols))
        lists = pa.nulls(n, pa.list_(pa.int64())) if docs is None else docs if isinstance(docs, pa.Array) else pa.array(docs, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *full, lists, pa.nulls(n, pa.binary()) if drawn is None else pa.array(drawn, pa.binary())], names=_FOUND.names)

    def tests(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = _added(pairs)
        for at in range(0, len(found), 50_000):
            yield rows(TEST, *found[at : at + 50_000].T)

    def met(sigs: list[np.ndarray], ids: list[np.ndarray], heads: list[np.ndarray], pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A bucket's groups; its tests go to pairs."""
        s, d = np.concatenate(sigs), np.concatenate(ids)
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        again = np.concatenate([[False], (s[1:] == s[:-1]) & (d[1:] == d[:-1])])
        s, d = s[~again], d[~again]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.concatenate([first, [len(s)]]))
        many = count > 1
        pivot = np.repeat(d[first], count)
        later = np.repeat(many, count)
        later[first] = False
        pairs.append(np.stack([pivot[later], d[later], np.ones(later.sum(), np.int64)], axis=1))
        big = np.flatnonzero((count > 2) | (many & np.isin(s[first], np.concatenate(heads)) if heads else False))  # one document beside a chunk is of its group
        for at in range(0, len(big), 5000):
            part = big[at : at + 5000]
            inside = np.zeros(len(first), bool)
            inside[part] = True
            ends = np.concatenate([[0], np.cumsum(count[part])]).astype(np.int32)
            yield rows(GROUP, s[first[part]].view(np.int64), docs=pa.ListArray.from_arrays(pa.array(ends), pa.array(d[np.repeat(inside, count)])))

    now, sigs, ids, pairs, heads = None, [], [], [], []
    for batch in batches:
        for bucket, kind, n, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if bucket != now and sigs:
                yield from met(sigs, ids, heads, pairs)
                sigs, ids, heads = [], [], []
            now = bucket
            if kind == META:
                rest = np.frombuffer(data, np.int64, 4 * n, offset=8 * n).reshape(4, n)
                ends = [40 * n, *(40 * n + rest[3]).tolist()]
                yield rows(META, unpack(data, n), *rest[:3], drawn=[data[x:y] for x, y in zip(ends, ends[1:])])
            elif kind == GROUP:
                own = np.unique(unpack(data[8:], n))
                yield rows(GROUP, np.frombuffer(data, np.uint64, 1).view(np.int64), docs=[own.tolist()])
                if len(own) > 1:
                    pairs.append(np.stack([np.full(len(own) - 1, own[0]), own[1:], np.ones(len(own) - 1, np.int64)], axis=1))
            else:
                sigs.append(np.frombuffer(data, np.uint64, n))
                ids.append(unpack(data[8 * n :], n))
                if kind == HEAD:
                    heads.append(sigs[-1])
            if len(pairs) > 512:
                pairs = [_added(pairs)]
                if len(pairs[0]) > PAIRS:
                    yield from tests(pairs)
                    pairs = []
    if sigs:
        yield from met(sigs, ids, heads, pairs)
    if pairs:
        yield from tests(pairs)
    del sigs, ids, pairs
    settle()


def _added(pairs: list[np.ndarray]) -> np.ndarray:
    """(a, b, how often) for each pair once."""
    rows = np.concatenate(pairs)
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
    return np.column_stack([rows[first, :2], np.add.reduceat(rows[:, 2], first)])


def _sets(width: int):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        known = Powers()
        for batch in batches:
            sets = [shingles(x, known, width).view(np.int64) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), items], names=["id", "items"])
            del sets, items
        settle()

    return run


def _compare(num: int, den: int):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        last, own = None, np.empty(0, np.int64)
        for batch in batches:
            a, linked = batch.column(0).to_pylist(), []
            (xs, xo), (ys, yo) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            for k in range(len(a)):
                if last != a[k]:
                    last, own = a[k], xs[xo[k] : xo[k + 1]].copy()
                other = ys[yo[k] : yo[k + 1]]
                both = len(np.intersect1d(own, other, assume_unique=True))
                linked.append(den * both >= num * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
            del xs, ys
        settle()

    return run


def _sketched(num: int, den: int):  # noqa: ANN202
    """The pairs (a, b, c) whose sketches leave open that they are similar."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint8).astype(np.int32) for v in batch.column(k).to_pylist()] for k in (4, 6))
            n = batch.column(3).to_numpy() + batch.column(5).to_numpy()
            able = pa.array([(den + num) * int(apart(p, q)) <= (den - num) * t for p, q, t in zip(x, y, n.tolist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)], names=["a", "b", "c"]).filter(able)
        settle()

    return run


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, c) that may link by their sizes and sketches."""
    left, right = (sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    met = pairs.join(left, "a").join(right, "b").filter(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    return met.select("a", "b", "c", "na", "sa", "nb", "sb").mapInArrow(_sketched(num, den), "a long, b long, c long")


def _among(num: int, den: int):  # noqa: ANN202
    """The pairs (a, b) of each group's sets in different components whose sketches leave open that they are similar, from rows of (some of the
    group's largest component, all beyond it): as many comparisons as the product of the two. Those beyond are compared with each other where they are alone."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            one, two = [], []
            for inside, beyond in zip(*(batch.column(k).to_pylist() for k in range(2))):
                group = [*inside, *beyond]
                ids, n, part = (np.array([r[c] for r in group], np.int64) for c in ("y", "n", "part"))
                drawn = [np.frombuffer(r["sketch"], np.uint8).astype(np.int32) for r in group]
                cells, outer = np.array([len(x) for x in drawn]), np.arange(len(group)) >= len(inside)
                met = ~outer if inside else outer  # whom those beyond are compared with
                for width in np.unique(cells).tolist():  # the narrower one's
                    wider = np.flatnonzero(cells >= width)
                    wide = np.stack([x.reshape(-1, width).sum(axis=0) for x in (drawn[i] for i in wider)])
                    for at in np.flatnonzero(outer[wider]).tolist():
                        i = wider[at]
                        able = met[wider] & (part[wider] != part[i])
                        able = np.flatnonzero(able if cells[i] == width else able & (cells[wider] == width))
                        far = np.abs(wide[able] - wide[at]).sum(axis=1)
                        found = wider[able[(den + num) * far <= (den - num) * (n[i] + n[wider[able]])]]
                        one.append(np.minimum(ids[i], ids[found]))
                        two.append(np.maximum(ids[i], ids[found]))
            a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (one, two))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        settle()

    return run


def _cells(size: int):  # noqa: ANN202
    """How many items fall into each of `size` cells, as blocks (slice, n, n cells and n counts) of a bounded number of items each."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        def flush(items: list[np.ndarray]) -> pa.RecordBatch:
            cells, counts = np.unique(np.concatenate(items) & (size - 1), return_counts=True)
            own = cells >> SLICE
            first = np.flatnonzero(np.diff(own, prepend=-1))
            blocks = [(int(own[at]), to - at, pack(cells[at:to]) + pack(counts[at:to])) for at, to in zip(first.tolist(), [*first[1:].tolist(), len(cells)])]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*blocks), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "n", "data"])

        held = []
        for batch in batches:
            held.append(batch.column(1).flatten().to_numpy())
            if sum(map(len, held)) > ITEMS:
                yield flush(held)
                held = []
        if sum(map(len, held)):
            yield flush(held)
        settle()

    return run


def _weigh(size: int):  # noqa: ANN202
    """Each slice's weights, a byte for each cell, compressed, from its blocks, which come together."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        def weights(own: int, sums: np.ndarray) -> pa.RecordBatch:
            found = np.minimum(255, np.floor(8 * np.log2(np.maximum(sums, 1)))).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([zlib.compress(found.tobytes())], pa.binary())], names=["bucket", "data"])

        now, sums = None, np.zeros(min(size, 1 << SLICE), np.int64)
        for batch in batches:
            for bucket, n, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket != now:
                    if now is not None:
                        yield weights(now, sums)
                    now, sums[:] = bucket, 0
                sums[unpack(data, n) & (len(sums) - 1)] += unpack(data[8 * n :], n)
        if now is not None:
            yield weights(now, sums)
        settle()

    return run


def _weights(sets: DataFrame) -> np.ndarray:
    """What each cell of items weighs: 0 if it holds one occurrence at most, else more the more it holds, by eighths of powers of two.

    The table has WEIGHTS bytes whatever the number of items, and comes to the driver in slices. Items are counted where they are read.
    """
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = sets.mapInArrow(_cells(WEIGHTS), "bucket int, n int, data binary")
    found = counts.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_weigh(WEIGHTS), "bucket int, data binary").toArrow()
    table = np.zeros(WEIGHTS, np.uint8)
    for own, data in zip(found.column("bucket").to_pylist(), found.column("data").to_pylist()):
        part = np.frombuffer(zlib.decompress(data), np.uint8)
        table[own << SLICE : (own << SLICE) + len(part)] = part
    return table


def _heads(table: np.ndarray, num: int, den: int):  # noqa: ANN202
    """Each set's size and the items, with their ranks, of which a similar set holds one; no row if too few items can be in another set.

    Items are in order of weight, then of hash; items of weight 0 are in no other set and come first.
    """

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            items, ends = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            own, sizes, found, ranks = [], [], [], []
            for k, name in enumerate(batch.column(0).to_pylist()):
                x = items[ends[k] : ends[k + 1]]
                n, weight = len(x), table[x & (len(table) - 1)]
                x, weight = x[weight > 0], weight[weight > 0]
                if den * len(x) < num * n:
                    continue
                most = (den - num) * n // den + 1 - (n - len(x))
                own.append(name)
                sizes.append(n)
                found.append(x[np.lexsort((x, weight))][: max(0, most)])
                ranks.append(n - len(x) + 1 + np.arange(len(found[-1])))
            cut = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            flat = [pa.array(np.concatenate([np.empty(0, np.int64), *c]), pa.int64()) for c in (found, ranks)]
            head = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays(flat, names=["item", "rank"]))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(sizes, pa.int64()), head], names=["id", "n", "head"])
        settle()

    return run


def _heads_blocks(buckets: int):  # noqa: ANN202
    """From rows (id, n, part, head): blocks (bucket, n, columns item, id, part, size and rank) of the heads' items, a bounded number at a time."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(cols, axis=1)
            own = _bucket(rows[0].view(np.uint64), buckets)
            order = np.argsort(own, kind="stable")
            rows, own = rows[:, order], own[order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            blocks = [(int(own[at]), to - at, b"".join(pack(c[at:to]) for c in rows)) for at, to in zip(first.tolist(), [*first[1:].tolist(), len(own)])]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*blocks), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "n", "data"])

        held, n = [], 0
        for batch in batches:
            head = batch.column(3)
            count = np.diff(head.offsets.to_numpy())
            flat = head.flatten()
            mine = [np.repeat(batch.column(k).to_numpy(), count) for k in (0, 2, 1)]
            held.append(np.stack([flat.field(0).to_numpy(), *mine, flat.field(1).to_numpy()]).astype(np.int64))
            n += held[-1].shape[1]
            if n > HELD:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)
        settle()

    return run


def _meet(num: int, den: int):  # noqa: ANN202
    """The pairs (a, b) of sets in different components that share an item of their heads, where their sizes and the item's ranks leave open
    that they are similar; from the heads' blocks, one bucket after the other. An item's sets beyond its largest component are compared with
    those of its other components that are of such a size."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        def tests(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found = _added(pairs)
            for at in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 50_000, k]) for k in range(2)], names=["a", "b"])

        def met(blocks: list[np.ndarray]) -> Iterator[np.ndarray]:
            rows = np.concatenate(blocks, axis=1)
            item, own, part, n, rank = rows[:, np.lexsort((rows[3], rows[0]))]
            of = np.cumsum(np.concatenate([[False], item[1:] != item[:-1]]))
            kinds, part = np.unique(part, return_inverse=True)
            held, count = np.unique(of * len(kinds) + part, return_counts=True)
            order = np.lexsort((count, held // len(kinds)))
            main = (held % len(kinds))[order][np.flatnonzero(np.diff(held[order] // len(kinds), append=-1))]
            outer = np.flatnonzero(part != main[of])
            span = n.max() + 1  # an item's sets, ordered by size, take so many numbers
            key = of * span + n
            low = np.searchsorted(key, of[outer] * span - (-num * n[outer] // den))
            high = np.searchsorted(key, of[outer] * span + np.minimum(span - 1, den * n[outer] // num), "right")
            step = np.cumsum(high - low) // PAIRS
            cut = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(outer)]
            for x, y in zip(cut, cut[1:]):
                many = high[x:y] - low[x:y]
                a = np.repeat(outer[x:y], many)
                b = np.arange(len(a)) + np.repeat(low[x:y] - np.cumsum(many) + many, many)
                on = (part[a] != part[b]) & ((a < b) | (part[b] == main[of[b]]))
                a, b = a[on], b[on]
                most = 1 + np.minimum(n[a] - rank[a], n[b] - rank[b])
                near = den * most >= num * (n[a] + n[b] - most)
                a, b = own[a[near]], own[b[near]]
                yield _added([np.stack([np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64)], axis=1)])

        now, blocks, pairs, many = None, [], [], 0
        for bucket, n, data in itertools.chain((x for batch in batches for x in zip(*(batch.column(k).to_pylist() for k in range(3)))), [(-1, 0, b"")]):
            if bucket != now and blocks:
                for found in met(blocks):
                    pairs.append(found)
                    many += len(found)
                    if many > PAIRS:
                        yield from tests(pairs)
                        pairs, many = [], 0
                blocks = []
            now = bucket
            if n:
                blocks.append(np.stack([unpack(data[8 * n * k : 8 * n * (k + 1)], n) for k in range(5)]))
        if pairs:
            yield from tests(pairs)
        settle()

    return run


def _all_links(tests: DataFrame, groups: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, tasks: int, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect whatever is similar. tests: (a, b, c), c the signatures shared; groups: (sig, y); sketches: (id, n, sketch).

    Pairs whose sketches differ too much are dropped. Of the rest, each document is first tested against the one it shares most
    signatures with; then only what lies in different components matters. Where a signature spans components, its documents
    beyond the largest one are compared by sketch with each other and, block by block, with those of the largest, if they are few. If they are
    many, the signatures' documents are tested that pass a positional prefix filter: with items in order of
    weight (their cell's frequency; any order that is the same for all sets is right), the first one that similar sets share stands early in both. So no link is lost that could join two components.
    """
    def sets_of(ids: DataFrame) -> DataFrame:
        return docs.hint("merge").join(ids.distinct(), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(width), "id long, items array<long>")

    def judged(found: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        sets, path = scratch.write(sets_of(found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id")))))
        left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        met = found.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y")
        out = scratch(met.mapInArrow(_compare(num, den), "a long, b long, linked boolean").filter("linked").select("a", "b"))
        scratch.drop(path)
        return out

    def placed(d: DataFrame, c: str, to: str = "part") -> DataFrame:
        own = parts.select(F.col("node").alias(c), F.col("component").alias("_part"))
        return d.join(own, c, "left").withColumn(to, F.coalesce("_part", c)).drop("_part")

    def spanning(d: DataFrame) -> DataFrame:
        """The rows (sig, y, part) of signatures that lie in several components, with the signature's largest component and how many rows are in it and beyond it."""
        sizes = d.groupBy("sig", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("sig").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all"))
        sizes = sizes.filter(F.col("all") > F.col("top.n")).select("sig", F.col("top.part").alias("main"), F.col("top.n").alias("inside"), (F.col("all") - F.col("top.n")).alias("beyond"))
        return d.join(sizes, "sig")

    able = scratch(_possible(tests, sketches, num, den))
    best = scratch(able.groupBy("b").agg(F.max(F.struct("c", "a"))["a"].alias("a")).select("a", "b"))
    links = judged(best)
    parts = components(links, "a", "b", scratch)
    waiting = able.select("a", "b").join(best, ["a", "b"], "left_anti")
    waiting = scratch(placed(placed(waiting, "a", "pa"), "b", "pb").filter("pa <> pb").select("a", "b"))
    links = scratch(links.unionByName(judged(waiting)))
    parts = components(links, "a", "b", scratch)

    around = scratch(spanning(placed(groups, "y")))
    drawn = sketches.select(F.col("id").alias("y"), "n", "sketch")
    few = around.filter(F.col("beyond") <= FEW).join(drawn, "y").withColumn("row", F.struct("y", "n", "part", "sketch"))
    beyond = few.filter(F.col("part") != F.col("main")).groupBy("sig").agg(F.collect_list("row").alias("o"))
    block = F.pmod(F.xxhash64("y"), F.ceil(F.col("inside") / FEW).cast("long"))
    inside = few.filter(F.col("part") == F.col("main")).withColumn("block", block).groupBy("sig", "block").agg(F.collect_list("row").alias("m"))
    alone = beyond.select(F.array().cast(inside.schema["m"].dataType).alias("m"), "o")
    left = scratch(inside.join(beyond, "sig").select("m", "o").unionByName(alone).mapInArrow(_among(num, den), "a long, b long").distinct())

    many = around.filter(F.col("beyond") > FEW).select("sig", "y", "part")
    if not many.isEmpty():
        sets, sets_path = scratch.write(sets_of(many.select(F.col("y").alias("id"))))
        ranked = scratch(sets.mapInArrow(_heads(_weights(sets), num, den), "id long, n long, head array<struct<item: long, rank: long>>"))
        scratch.drop(sets_path)
        many = scratch(spanning(many.join(ranked.select(F.col("id").alias("y")), "y", "left_semi")).select("sig", "y", "part"))
        part_of = many.select(F.col("y").alias("id"), "part").distinct()
        blocks = ranked.join(part_of, "id").select("id", "n", "part", "head").mapInArrow(_heads_blocks(tasks * SPLITS), "bucket int, n int, data binary")
        met = blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(num, den), "a long, b long").distinct().withColumn("c", F.lit(1).cast("long"))
        left = scratch(left.unionByName(_possible(met, sketches, num, den).select("a", "b")).distinct())
    last = scratch(left.join(best.unionByName(waiting), ["a", "b"], "left_anti"))
    return scratch(links.unionByName(judged(last)))


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", num: int = 85, den: int = 100, width: int = 4) -> DataFrame:
    """(key, n_shingles, component_id) for every row of df; documents link whose sets have a Jaccard similarity of num/den or
    more.

    Null texts and texts without words have the empty set and link with nothing. Rows with a null key are returned with a null
    component. Rows that repeat a key are one document for links; each row shows the size of its own set. An empty table gives none.
    Other columns are not read. The key is an integer.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "partenum")
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    blocks = docs.filter(F.col("id").isNotNull()).mapInArrow(_blocks(num, den, width, tasks * SPLITS), _BLOCK)
    found = scratch(blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_gather, _FOUND))

    meta = found.filter(F.col("kind") == META).select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("c").alias("h1"), F.col("d").alias("h2"))
    sketches = found.filter((F.col("kind") == META) & (F.col("b") > 0)).select(F.col("a").alias("id"), F.col("b").alias("n"), "sketch").dropDuplicates(["id"])
    first = meta.filter(F.col("n") > 0).groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    first = scratch(first)  # written, so that the join has a shuffle on both sides and AQE can split a large group of copies
    meta = scratch(meta.join(first, ["n", "h1", "h2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    one = meta.filter(F.col("n") > 0)

    # Tests between representatives, each once.
    a, b = (one.select(F.col("id").alias(c), F.col("rep").alias(f"r{c}")) for c in "ab")
    tests = found.filter(F.col("kind") == TEST).groupBy("a", "b").agg(F.sum("c").alias("c")).join(a, "a").join(b, "b").filter(F.col("ra") != F.col("rb"))
    tests = scratch(tests.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "c").groupBy("a", "b").agg(F.max("c").alias("c")))
    groups = found.filter(F.col("kind") == GROUP).select(F.col("a").alias("sig"), F.explode("docs").alias("id"))
    groups = groups.join(one.select("id", "rep").distinct(), "id").select("sig", F.col("rep").alias("y")).distinct()
    links = _all_links(tests, groups, sketches, docs, width, tasks, scratch, num, den)

    parts = components(links, "a", "b", scratch).select(F.col("node").alias("rep"), "component")
    rows = meta.join(parts, "rep", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    bare = docs.filter(F.col("id").isNull()).mapInArrow(_sets(width), "id long, items array<long>")
    return scratch.release(rows.unionByName(bare.select(F.col("id").alias(key), F.size("items").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))))
