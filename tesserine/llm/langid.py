"""Language identification by Bayesian evidence fusion.

log P(language | all) = log P(text | language) + log P(declared | language) + log P(suffix | language) + log P(language | host)

Text: naive Bayes over hashed byte trigrams of the whole lower-cased text, fitted on a bounded sample of each label's rows; the
sum counts as at most STRENGTH trigrams, since neighbours are not independent. Declared language and address
suffix: how often each value comes with each language the texts alone show, by grouped aggregation over all rows. Host: counts
of the same kind, smoothed towards the host's domain and that towards the whole.

A row is rejected (`und`) without a letter, or when no language explains its text better than chance does, every trigram
being as likely as any other, or when no language reaches MOST.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.llm.common import Scratch, arrow_limits, text_of

#: Rows of each label that the text model is fitted on, at least, where there are so many, and about twice that at most; chosen by a hash of the key.
SAMPLE = 4000
BITS = 15
STRENGTH, KAPPA, MOST = 60.0, 20.0, 0.5
#: Texts of fewer trigrams count for no other row, and are not measured against chance.
FEW = 20
#: The mean log-likelihood of trigrams by chance.
CHANCE = -BITS * float(np.log(2))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # trigram x language, log-probabilities


#: The bytes of letters, in lower case, and the blank. Trigrams with digits or signs tell no language.
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[128:] = _LETTERS[32] = True


def grams(text: str | None) -> np.ndarray:
    """The hashed byte trigrams of the whole text that hold letters and blanks only."""
    a = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(a) < 3:
        return np.empty(0, np.uint32)
    ok = _LETTERS[a]
    ok = ok[:-2] & ok[1:-1] & ok[2:]
    a = a.astype(np.uint32)
    return (((a[:-2][ok] << np.uint32(16)) | (a[1:-1][ok] << np.uint32(8)) | a[2:][ok]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """The text model from about `sample` rows of each label, or all if there are fewer; those rows' whole texts. So every label
    that has a text of a trigram is a language, however rare it is. Without any labelled row there is no language."""
    import pyarrow as pa

    spark = df.sparkSession
    arrow_limits(spark)
    known = df.select(F.col(label).cast("string").alias("l"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(key), F.lit(5)).alias("h"))
    known = known.filter(F.col("l").isNotNull() & (F.octet_length("t") >= 3))
    # The row of the lowest hash is always in: what the share of a label leaves is never nothing.
    share = known.groupBy("l").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / sample)).alias("every"), F.min("h").alias("low"))
    chosen = known.join(F.broadcast(share.withColumnRenamed("l", "_l")), F.col("l") == F.col("_l")).filter((F.pmod("h", "every") == 0) | (F.col("h") == F.col("low"))).select("l", "t")

    def count(batches):  # noqa: ANN001, ANN202
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                own += np.bincount(grams(x), minlength=1 << BITS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["l", "gram", "n"])

    rows = chosen.mapInArrow(count, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(set(rows.column("l").to_pylist())))
    counts = np.full((1 << BITS, len(languages)), 0.5)
    place = {x: i for i, x in enumerate(languages)}
    if languages:
        np.add.at(counts, (rows.column("gram").to_numpy(), [place[x] for x in rows.column("l").to_pylist()]), rows.column("n").to_numpy())
    return Model(languages, np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32))


def text_scores(df: DataFrame, model: Model, text: str = "_text") -> DataFrame:
    """df without the text, with `_n` trigrams and `_ll`, the mean log-likelihood under each language: 0 without trigrams, null without letters."""
    import pyarrow as pa

    spark = df.sparkSession
    arrow_limits(spark)
    held = spark.sparkContext.broadcast(model.table)
    rest = [c for c in df.columns if c != text]

    def run(batches):  # noqa: ANN001, ANN202
        table = held.value
        for batch in batches:
            sizes, lls = [], []
            for x in batch.column(len(rest)).to_pylist():
                g = grams(x)
                sizes.append(len(g))
                lls.append(table[g].mean(axis=0, dtype=np.float64).tolist() if len(g) else [0.0] * table.shape[1] if any(map(str.isalpha, x)) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(sizes, pa.int64()), pa.array(lls, pa.list_(pa.float64()))], names=[*rest, "_n", "_ll"])

    return df.select(*rest, text).mapInArrow(run, df.select(*rest).schema.add("_n", "long").add("_ll", T.ArrayType(T.DoubleType())))


def _likelihood(rows: DataFrame, value: str, languages: tuple[str, ...], totals: dict[str, int], scratch: Scratch) -> DataFrame:
    """(value, log P(value | language) as an array) for each value there is."""
    seen = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(*[F.count_if(F.col("_best") == x).alias(f"_n{i}") for i, x in enumerate(languages)])
    logs = F.array(*[F.log((F.col(f"_n{i}") + 1.0) / F.lit(totals.get(x, 0) + 10.0)) for i, x in enumerate(languages)])
    return scratch(seen.select(F.col(value).alias(f"_of{value}"), logs.alias(f"_log{value}")))


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, domain: Column | None = None) -> DataFrame:
    """(key, language, confidence, kept) for every row of df.

    Evidence that is null says nothing. Null texts, and texts without a letter, are rejected; texts with too few for a trigram go by the other evidence. Everything is rejected if the model has no language. Repeated
    rows give repeated results, an empty table none; other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "langid")
    langs = model.languages
    none = F.lit(None).cast("string")
    evidence = {"_declared": declared, "_suffix": suffix, "_host": host, "_domain": domain if domain is not None else host}
    rows = df.select(F.col(key).alias("_key"), *[(c if c is not None else none).cast("string").alias(n) for n, c in evidence.items()], text_of(text).alias("_text"))
    if not langs:
        return rows.select(F.col("_key").alias(key), F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    rows = scratch(text_scores(rows, model))
    names = F.array(*[F.lit(x) for x in langs])
    top = F.array_max("_ll")
    rows = rows.withColumn("_top", top).withColumn("_best", F.when(F.col("_n") >= FEW, F.get(names, (F.array_position("_ll", F.col("_top")) - 1).cast("int"))))
    totals = {r["_best"]: r["count"] for r in rows.groupBy("_best").count().collect() if r["_best"] is not None}
    n = sum(totals.values())
    base = [(totals.get(x, 0) + 1.0) / (n + len(langs)) for x in langs]

    at = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    score = [F.get("_ll", F.lit(i)) * F.least(F.col("_n").cast("double"), F.lit(STRENGTH)) for i in range(len(langs))]
    for value, own in (("_declared", declared), ("_suffix", suffix)):
        if own is not None:
            table = _likelihood(rows, value, langs, totals, scratch)
            rows = rows.join(table, F.col(value) == F.col(f"_of{value}"), "left")
            score = [s + at(f"_log{value}", i) for i, s in enumerate(score)]
    if host is not None:
        counts = lambda c: rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("_best").alias("_all"), *[F.count_if(F.col("_best") == x).alias(f"_c{i}") for i, x in enumerate(langs)])
        wide = scratch(counts("_domain").select(F.col("_domain").alias("_d"), F.array(*[(F.col(f"_c{i}") + KAPPA * b) / (F.col("_all") + KAPPA) for i, b in enumerate(base)]).alias("_dp")))
        near = rows.groupBy("_host", "_domain").agg(F.count("_best").alias("_all"), *[F.count_if(F.col("_best") == x).alias(f"_c{i}") for i, x in enumerate(langs)]).filter(F.col("_host").isNotNull())
        near = near.join(wide, F.col("_domain") == F.col("_d"), "left")
        prior = F.array(*[F.log((F.col(f"_c{i}") + KAPPA * F.coalesce(F.get("_dp", F.lit(i)), F.lit(b))) / (F.col("_all") + KAPPA)) for i, b in enumerate(base)])
        near = scratch(near.select(F.col("_host").alias("_h"), F.col("_domain").alias("_hd"), prior.alias("_loghost")))
        rows = rows.join(near, (F.col("_host") == F.col("_h")) & F.col("_domain").eqNullSafe(F.col("_hd")), "left")
        score = [s + F.coalesce(F.get("_loghost", F.lit(i)), F.log(F.lit(b))) for (i, s), b in zip(enumerate(score), base)]
    else:
        score = [s + F.log(F.lit(b)) for s, b in zip(score, base)]
    rows = rows.withColumn("_score", F.array(*score)).withColumn("_high", F.array_max("_score"))
    total = sum((F.exp(F.get("_score", F.lit(i)) - F.col("_high")) for i in range(len(langs))), F.lit(0.0))
    kept = F.col("_ll").isNotNull() & ((F.col("_n") < FEW) | (F.col("_top") >= CHANCE)) & F.coalesce(1 / total >= MOST, F.lit(False))
    best = F.get(names, (F.array_position("_score", F.col("_high")) - 1).cast("int"))
    return scratch.release(rows.select(F.col("_key").alias(key), F.when(kept, best).otherwise("und").alias("language"), F.coalesce(1 / total, F.lit(0.0)).alias("confidence"), kept.alias("kept")))


def page_evidence(url: str = "url", html: str = "html") -> dict[str, Column]:
    """Evidence that a page declares: its lang attribute, address suffix, host and the host's last two labels."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    host = F.when(host == "", None).otherwise(host)
    lang = F.lower(F.regexp_extract(F.col(html), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))
    return {
        "declared": F.when(lang == "", None).otherwise(lang), "suffix": F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")),
        "host": host, "domain": F.coalesce(F.nullif(F.regexp_extract(host, r"[^.]+\.[^.]+$", 0), F.lit("")), host),
    }
