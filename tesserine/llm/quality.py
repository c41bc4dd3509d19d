"""Quality rules whose cutoffs are chosen under a proven risk.

Each rule rejects a document whose measure exceeds a cutoff. The rules' cutoffs are tightened together, level by level, from
the laxest to the strictest, by a ladder fixed beforehand. For every stratum and level the labelled holdout gives k of n good documents
rejected by any rule; the exact (Clopper-Pearson) upper bound on the rate of false rejections must stay under the risk. A
stratum takes the last level before the first that fails: levels tested in a fixed order need no correction among themselves (fixed-sequence
testing). The strata share the error probability (Bonferroni). So with confidence 1 - delta, all rules together reject no
more than `risk` of the good documents of any stratum beyond what the base rules reject.

The measures use DataFrame functions only, over the whole text, without a shuffle. The driver sees counts: one row for each
stratum, level and label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import Scratch, text_of

#: White space that parts words, as characters and as a pattern.
SPACE, SPACE_RE = " \t\n\x0b\x0c\r", "[\\x20\\x09-\\x0D]+"
#: The ladder: each rule's cutoffs, laxest first.
LADDER = {
    "symbols_per_word": [3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1],
    "repeated_words": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeated_lines": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "upper_words": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "word_length": [15.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.5, 7.0],
}
LEVELS = 10
RISK, DELTA = 0.03, 0.05
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _pieces(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    t = F.btrim(text_of(text), F.lit(SPACE))
    words = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE, -1))
    lines = F.filter(F.split(text_of(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return df.select(*keep, text_of(text).alias("_t"), words.alias("_w"), lines.alias("_l"))


def measures(df: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The base counts of each whole text and the rules' measures (null for a text without words); null texts count as
    empty. Every row of df gives one row."""
    d = _pieces(df, text, [F.col(key), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum")])
    n = F.size("_w")
    d = d.select(
        key, "_stratum", n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("_upper"),
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.arrays_zip(F.slice("_w", 1, F.greatest(n - 2, F.lit(0))).alias("a"), F.slice("_w", 2, F.greatest(n - 2, F.lit(0))).alias("b"), F.slice("_w", 3, F.greatest(n - 2, F.lit(0))).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
        ).alias("_windows"),
    )
    # Windows sorted by hash show their equals side by side. Texts without a repeated window, most of them, skip the sort.
    sort = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), sort)).drop("_windows")
    twice = F.filter("_sorted", lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_sorted", i + 1)["h"], F.lit(False)))
    # Each start of a repeated window covers up to three words that the next start does not cover.
    d = d.withColumn("_starts", F.coalesce(F.sort_array(F.transform(twice, lambda x: x["i"])), F.array().cast("array<int>"))).drop("_sorted")
    m = F.size("_starts")
    steps = F.zip_with(F.slice("_starts", 2, F.greatest(m - 1, F.lit(0))), F.slice("_starts", 1, F.greatest(m - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)).cast("long"))
    covered = F.when(m == 0, F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(3).cast("long"), lambda s, x: s + x))
    d = d.withColumn("n_repeat_words", covered).drop("_starts")
    per = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words"))
    return d.select(
        key, "_stratum", *BASE,
        per("n_symbols").alias("symbols_per_word"), per("n_repeat_words").alias("repeated_words"),
        F.when(F.col("_lines") > 0, F.col("n_dup_lines") / F.col("_lines")).alias("repeated_lines"),
        per("_upper").alias("upper_words"), per("word_chars").alias("word_length"),
    )


def upper_bound(k: int, n: int, delta: float) -> float:
    """The largest rate p under which k or fewer of n still has probability delta: Clopper and Pearson's upper limit."""
    if n == 0 or k >= n:
        return 1.0
    steps = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def below(p: float) -> float:
        logs = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(steps)]
        top = max(logs)
        return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) > delta else (low, mid)
    return high


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _level() -> Column:
    """The laxest level, from 1, whose cutoffs reject the row; LEVELS + 1 if none does."""
    over = [F.coalesce(F.col(rule) > cut, F.lit(False)) for rule, cuts in LADDER.items() for cut in cuts]
    at = [n + 1 for cuts in LADDER.values() for n in range(len(cuts))]
    return F.least(F.lit(LEVELS + 1), *[F.when(x, n).otherwise(LEVELS + 1) for x, n in zip(over, at)])


def levels(measured: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", risk: float = RISK, delta: float = DELTA) -> dict[str, int]:
    """The certified level of each stratum of the holdout, 0 for none. The holdout is what is labelled and passes the base rules.
    Labels that are null, and repeated labels beyond one of each value for a document, count for nothing; the better label
    holds where a document has both."""
    own = labels.groupBy(key).agg(F.max(quality).alias("_good")).filter(F.col("_good").isNotNull() & F.col(key).isNotNull())
    seen = measured.filter(~_base_failed()).join(own, key).select("_stratum", (F.col("_good") > 0).alias("good"), _level().alias("level"))
    counts = seen.groupBy("_stratum", "level", "good").count().collect()
    strata = {r["_stratum"] for r in counts}
    out = {}
    for s in strata:
        good = [(r["level"], r["count"]) for r in counts if r["_stratum"] == s and r["good"]]
        n, out[s] = sum(c for _, c in good), 0
        for level in range(1, LEVELS + 1):
            if upper_bound(sum(c for x, c in good if x <= level), n, delta / len(strata)) > risk:
                break
            out[s] = level
    return out


def apply_rules(measured: DataFrame, found: dict[str, int]) -> DataFrame:
    """base_failed and kept. A stratum without a certified level rejects by the base rules alone."""
    own = sorted((s, n) for s, n in found.items() if n)
    over = F.lit(False)
    if own:
        held = F.create_map(*[F.lit(x) for pair in own for x in pair])
        over = F.coalesce(_level() <= held[F.col("_stratum")], F.lit(False))
    return measured.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Key, base counts, base_failed and kept for every row of df. Null texts fail the base rules. The measures are written
    once to the shared folder, for the labelled counts and the verdicts."""
    scratch = Scratch(df.sparkSession, "quality")
    measured = scratch(measures(df, key, text, stratum))
    return scratch.release(apply_rules(measured, levels(measured, labels, key, risk=risk, delta=delta)).select(key, *BASE, "base_failed", "kept"))
