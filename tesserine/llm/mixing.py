"""Mixing sources to target weights by hierarchical budgeting.

The tree's levels are columns, from domain down to source. A node's budget goes to its children in proportion to their weights;
no child gets more than it can supply, its tokens times the epochs allowed. What a child cannot take goes to its siblings, and
only what a whole family cannot take goes to the family's own siblings. With children in order of capacity over weight
the ones that are full come first, so each family is settled by running sums.

A leaf takes whole epochs and then a prefix of one more. Every epoch has its own order, by a seeded hash of the key; the prefix is as long as the budget lasts, to the nearest row. It ends at
a hash that sums by slices of the hash range find first, and row sums in that one slice then make exact. So no leaf is
ever ordered as a whole, and rows with texts are not shuffled: the prefix is a comparison with the leaf's last hash.

The plan has one row for each leaf. It is broadcast only where a count shows it has MOST_LEAVES rows or fewer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import Scratch, text_of

MOST_LEAVES = 100_000
#: Slices of a leaf's hash range, as bits.
SLICE_BITS = 10
SPACE = " \t\n\x0b\x0c\r"


def count_words(text: str = "text") -> Column:
    """Tokens as words: runs without white space."""
    t = F.btrim(text_of(text), F.lit(SPACE))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "[\\x20\\x09-\\x0D]+", -1))).cast("long")


def _order(key: str, seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed), epoch)


def _slice(order: Column) -> Column:
    """Slices follow the order of signed hashes."""
    return F.shiftright(order, 64 - SLICE_BITS).cast("int")


def _weight(level: str, weights: dict | None) -> Column:
    """A node's weight; values not named weigh 1, or nothing if a value None names a weight for all others."""
    out = F.lit(float((weights or {}).get(None, 1.0)))
    for value, w in (weights or {}).items():
        if value is not None:
            out = F.when(F.col(level).eqNullSafe(F.lit(value)), F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[dict | None], total: Column, epochs: int) -> DataFrame:
    """(levels..., supply, budget) from (levels..., supply); total is the tokens wanted at the root."""
    caps = leaves.withColumn("_cap", F.col("supply").cast("double") * epochs)
    node = caps.agg(F.sum("_cap").alias("_cap"), F.sum("supply").alias("_all")).select(F.least("_cap", total).alias("_budget"))
    path: list[str] = []
    for level, own in zip(levels, weights):
        below = caps.groupBy(*path, level).agg(F.sum("_cap").alias("_cap")).withColumn("_w", _weight(level, own))
        kin = below.select(*[F.col(c).alias(f"_k{c}") if c in path else F.col(c) for c in below.columns]) if path else below
        met = kin.crossJoin(F.broadcast(node)) if not path else kin.join(node, [F.col(f"_k{c}").eqNullSafe(F.col(c)) for c in path]).drop(*[f"_k{c}" for c in path])
        family = Window.partitionBy(*path) if path else Window.partitionBy(F.lit(0))
        rank = F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(F.lit(float("inf")))
        met = met.withColumn("_rank", rank)
        by = family.orderBy("_rank", level)
        full = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        met = met.withColumn("_rate", F.when(rest > 0, (F.col("_budget") - full) / rest).otherwise(F.lit(0.0)))
        rate = F.greatest(F.max("_rate").over(family), F.lit(0.0))
        path.append(level)
        node = met.withColumn("_share", F.least("_cap", rate * F.col("_w"))).select(*path, F.col("_share").alias("_budget"))
    out = leaves.select(*[F.col(c).alias(f"_k{c}") for c in path], "supply").join(node, [F.col(f"_k{c}").eqNullSafe(F.col(c)) for c in path])
    return out.select(*path, "supply", F.floor(F.col("_budget") + 1e-6).cast("long").alias("budget"))


def plan(rows: DataFrame, levels: Sequence[str], weights: Sequence[dict | None], share: float, epochs: int, key: str, seed: int, scratch: Scratch) -> DataFrame:
    """(levels..., supply, budget, whole, until) for each leaf: whole epochs, and the last hash of the prefix of one more, null
    where that is empty. rows: (key, levels..., tokens)."""
    leaves = scratch(rows.groupBy(*levels).agg(F.sum("tokens").alias("supply")))
    total = F.floor(F.col("_all").cast("double") * F.lit(float(share)))
    plan = budgets(leaves, levels, weights, total, epochs)
    whole = F.when(F.col("supply") > 0, F.least(F.floor(F.col("budget") / F.col("supply")), F.lit(epochs))).otherwise(0).cast("int")
    plan = scratch(plan.withColumn("whole", whole).withColumn("left", F.col("budget") - F.col("whole") * F.col("supply")))
    few = plan.limit(MOST_LEAVES + 1).count() <= MOST_LEAVES
    held = F.broadcast(plan) if few else plan
    met = _meet(rows, held, levels).filter(F.col("left") > 0).withColumn("_h", _order(key, seed, F.col("whole"))).withColumn("_s", _slice(F.col("_h")))
    sums = met.groupBy(*levels, "_s", "left").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*levels).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("_upto", upto)
    cut = scratch(sums.filter(F.col("_upto") > F.col("left")).groupBy(*levels).agg(F.min("_s").alias("_cut"), F.min(F.struct("_s", (F.col("_upto") - F.col("t")).alias("b")))["b"].alias("_before")))
    inside = _meet(met, F.broadcast(cut) if few else cut, levels).filter(F.col("_s") == F.col("_cut"))
    by = Window.partitionBy(*levels).orderBy("_h")
    inside = inside.withColumn("_reach", F.col("_before") + F.sum("tokens").over(by)).withColumn("_from", F.col("_reach") - F.sum("tokens").over(by.rangeBetween(0, 0)))
    nearer = (F.col("_from") < F.col("left")) & (F.col("_reach") + F.col("_from") < 2 * F.col("left"))
    last = inside.filter((F.col("_reach") <= F.col("left")) | nearer).groupBy(*levels).agg(F.max("_h").alias("_last"))
    ends = _meet(cut, last, levels, "left").select(*levels, "_cut", "_last")
    none_in_slice = F.shiftleft(F.col("_cut").cast("long"), 64 - SLICE_BITS) - 1
    lowest = F.col("_cut") == -(1 << (SLICE_BITS - 1))
    ends = ends.select(*levels, F.lit(True).alias("_ends"), F.coalesce("_last", F.when(~lowest, none_in_slice)).alias("until"))
    return scratch(_meet(plan, ends, levels, "left").select(*levels, "supply", "budget", "whole", F.when(F.col("left") > 0, F.col("until")).alias("until")))


def _meet(a: DataFrame, b: DataFrame, levels: Sequence[str], how: str = "inner") -> DataFrame:
    """a with b's columns by equal levels, null equal to null."""
    own = b.select(*[F.col(c).alias(f"_j{c}") if c in levels else F.col(c) for c in b.columns if c not in a.columns or c in levels])
    return a.join(own, [F.col(c).eqNullSafe(F.col(f"_j{c}")) for c in levels], how).drop(*[f"_j{c}" for c in levels])


def mix(df: DataFrame, levels: dict[str, Column], weights: Sequence[dict | None], share: float, epochs: int = 1, key: str = "doc_id", tokens: Column | None = None, seed: int = 29, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows selected, each as often as its leaf's epochs take it, with `_epoch` counted from 0.

    levels: the tree from the top, by name; weights: each level's, by value, 1 where not named; share: the tokens wanted, as a share of all.
    Null level values are a node of their own; null texts and texts without words have no tokens and come along with any
    prefix that reaches them. Rows that repeat a key stand together in every order: all are in the prefix, or none. An empty table gives none.
    The prefix ends with the row that crosses the budget if that comes nearer to it than ending before. Columns of df stay; with `keep`, those and tokens and level columns.
    """
    scratch = Scratch(df.sparkSession, "mix")
    names = [f"_level_{n}" for n in levels]
    rows = df.select(F.col(key).alias("_key"), *[c.cast("string").alias(n) for n, c in zip(names, levels.values())], (tokens if tokens is not None else count_words()).alias("tokens"))
    rows = scratch(rows)
    made = plan(rows, names, weights, share, epochs, "_key", seed, scratch)
    few = made.limit(MOST_LEAVES + 1).count() <= MOST_LEAVES
    if keep is None:
        own = df.select("*", *[c.cast("string").alias(n) for n, c in zip(names, levels.values())])
        by = key
    else:
        own, by = rows, "_key"
    met = _meet(own, (F.broadcast(made) if few else made).select(*names, "whole", "until", F.lit(True).alias("_planned")), names)
    times = F.col("whole") + F.when(F.col("until").isNotNull() & (_order(by, seed, F.col("whole")) <= F.col("until")), 1).otherwise(0)
    out = met.withColumn("_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    if keep is None:
        return scratch.release(out.drop(*names, "whole", "until", "_planned"))
    return scratch.release(out.select(F.col("_key").alias(key), *[F.col(n).alias(x) for n, x in zip(names, levels)], "tokens", F.col("_epoch").alias("epoch")))
