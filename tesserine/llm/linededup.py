"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that hold a word; a line weighs one plus its spaces, about its words. The window
of a line runs from there to the first line with which it weighs `weight` or more. Any run of lines of that weight that occurs twice holds a
whole window both times, and so the same window minimum: the fingerprint. Windows whose minimum occurs
once are done with. The others are joined on a hash of all their lines with the first window alike, by (key, text hash, line); the
match is extended both ways as long as the lines agree, up to one further window, where the next window's own match takes
over. Every line of a later match goes; its equal in the first match comes strictly earlier, so no line is lost
everywhere. Where both matches lie in one document, the first stays whole.

Only hashes are shuffled to find runs; minima are aggregated before the shuffle, and frequent windows meet their first
in a join that AQE can split. Texts are shuffled once, to meet their deletions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import Scratch, free_name, text_of

#: Weight of a window: runs of 40 words or more that occur again are found for certain.
WEIGHT = 40
SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(df: DataFrame, key: str, text: str, weight: int = WEIGHT) -> DataFrame:
    """(doc, mark, at, last, low, low_at, whole, before, after): each complete window, the hash and place of its minimum, a hash of
    all its lines, and the lines around it. mark is the text's hash; equal rows are one document."""
    each = F.transform(_lines(text_of(text)), lambda line, i: F.struct(i.cast("int").alias("at"), F.btrim(line, F.lit(SPACE)).alias("line")))
    sized = lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("h"), (F.lit(1) + F.octet_length(x["line"]) - F.octet_length(F.replace(x["line"], F.lit(" "), F.lit("")))).cast("long").alias("w"))
    rows = df.select(F.col(key).alias("doc"), F.xxhash64(text_of(text)).alias("mark"), F.explode(F.transform(F.filter(each, lambda x: x["line"] != ""), sized)).alias("x"))
    rows = rows.select("doc", "mark", "x.at", "x.h", "x.w").repartition("doc", "mark")
    rows = rows.groupBy("doc", "mark", "at").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    own = Window.partitionBy("doc", "mark")
    rows = rows.withColumn("b", F.sum("w").over(own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    by, line = own.orderBy("b"), F.struct("h", "at")
    here = by.rangeBetween(0, weight - 1)
    rows = rows.select(
        "doc", "mark", "at", "b", F.max("at").over(here).alias("last"), F.max(F.col("b") + F.col("w")).over(here).alias("end"), F.min(line).over(here).alias("low"),
        F.xxhash64(F.collect_list("h").over(here)).alias("whole"), F.collect_list(line).over(by.rangeBetween(-weight, -1)).alias("before"), F.collect_list(line).over(by.rangeBetween(weight, 2 * weight - 1)).alias("after"),
    )
    return rows.filter(F.col("end") - F.col("b") >= weight).select("doc", "mark", "at", "last", F.col("low.h").alias("low"), F.col("low.at").alias("low_at"), "whole", "before", "after")


def _agree(a: Column, b: Column) -> Column:
    """How many lines agree from the start on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")


def repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text", weight: int = WEIGHT, scratch: Scratch | None = None) -> DataFrame:
    """(doc, mark, runs): for each document with later repeated runs, the numbers of their first and last lines, disjoint and in order."""
    scratch = scratch or Scratch(df.sparkSession, "lines")
    all_windows = scratch(windows(df, key, text, weight))
    place = F.xxhash64("doc", "mark", "low_at")
    prints = all_windows.groupBy("low").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("low")
    # Written, as is `first` below, so that the joins have a shuffle on both sides and AQE can split a frequent fingerprint or window.
    live = all_windows.join(scratch(prints), "low", "left_semi")
    first = live.groupBy("whole").agg(F.min(F.struct("doc", "mark", "at", "last", "before", "after")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = live.join(scratch(first), "whole")
    alike = F.col("doc").eqNullSafe(F.col("f.doc")) & (F.col("mark") == F.col("f.mark"))
    met = met.filter(~(alike & (F.col("at") == F.col("f.at"))))
    met = met.withColumn("back", _agree(F.reverse("before"), F.reverse(F.col("f.before")))).withColumn("ahead", _agree(F.col("after"), F.col("f.after")))
    begin = F.when(F.col("back") > 0, F.get(F.reverse("before"), F.col("back") - 1)["at"]).otherwise(F.col("at"))
    end = F.when(F.col("ahead") > 0, F.get("after", F.col("ahead") - 1)["at"]).otherwise(F.col("last"))
    begin = F.when(alike, F.greatest(begin, F.col("f.last") + 1)).otherwise(begin)
    spans = met.select("doc", "mark", begin.alias("begin"), end.alias("end")).filter(F.col("begin") <= F.col("end"))
    by = Window.partitionBy("doc", "mark").orderBy("begin", "end")
    fresh = F.coalesce(F.col("begin") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(False)).cast("int")
    spans = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("doc", "mark", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return scratch.release(scratch(runs.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", weight: int = WEIGHT) -> DataFrame:
    """df with the later repeated runs cut from its text, and n_lines and n_removed (lines before, and cut).

    Documents come in order of key, nulls first. Rows that repeat key and text are one document and lose the same lines; a null
    or empty text stays as it is and counts no line or one; an empty table gives none. A document all of whose lines
    were there before keeps the empty text. Columns of df called n_lines or n_removed are replaced.
    """
    df = df.drop("n_lines", "n_removed")
    doc, mark, runs, was, left = (free_name(df, x) for x in ("doc", "mark", "runs", "was", "left"))
    found = repeated_runs(df, key, text, weight).select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("runs").alias(runs))
    met = df.hint("merge").join(found, F.col(key).eqNullSafe(F.col(doc)) & (F.xxhash64(text_of(text)) == F.col(mark)), "left")
    gone = F.flatten(F.transform(runs, lambda r: F.sequence(r["begin"], r["end"])))
    met = met.withColumn(was, F.when(F.col(runs).isNotNull(), _lines(F.col(text))))
    met = met.withColumn(left, F.array_except(F.sequence(F.lit(0), F.size(was) - 1), gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(was, i)), "\n")
    n = F.when(F.col(text).isNull(), 0).otherwise(F.length(F.regexp_replace(F.col(text), "[^\n]+", "")) + 1).cast("long")
    return met.select(
        *[F.coalesce(kept, F.col(c)).alias(c) if c.lower() == text.lower() else F.col(c) for c in df.columns],
        n.alias("n_lines"), F.coalesce(F.size(was) - F.size(left), F.lit(0)).cast("long").alias("n_removed"),
    )
