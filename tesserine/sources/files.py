"""Files as tables. A listing has metadata only; contents are read for what is left of it."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine import schema
from tesserine.functions import text as tx


def parse_extensions(csv: str) -> list[str]:
    """Extensions from a comma-separated list, lower-cased, with their dots."""
    parts = (x.strip().lower() for x in csv.split(","))
    return [x if x.startswith(".") else f".{x}" for x in parts if x]


def wanted_extension(path: Column, extensions: Sequence[str] = ()) -> Column:
    own = parse_extensions(",".join(extensions))
    return tx.extension(path).isin(*(own or (*schema.MARKDOWN, *schema.CODE, *schema.TEXT, ".pdf"))) & (F.regexp_extract(path, "[^/]*$", 0) != ".DS_Store")


def pruned(path: Column, root: str) -> Column:
    """Whether a folder from the root's own name down, not the file, is one that scans pass over."""
    above = posixpath.dirname(root.rstrip("/"))
    parts = F.split(F.substring(path, len(above) + 1, 1 << 20), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*[F.lit(x) for x in schema.SKIPPED_FOLDERS]))


def plain_path(c: Column) -> Column:
    """A local file's URI as its path; others as they are."""
    return F.when(c.startswith("file:"), F.regexp_replace(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:(?://)?(?=/)", "")).otherwise(c)


def clean(path: str) -> str:
    """The path made absolute and normal; URIs stay."""
    import os

    return path if "://" in path else posixpath.normpath(os.path.abspath(path))


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _meta(files: DataFrame) -> list[Column]:
    return [plain_path(F.col("path")).alias("path"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns")]


def list_files(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] = ()) -> DataFrame:
    """(path, modified_ns, length) of the files under the roots. A root that is a file is taken whatever its type and folder. Contents are not read."""
    import os

    out = spark.createDataFrame([], schema.LISTING)
    for root in map(clean, roots):
        files = _read(spark, root).select(*_meta(None), "length")
        if not os.path.isfile(root):
            files = files.filter(wanted_extension(F.col("path"), extensions) & ~pruned(F.col("path"), root))
        out = out.unionByName(files)
    return out.dropDuplicates(["path"])


def read_files(spark: SparkSession, roots: Sequence[str], listing: DataFrame) -> DataFrame:
    """(path, content, modified_ns) of the files of the listing."""
    out = None
    for root in map(clean, roots):
        files = _read(spark, root).select(*_meta(None), "content")
        out = files if out is None else out.unionByName(files)
    if out is None:
        return spark.createDataFrame([], "path string, content binary, modified_ns long")
    return out.join(listing.select("path"), "path", "left_semi").dropDuplicates(["path"])


def under(path: Column, target: str) -> Column:
    """The path itself, or anything in that folder."""
    target = posixpath.normpath(target) if "://" not in target else target.rstrip("/")
    return (path == target) | path.startswith(target.rstrip("/") + "/")
