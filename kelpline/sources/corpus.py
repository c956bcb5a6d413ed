"""Corpus scans: files under a folder as rows, with filters pushed to the listing where Spark can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.globs import IGNORED, INCLUDED, gitignore_globs, ignored
from kelpline.functions.paths import extension
from kelpline.functions.text import content_hash, language_of_extension, relative_path
from kelpline.runtime import SharedFiles

MAX_KB = 500


def walk(spark: SparkSession, root: str, max_kb: int = MAX_KB, include: list[str] | None = None, ignore: list[str] | None = None, compat: bool = False) -> DataFrame:
    """(path, size, modified_at, reason, content): every file under ``root``; ``reason`` says why one is skipped.

    Content is read only where it is used: a projection without it prunes the bytes.
    """
    return walk_rows(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root, max_kb, include, ignore, compat)


def walk_rows(raw: DataFrame, root: str, max_kb: int, include: list[str] | None, ignore: list[str] | None, compat: bool = False) -> DataFrame:
    path = relative_path(F.regexp_replace("path", "^file:/+", "/"), root.removeprefix("file://"))
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_at"), "content")
    reason = F.when(ignored(F.col("path"), ignore, compat), "ignored").when(~extension(F.col("path")).isin(INCLUDED if include is None else include), "type").when(F.floor(F.col("size") / 1024) > max_kb, "size")
    return rows.withColumn("reason", reason)


def ignore_globs(spark: SparkSession, root: str, globs: list[str] | None = None) -> list[str]:
    """The globs given, or the usual ones, and those of the ``.gitignore`` in the root of the folder."""
    files = SharedFiles(spark, root)
    own = gitignore_globs(files.read(".gitignore")) if files.exists(".gitignore") else []
    return [*(IGNORED if globs is None else globs), *own]


def read_paths(spark: SparkSession, root: str, paths: list[str], max_kb: int = MAX_KB, include: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """The same as ``walk`` for the named files alone; names that are no longer there give no row."""
    files = SharedFiles(spark, root)
    there = [f"{root.rstrip('/')}/{p}" for p in paths if files.exists(p)]
    if not there:
        return walk_rows(spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary"), root, max_kb, include, ignore)
    return walk_rows(spark.read.format("binaryFile").load(there), root, max_kb, include, ignore)


def read_files(walked: DataFrame) -> DataFrame:
    """Kept files with text, language and hash; bytes that are no UTF-8 give an error row without text."""
    kept = walked.where("reason is null")
    ok = F.expr("is_valid_utf8(content)")
    text = F.when(ok, F.decode("content", "UTF-8"))
    return kept.select("path", content_hash(F.col("content")).alias("hash"), "modified_at", "size", language_of_extension(extension(F.col("path"))).alias("language"), text.alias("text"), F.when(~ok, "not UTF-8").alias("error"))


def walk_summary(walked: DataFrame) -> DataFrame:
    return walked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def single_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    return read_files(walk(spark, root).where(F.col("path") == path).withColumn("reason", F.lit(None).cast("string")))
