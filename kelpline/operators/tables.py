"""The index tables: schemas, keyed merges, cascading deletes, written atomically as versioned folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.runtime import SharedFiles

FILES = "id bigint, path string, hash string, modified_at bigint, size bigint, language string, priority_score double, last_accessed bigint, indexed_at bigint"
SYMBOLS = "id bigint, file_id bigint, name string, kind string, start_line int, end_line int, signature string, doc_comment string, visibility string, is_async boolean, is_static boolean, is_abstract boolean, is_exported boolean, is_const boolean, is_unsafe boolean, parent_symbol_id bigint, type_parameters array<string>, parameters array<struct<name:string,type:string>>, return_type string"
EMBEDDINGS = "id bigint, symbol_id bigint, file_id bigint, chunk_text string, embedding array<float>, chunk_type string, embedding_quantized array<tinyint>, embedding_min float, embedding_scale float"
LINES = "path string, line_number bigint, content string"
SCHEMAS = {"files": FILES, "symbols": SYMBOLS, "embeddings": EMBEDDINGS, "lines": LINES}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Missing columns become null, further ones go: the additive migration of an older table."""
    empty = df.sparkSession.createDataFrame([], schema)
    both = empty.unionByName(df.select(*[c for c in df.columns if c in empty.columns]), allowMissingColumns=True)
    return both


def upsert_files(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Merge by path: ids, priority and last access stay, the rest is the newest record's; new paths get a hashed id."""
    w = Window.partitionBy("path").orderBy(F.col("modified_at").desc_nulls_last(), F.col("hash").desc_nulls_last())
    fresh = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("path", "hash", "modified_at", "size", "language", F.lit(True).alias("_new"))
    pick = lambda c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    both = old.alias("o").join(fresh.alias("n"), F.col("o.path") == F.col("n.path"), "full")
    return both.select(
        F.coalesce("o.id", F.xxhash64("n.path")).alias("id"), F.coalesce("o.path", "n.path").alias("path"), pick("hash"), pick("modified_at"), pick("size"), pick("language"),
        F.coalesce("o.priority_score", F.lit(0.5)).alias("priority_score"), F.col("o.last_accessed").alias("last_accessed"),
        F.when(F.col("n._new"), F.lit(now)).otherwise(F.col("o.indexed_at")).cast("bigint").alias("indexed_at"),
    )


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose hash the index does not hold."""
    return new.join(old.select("path", "hash"), ["path", "hash"], "left_anti")


def vanished_files(old: DataFrame, listing: DataFrame) -> DataFrame:
    return old.join(listing.select("path").distinct(), "path", "left_anti")


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Files by path with their symbols, embeddings and lines; children of deleted symbols lose their parent."""
    gone = tables["files"].join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"))
    out = dict(tables)
    out["files"] = tables["files"].join(gone.withColumnRenamed("file_id", "id"), "id", "left_anti")
    dead = tables["symbols"].join(gone, "file_id", "left_semi").select(F.col("id").alias("dead")).distinct()
    left = tables["symbols"].join(gone, "file_id", "left_anti")
    names = left.columns
    orphaned = left.join(dead, F.col("parent_symbol_id") == F.col("dead"), "left")
    out["symbols"] = orphaned.withColumn("parent_symbol_id", F.when(F.col("dead").isNull(), F.col("parent_symbol_id"))).select(*names)
    if "embeddings" in tables:
        kept = tables["embeddings"].join(gone, "file_id", "left_anti")
        out["embeddings"] = kept.join(dead.withColumnRenamed("dead", "symbol_id"), "symbol_id", "left_anti").select(*tables["embeddings"].columns)
    if "lines" in tables:
        out["lines"] = tables["lines"].join(paths.select("path").distinct(), "path", "left_anti")
    return out


def link_parents(parsed: DataFrame) -> DataFrame:
    """Parents by name inside the file, as the index links them: the last symbol of a name stands for the name.

    ``parsed``: path, ordinal, id, name, parent_name. Only the last symbol of each name is linked.
    """
    last = parsed.groupBy("path", "name").agg(F.max_by("id", "ordinal").alias("last_id"))
    up = last.select(F.col("path").alias("p_path"), F.col("name").alias("p_name"), F.col("last_id").alias("parent_id"))
    own = parsed.join(last, ["path", "name"]).join(up, (F.col("path") == F.col("p_path")) & (F.col("parent_name") == F.col("p_name")), "left")
    return own.withColumn("parent_symbol_id", F.when(F.col("id") == F.col("last_id"), F.col("parent_id"))).drop("last_id", "p_path", "p_name", "parent_id")


def link_parents_scoped(parsed: DataFrame) -> DataFrame:
    """The same by scope: the nearest enclosing symbol with the parent's name."""
    p = parsed.select(F.col("path").alias("p_path"), F.col("name").alias("p_name"), F.col("id").alias("p_id"), F.col("start_line").alias("p_start"), F.col("end_line").alias("p_end"))
    on = (F.col("path") == F.col("p_path")) & (F.col("parent_name") == F.col("p_name")) & (F.col("p_start") <= F.col("start_line")) & (F.col("end_line") <= F.col("p_end")) & (F.col("p_id") != F.col("id"))
    best = parsed.join(p, on).groupBy("id").agg(F.max_by("p_id", "p_start").alias("parent_symbol_id"))
    return parsed.join(best, "id", "left")


class Store:
    """A folder of versioned tables: a write makes a new version folder, and one rename of the pointer commits all."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self.files = SharedFiles(spark, self.home)

    def _pointer(self) -> dict:
        return json.loads(self.files.read("CURRENT")) if self.files.exists("CURRENT") else {"version": 0, "tables": {}}

    @property
    def version(self) -> int:
        return self._pointer()["version"]

    def read(self, name: str) -> DataFrame:
        at = self._pointer()["tables"].get(name)
        return self.spark.createDataFrame([], SCHEMAS[name]) if at is None else self.spark.read.parquet(f"{self.home}/{at}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        now = self._pointer()
        held, version = set(now["tables"].values()), now["version"] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.home}/v{version}/{name}")
            now["tables"][name] = f"v{version}/{name}"
        now["version"] = version
        self.files.write("CURRENT", json.dumps(now))
        # readers of the version before may still be at work; what is older goes
        held |= set(now["tables"].values())
        for folder in self.files.names(""):
            if folder.startswith("v"):
                for name in self.files.names(folder):
                    if f"{folder}/{name}" not in held:
                        self.files.remove(f"{folder}/{name}")
                if not self.files.names(folder):
                    self.files.remove(folder)
        return version
