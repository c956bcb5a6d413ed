"""Dependency manifests as rows: name, version, type, source."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.runtime import SharedFiles

SCHEMA = "name string, version string, dep_type string, source string"


def _version(v: object) -> str | None:
    return v if isinstance(v, str) else v.get("version") if isinstance(v, dict) and isinstance(v.get("version"), str) else None


def _table(doc: object, *keys: str) -> dict:
    """The table at ``keys``; empty where there is none or something else."""
    for key in keys:
        doc = doc.get(key) if isinstance(doc, dict) else None
    return doc if isinstance(doc, dict) else {}


def _cargo(text: str) -> Iterator[tuple]:
    doc = tomllib.loads(text)
    for table, kind in (("dependencies", "Runtime"), ("dev-dependencies", "Development"), ("build-dependencies", "Build")):
        for name, v in _table(doc, table).items():
            yield name, _version(v), kind, "Cargo"


def _pep508(spec: str) -> tuple[str, str | None]:
    """Name up to the first other character; what follows is the version, extras included."""
    k = next((i for i, c in enumerate(spec) if not (c.isalnum() or c in "-_")), len(spec))
    return spec[:k], spec[k:].strip() or None


def _pyproject(text: str) -> Iterator[tuple]:
    doc = tomllib.loads(text)
    specs = _table(doc, "project").get("dependencies")
    for spec in specs if isinstance(specs, list) else []:
        if isinstance(spec, str):
            yield *_pep508(spec), "Runtime", "PyPi"
    for table, kind in (("dependencies", "Runtime"), ("dev-dependencies", "Development")):
        for name, v in _table(doc, "tool", "poetry", table).items():
            if name != "python":
                yield name, v if isinstance(v, str) else None, kind, "PyPi"


def _toml_rows(df: DataFrame, text: str, parse) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                try:
                    rows += list(parse(t))
                except tomllib.TOMLDecodeError:
                    continue
            if rows:
                yield pd.DataFrame(rows, columns=["name", "version", "dep_type", "source"]).astype(object)

    return df.select(F.col(text).alias("text")).where("text is not null").mapInPandas(run, SCHEMA)


def cargo(df: DataFrame, text: str = "text") -> DataFrame:
    return _toml_rows(df, text, _cargo)


def pyproject(df: DataFrame, text: str = "text") -> DataFrame:
    return _toml_rows(df, text, _pyproject)


def package_json(df: DataFrame, text: str = "text") -> DataFrame:
    """JVM-side: three maps of one document, read once; a version that is no string is null."""
    doc = df.select(F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>").alias("d"))
    of = lambda field, kind: F.transform(F.map_entries(f"d.{field}"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(kind).alias("dep_type")))
    parts = [of("dependencies", "Runtime"), of("devDependencies", "Development"), of("peerDependencies", "Peer")]
    rows = doc.select(F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("r")).select("r.*")
    return rows.select("name", F.when(~F.col("version").rlike(r"^[\[{]|^(?:true|false|null)$"), F.col("version")).alias("version"), "dep_type", F.lit("Npm").alias("source"))


def requirements(df: DataFrame, text: str = "text") -> DataFrame:
    """The version keeps its operator, the name its blanks."""
    line = df.select(F.explode(F.split(text, "\n")).alias("l")).select(F.trim(F.regexp_replace("l", "\r$", "")).alias("l")).where("l <> '' and not l like '#%' and not l like '-%'")
    rule = r"^([^=><!~]*)([=><!~].*)?$"
    return line.select(F.regexp_extract("l", rule, 1).alias("name"), F.nullif(F.regexp_extract("l", rule, 2), F.lit("")).alias("version"), F.lit("Runtime").alias("dep_type"), F.lit("PyPi").alias("source"))


READERS = {"Cargo.toml": cargo, "package.json": package_json, "requirements.txt": requirements, "pyproject.toml": pyproject}


def project_dependencies(spark: SparkSession, root: str) -> DataFrame:
    """All manifests in the project root, in the order of ``READERS``."""
    files = SharedFiles(spark, root)
    out = spark.createDataFrame([], SCHEMA)
    for name, reader in READERS.items():
        if files.exists(name):
            out = out.unionByName(reader(spark.read.text(f"{root}/{name}", wholetext=True).withColumnRenamed("value", "text")))
    return out
