"""Path expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """One spelling per file: separators unified, empty and ``.`` segments dropped, ``..`` resolved. Null stays null."""
    slashed = F.regexp_replace(path, r"[\\/]+", "/")
    simple = F.regexp_replace(F.regexp_replace(slashed, r"(^|/)(\./)+", "$1"), r"(?<=.)/\.?$", "")

    def step(acc: Column, seg: Column) -> Column:
        back = (seg == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when(seg.isin("", "."), acc).when(back, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(seg)))

    climbed = F.array_join(F.aggregate(F.split(simple, "/"), F.array().cast("array<string>"), step), "/")
    climbed = F.when(simple.startswith("/"), F.concat(F.lit("/"), climbed)).otherwise(climbed)
    return F.when(simple.contains(".."), climbed).otherwise(simple)


def extension(path: Column) -> Column:
    """Lower-cased extension without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def repository(path: Column) -> Column:
    return F.substring_index(path, "/", 1)
