"""JSON forms of list columns: an empty list is stored as null, bad JSON reads as an empty list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAMETERS = "array<struct<name:string,type:string>>"


def encode_list(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.to_json(a))


def decode_list(s: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(F.from_json(s, kind), F.array().cast(kind))
