"""Token counts by a public tokenizer, whose vocabulary file is a parameter, and row numbers without one big sort."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, object] = {}


def encoder(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = RANKS) -> DataFrame:
    """(item_id, n_tokens) of every row with an id; a null text counts 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "n_tokens": [0 if not isinstance(t, str) or not t else len(enc.encode_ordinary(t)) for t in b["text"]]})

    return df.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null").mapInPandas(count, "item_id bigint, n_tokens bigint")


def numbered(df: DataFrame, keys: list[str], id_col: str, rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Adds ``k`` = 0, 1, ... within ``keys``. Buckets by hash are numbered apart and shifted by the counts before them."""
    buckets = max(1, rows // per_bucket + 1)
    part = df.withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)))
    sizes = part.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    shift = sizes.select(*keys, "bucket", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    inner = part.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(id_col)))
    return inner.join(shift, [*keys, "bucket"]).withColumn("k", F.col("shift") + F.col("rn") - 1).drop("bucket", "rn", "shift")
