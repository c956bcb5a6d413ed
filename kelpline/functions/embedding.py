"""A deterministic text embedder behind the interface a model would have: hashed terms, signed, unit length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384
_TERM = re.compile(r"[^\W_]+")


def embed_text(text: str | None, dim: int = DIM) -> list[float]:
    v = np.zeros(dim, np.float32)
    for t in _TERM.findall((text or "").lower()):
        h = zlib.crc32(t.encode())
        v[h % dim] += 1.0 if h >> 31 else -1.0
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def embed(df: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """``keys`` and the embedding of ``text``, in Arrow batches."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keys].copy()
            out["embedding"] = [embed_text(t if isinstance(t, str) else None, dim) for t in b["_text"]]
            yield out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", embedding array<float>"
    return df.select(*keys, F.col(text).alias("_text")).mapInPandas(run, schema)


def symbol_text() -> Column:
    """What stands for a symbol: name, signature and documentation, blanks kept."""
    return F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("signature", F.lit("")), F.lit(" "), F.coalesce("doc_comment", F.lit("")))
