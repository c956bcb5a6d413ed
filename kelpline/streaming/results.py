"""Results in chunks: envelope columns on ranked rows, an iterator for callers, and a text chunker."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STREAM_FROM, CHUNK = 50, 10


def envelope(rank: Column, total: Column, size: int = CHUNK) -> dict[str, Column]:
    """Chunk number, whether it is the last, and progress in percent; short results are one chunk."""
    step = F.when(total >= STREAM_FROM, F.lit(size)).otherwise(F.greatest(total, F.lit(1)))
    chunk = F.floor((rank - 1) / step)
    end = F.least((chunk + 1) * step, total)
    return {"chunk": chunk.cast("bigint"), "is_last": end >= total, "progress": F.floor(100 * end / F.greatest(total, F.lit(1))).cast("bigint")}


def stream(df: DataFrame, size: int = CHUNK) -> Iterator[dict]:
    """Chunks of rows as they arrive at the driver, partition by partition."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        if len(held) == size:
            yield {"items": held, "is_last": False}
            held = []
        held.append(row.asDict())
    yield {"items": held, "is_last": True}


def text_chunks(text: str, size: int = 4096, separator: str = " ") -> Iterator[str]:
    """Cuts at the last line end within ``size``, else at the separator, else hard."""
    while len(text) > size:
        at = max(text.rfind("\n", 0, size), -1) + 1 or text.rfind(separator, 0, size) + 1 or size
        yield text[:at]
        text = text[at:]
    if text:
        yield text


def progress(done: int, total: int, seconds: float) -> dict[str, float | None]:
    """Percent, items a second and seconds left; unknown where nothing is done yet."""
    rate = done / seconds if seconds > 0 else 0.0
    return {"percent": 100.0 * done / total if total else 100.0, "per_second": rate, "seconds_left": (total - done) / rate if rate else None}
