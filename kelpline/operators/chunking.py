"""Chunks of files: fixed by expression, semantic and recursive as per-file state machines in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import lines

CHUNK = "path string, chunk_no bigint, start_line bigint, end_line bigint, chunk_type string, content string"
STRATEGY, TARGET, OVERLAP = "semantic", 2048, 0.1
_OPENS = re.compile(r"^(?:fn |def |function |pub fn |async fn )|class ")


def fixed_chunks(df: DataFrame, path: str, text: str, target: int = TARGET, overlap: float = OVERLAP) -> DataFrame:
    """Windows of max(target / 80, 10) lines; the last overlap is a chunk of its own where it starts later than the last window."""
    size = max(target // 80, 10)
    shared = int(size * overlap)
    step = size - shared
    n = F.size("ls")
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda k: k * step)
    if shared:
        starts = F.when(n - shared > last * step, F.concat(starts, F.array(n - shared))).otherwise(starts)
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(path).alias("path"), lines(F.col(text)).alias("ls"))
    rows = rows.withColumn("n", n).select("path", "ls", "n", F.posexplode(starts).alias("k", "s"))
    end = F.least(F.col("s") + size, F.col("n"))
    return rows.select("path", F.col("k").cast("bigint").alias("chunk_no"), (F.col("s") + 1).cast("bigint").alias("start_line"), end.cast("bigint").alias("end_line"), F.lit("CodeBlock").alias("chunk_type"), F.array_join(F.slice("ls", F.col("s") + 1, end - F.col("s")), "\n").alias("content"))


def split_semantic(ls: list[str]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, content): functions and classes, and the text between them as blocks.

    Braces count on every line of the file, so what opens inside another brace ends where the outermost closes.
    """

    def part(lo: int, hi: int, kind: str) -> Iterator[tuple[int, int, str, str]]:
        text = "\n".join(ls[lo:hi])
        if kind == "Symbol" or text.strip():
            yield lo + 1, hi, kind, text

    start, depth, inside = 0, 0, False
    for i, line in enumerate(ls):
        if not inside and _OPENS.search(line.strip()):
            yield from part(start, i, "CodeBlock")
            start, inside = i, True
        depth += line.count("{") - line.count("}")
        if inside and not depth and "}" in line:
            yield from part(start, i + 1, "Symbol")
            start, inside = i + 1, False
    yield from part(start, len(ls), "CodeBlock")


def split_recursive(ls: list[str], target: int = TARGET, overlap: float = OVERLAP) -> Iterator[tuple[int, int, str, str]]:
    """Blocks close at a blank line once they hold half the target, or at the target, which keeps an overlap of lines.

    Sizes are bytes; other blank lines inside a block are left out, one before it belongs to it.
    """
    held: list[str] = []
    size = first = 0
    for i, line in enumerate(ls):
        if held and not line.strip():
            if size - 1 >= target // 2:
                yield first + 1, i, "CodeBlock", "\n".join(held)
                held, size, first = [], 0, i + 1
            continue
        held.append(line)
        size += len(line.encode()) + 1
        if size >= target:
            yield first + 1, i + 1, "CodeBlock", "\n".join(held)
            keep = int(len(held) * overlap)
            held = held[len(held) - keep :]
            size, first = sum(len(x.encode()) + 1 for x in held), i - keep + 1
    if held:
        yield first + 1, len(ls), "CodeBlock", "\n".join(held)


def _by_machine(df: DataFrame, path: str, text: str, split: Callable[[list[str]], Iterator[tuple[int, int, str, str]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, *c) for p, t in zip(b["path"], b["text"]) for k, c in enumerate(split([x.removesuffix("\r") for x in t.removesuffix("\n").split("\n")]))]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "chunk_no", "start_line", "end_line", "chunk_type", "content"])

    return df.select(F.col(path).alias("path"), F.col(text).alias("text")).where("path is not null and text is not null and text <> ''").mapInPandas(run, CHUNK)


def chunks(df: DataFrame, path: str, text: str, strategy: str = STRATEGY, target: int = TARGET, overlap: float = OVERLAP) -> DataFrame:
    if strategy == "fixed":
        return fixed_chunks(df, path, text, target, overlap)
    if strategy == "recursive":
        return _by_machine(df, path, text, lambda ls: split_recursive(ls, target, overlap))
    if strategy == "semantic":
        return _by_machine(df, path, text, split_semantic)
    raise ValueError(f"unknown chunking strategy: {strategy}")
