"""Rendering of context items and search hits as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import fence_tag


def item_text(style: str = "markdown") -> Column:
    """``path`` and ``content`` as plain, markdown or json text."""
    if style == "plain":
        return F.concat(F.lit("// "), F.col("path"), F.lit("\n"), F.col("content"), F.lit("\n"))
    if style == "markdown":
        return F.concat(F.lit("## "), F.col("path"), F.lit("\n\n```"), fence_tag(F.col("path")), F.lit("\n"), F.col("content"), F.lit("\n```\n"))
    if style == "json":
        return F.to_json(F.struct("path", "content"))
    raise ValueError(f"unknown style: {style}")


def document(items: DataFrame, style: str = "markdown") -> DataFrame:
    """One row of text from a bounded, ranked list (rank, path, content)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item_text(style).alias("t")))), lambda x: x["t"]), "\n")
    return items.agg(joined.alias("text"))


def hit_line() -> Column:
    return F.format_string("%s:%d: %s", F.col("path"), F.col("line_number"), F.trim("content"))


def scored_line() -> Column:
    return F.format_string("%s:%d (score: %.2f)", F.col("path"), F.coalesce("line_number", F.lit(0)), F.col("score"))
