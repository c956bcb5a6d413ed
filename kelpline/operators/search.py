"""Full-text lines: BM25 top-k without a shuffle of the corpus, and plain line listings."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import lines, terms

K1, B = 1.2, 0.75


def text_lines(df: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line_number, content): one row per line that is not blank; numbers count blank lines too."""
    split = df.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.posexplode(lines(F.col(text))).alias("at", "content"))
    return split.where(F.trim("content") != "").select("path", (F.col("at") + 1).cast("bigint").alias("line_number"), "content")


def replace_lines(old: DataFrame, changed: DataFrame) -> DataFrame:
    """Lines of the paths in ``changed`` (lines as well) in place of the old ones; a path without new lines goes."""
    return old.join(changed.select("path").distinct(), "path", "left_anti").unionByName(changed)


def parse_query(query: str) -> tuple[list[str], list[str], list[str], list[list[str]]]:
    """(any, required, excluded, phrases): ``+must -not "a phrase" AND OR NOT``; unknown fields raise."""
    some, must, never, phrases = [], [], [], []
    pieces = re.findall(r'[+-]?"[^"]*"|\S+', query)
    if query.count('"') % 2:
        raise ValueError(f"unbalanced quotes in query: {query!r}")
    mark = ""
    for k, piece in enumerate(pieces):
        if piece in ("AND", "OR", "NOT"):
            if piece == "NOT":
                mark = "-"
            continue
        sign, body = (piece[0], piece[1:]) if piece[0] in "+-" and len(piece) > 1 else (mark, piece)
        mark = ""
        if re.match(r"[a-z_]+:", body) and not body.startswith(("content:", "path:")):
            raise ValueError(f"unknown field in query: {piece!r}")
        both = "AND" in (pieces[k - 1 : k] + pieces[k + 1 : k + 2]) or sign == "+"
        found = re.findall(r"[^\W_]+", body.removeprefix("content:").lower())
        if sign == "-":
            never += found
        elif body.startswith('"') and len(found) > 1:
            phrases.append(found)
            some += found
        else:
            some += found
            if both:
                must += found
    return list(dict.fromkeys(some)), must, never, phrases


def bm25(lines_df: DataFrame, query: str, limit: int, content: str = "content") -> DataFrame:
    """Top lines by BM25. One pass gathers counts of the query's terms, a second scores; nothing is exploded."""
    some, must, never, phrases = parse_query(query)
    tokened = lines_df.withColumn("_t", terms(F.col(content)))
    if not some:
        return lines_df.limit(0).withColumn("score", F.lit(0.0))
    tf = lambda t: F.size(F.filter("_t", lambda x: x == t))
    stats = tokened.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_t")).alias("length"), *[F.count_if(F.array_contains("_t", t)).alias(f"df{k}") for k, t in enumerate(some)]).first()
    n, average = stats["n"], (stats["length"] or 0) / max(stats["n"], 1) or 1.0
    score: Column = F.lit(0.0)
    for k, t in enumerate(some):
        idf = math.log(1 + (n - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5))
        score = score + F.lit(idf) * tf(t) * (K1 + 1) / (tf(t) + K1 * (1 - B + B * F.size("_t") / F.lit(average)))
    hit = F.arrays_overlap("_t", F.array(*map(F.lit, some)))
    for t in must:
        hit = hit & F.array_contains("_t", t)
    for t in never:
        hit = hit & ~F.array_contains("_t", t)
    for p in phrases:
        hit = hit & F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")).contains(" " + " ".join(p) + " ")
    scored = tokened.where(hit).withColumn("score", score).drop("_t")
    return scored.orderBy(F.col("score").desc(), "path", "line_number").limit(limit)


def matches_per_path(lines_df: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """How many of the top lines each path has."""
    return bm25(lines_df, query, limit).groupBy("path").agg(F.count(F.lit(1)).alias("hits"))


POSTINGS = "term string, path string, line_number bigint, times int, length int"


def postings(lines_df: DataFrame, content: str = "content") -> DataFrame:
    """(term, path, line_number, times, length): the inverted index, one row per term of a line."""
    tokened = lines_df.select("path", "line_number", terms(F.col(content)).alias("_t"))
    counted = tokened.select("path", "line_number", F.size("_t").cast("int").alias("length"), F.explode(F.array_distinct("_t")).alias("term"), "_t")
    return counted.select("term", "path", "line_number", F.size(F.filter("_t", lambda x: x == F.col("term"))).cast("int").alias("times"), "length")


def write_postings(lines_df: DataFrame, where: str) -> None:
    """Sorted by term, so that a query's terms read few row groups; totals beside it."""
    postings(lines_df).repartitionByRange("term", "path").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{where}/postings")
    lines_df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(terms(F.col("content")))), F.lit(0)).alias("length")).coalesce(1).write.mode("overwrite").parquet(f"{where}/totals")


def bm25_indexed(lines_df: DataFrame, where: str, query: str, limit: int) -> DataFrame:
    """The same lines as ``bm25`` over ``lines_df``, found through the written postings.

    Only the rows of the query's terms are read (the filter reaches the scan); lines are read for the
    winners' contents, and for phrases, which postings do not hold, for all candidates.
    """
    some, must, never, phrases = parse_query(query)
    if not some:
        return lines_df.limit(0).withColumn("score", F.lit(0.0))
    spark = lines_df.sparkSession
    total = spark.read.parquet(f"{where}/totals").first()
    n, average = total["n"], total["length"] / max(total["n"], 1) or 1.0
    rows = spark.read.parquet(f"{where}/postings").where(F.col("term").isin([*some, *must, *never]))
    held = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # one row per term of the query
    idf = F.create_map(*[F.lit(x) for t in some for x in (t, math.log(1 + (n - held.get(t, 0) + 0.5) / (held.get(t, 0) + 0.5)))])
    part = F.when(F.col("term").isin(some), idf[F.col("term")] * F.col("times") * (K1 + 1) / (F.col("times") + K1 * (1 - B + B * F.col("length") / F.lit(average)))).otherwise(F.lit(0.0))
    scored = rows.groupBy("path", "line_number").agg(F.sum(part).alias("score"), F.collect_set("term").alias("_has"))
    hit = F.arrays_overlap("_has", F.array(*map(F.lit, some)))
    for t in must:
        hit = hit & F.array_contains("_has", t)
    for t in never:
        hit = hit & ~F.array_contains("_has", t)
    found = scored.where(hit).drop("_has")
    best = [F.col("score").desc(), F.col("path"), F.col("line_number")]
    if not phrases:
        found = found.orderBy(*best).limit(limit)
    both = lines_df.join(found, ["path", "line_number"])
    for p in phrases:
        both = both.where(F.concat(F.lit(" "), F.array_join(terms(F.col("content")), " "), F.lit(" ")).contains(" " + " ".join(p) + " "))
    return both.orderBy(*best).limit(limit)
