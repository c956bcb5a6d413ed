"""Vector and hybrid retrieval, symbol lookup, statistics and ranking over the index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import scores
from kelpline.functions.globs import path_filter
from kelpline.functions.text import chunk_type, token_estimate
from kelpline.functions.vectors import cosine, given_or_quantised
from kelpline.operators.search import bm25, matches_per_path


def embeddings_with_paths(embeddings: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Embeddings with symbol name, line and path; the file of a chunk is its own or its symbol's."""
    s = symbols.select(F.col("id").alias("s_id"), F.col("file_id").alias("s_file"), F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), F.col("start_line").alias("line_number")).distinct()
    f = files.select(F.col("id").alias("f_id"), "path", "language")
    e = embeddings.join(s, F.col("symbol_id") == F.col("s_id"), "left")
    return e.withColumn("of_file", F.coalesce("file_id", "s_file")).join(f, F.col("of_file") == F.col("f_id"), "left").drop("s_id", "s_file", "f_id", "of_file")


def embeddings_of_files(embeddings: DataFrame, files: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """The embeddings stored for files themselves, each with its path: of the files named, or of all."""
    of = files if paths is None else files.where(F.col("path").isin(paths))
    return embeddings.join(of.select(F.col("id").alias("file_id"), "path"), "file_id")


def vector_top_k(embeddings: DataFrame, query: list[float], limit: int, least: float | None = None, paths: list[str] | None = None, types: list[str] | None = None, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Exact cosine top-k: threshold, path and type filters below the sort; non-finite scores are dropped."""
    rows = embeddings
    if paths:
        rows = rows.where(path_filter(paths, F.col("path")))
    if types:
        rows = rows.where(chunk_type(F.col("chunk_type")).isin(types))
    vec = given_or_quantised(F.col("embedding"), F.col("embedding_quantized"), F.col("embedding_min"), F.col("embedding_scale")) if "embedding_quantized" in rows.columns else F.col("embedding")
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("_v", vec).where(F.col("_v").isNotNull()).withColumn("similarity", cosine(F.col("_v"), q)).where(~F.isnan("similarity") & (F.abs("similarity") <= 1.0001))
    if least is not None:
        scored = scored.where(F.col("similarity") >= min(1.0, max(0.0, least)))
    return scored.select(*keep, "similarity").orderBy(F.col("similarity").desc(), *keep).limit(limit)


def fuse(keyword: DataFrame, semantic: DataFrame, limit: int | None, k: int = 60, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (path, line_number, content, rank); keyword content wins."""
    parts = []
    for side, df, w in (("Keyword", keyword, weights[0]), ("Semantic", semantic, weights[1])):
        parts.append(df.select("path", F.col("line_number").cast("bigint").alias("line_number"), "content", F.lit(side).alias("side"), scores.fusion_term(w, k, F.col("rank")).alias("part"), F.col("rank").cast("bigint").alias("rank")))
    both = parts[0].unionByName(parts[1])
    merged = both.groupBy("path", "line_number").agg(
        F.sum("part").alias("score"),
        F.when(F.count(F.lit(1)) > 1, "Hybrid").otherwise(F.min("side")).alias("match_type"),
        F.min_by("content", F.struct("side", "rank")).alias("content"),
    )
    if limit is None:
        return merged
    return merged.orderBy(F.col("score").desc(), F.col("path").asc_nulls_last(), F.col("line_number").asc_nulls_last()).limit(limit)


def hybrid(lines: DataFrame, embeddings: DataFrame, query: str, vector: list[float] | None, limit: int, mode: str = "hybrid") -> DataFrame:
    """Keyword, semantic or fused results; without a query vector the keyword side alone answers."""
    ranked = lambda df, by: df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc(), F.col("path").asc_nulls_last(), F.col("line_number").asc_nulls_last())))
    wide = limit if mode != "hybrid" else 3 * limit
    kw = ranked(bm25(lines, query, wide), "score").select("path", "line_number", "content", "rank")
    if mode == "keyword" or vector is None:
        return fuse(kw, kw.limit(0), limit, weights=(1.0, 0.0))
    sem = vector_top_k(embeddings, vector, wide, least=0.3, keep=("path", "line_number", "chunk_text"))
    sem = ranked(sem, "similarity").select("path", "line_number", F.col("chunk_text").alias("content"), "rank")
    return fuse(kw.limit(0) if mode == "semantic" else kw, sem, limit)


def find_symbols(symbols: DataFrame, files: DataFrame, name: str, fuzzy: bool = False, kind: str | None = None, visibility: str | None = None) -> DataFrame:
    """Exact (case-sensitive) or containing (without case; % and _ in the name stay wildcards), then kind and visibility."""
    hit = F.ilike(F.col("name"), F.lit(f"%{name}%")) if fuzzy else F.col("name") == name
    if kind is not None:
        hit = hit & (F.lower("kind") == kind.lower())
    if visibility is not None:
        hit = hit & (F.lower("visibility") == visibility.lower())
    return symbols.where(hit).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")


def outline(symbols: DataFrame, files: DataFrame, path: str | None = None) -> DataFrame:
    """Symbols in document order with their place in the file: of one file, sorted, or of all files."""
    of = files if path is None else files.where(F.col("path") == path)
    placed = symbols.distinct().join(of.select(F.col("id").alias("file_id"), "path"), "file_id")
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("start_line").asc_nulls_first(), "id")))
    return placed if path is None else placed.orderBy("place")


def index_stats(files: DataFrame, symbols: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: counts, coverage and the two maps by kind and visibility."""
    s = symbols.agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("visibility").isNotNull() & (F.col("visibility") != "unknown")).alias("with_visibility"), F.count_if(F.col("parent_symbol_id").isNotNull()).alias("with_parent"),
    )
    maps = lambda c, name: symbols.groupBy(c.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    parts = [files.agg(F.count(F.lit(1)).alias("files")), s, embeddings.agg(F.count(F.lit(1)).alias("embeddings")), maps(F.coalesce("kind", F.lit("unknown")), "by_kind"), maps(F.coalesce("visibility", F.lit("unknown")), "by_visibility")]
    one = parts[0]
    for p in parts[1:]:  # five rows of one aggregate each, folded into one
        one = one.unionByName(p, allowMissingColumns=True)
    return one.agg(*[F.first(c, ignorenulls=True).alias(c) for c in one.columns])


def priority_ranking(items: DataFrame, weights: dict[str, float] | None = None, paths: list[str] | None = None, least: float | None = None, most: float | None = None, limit: int | None = None) -> DataFrame:
    """Weighted sum of five factors, filtered and sorted; ``items`` has path and the factor columns."""
    out = items.withColumn("score", scores.weighted(weights))
    if paths:
        out = out.where(F.col("path").isin(paths))
    if least is not None:
        out = out.where(F.col("score") >= least)
    if most is not None:
        out = out.where(F.col("score") <= most)
    out = out.orderBy(F.col("score").desc(), "path")
    return out if limit is None else out.limit(limit)


def context_ranking(files: DataFrame, symbols: DataFrame, lines: DataFrame | None, query: str | None, now: int, limit: int = 10, least: float = 0.0, paths: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Files by recency, query relevance and symbol count; git and focus are neutral. One search, two aggregates."""
    counts = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"))
    rows = files.join(counts, files["id"] == counts["file_id"], "left")
    if paths:
        hit = F.lit(False)
        for p in paths:
            hit = hit | F.col("path").contains(p)
        rows = rows.where(hit)
    if query:
        hits = matches_per_path(lines, query).select(F.col("path").alias("h_path"), "hits")
        rows = rows.join(hits, F.col("path") == F.col("h_path"), "left").withColumn("relevance", F.least(F.coalesce("hits", F.lit(0)) / 10, F.lit(1.0)))
    else:
        rows = rows.withColumn("relevance", F.lit(0.5))
    age = (F.lit(now) - F.coalesce("indexed_at", "modified_at")) / 3600
    rows = rows.select("path", scores.recency(age).alias("recency"), "relevance", F.least(F.coalesce("n_symbols", F.lit(0)) / 20, F.lit(1.0)).alias("centrality"), F.lit(0.5).alias("git_activity"), F.lit(0.5).alias("user_focus"))
    return priority_ranking(rows, weights, least=least, limit=limit)


def pack_budget(items: DataFrame, budget: int, priority: Column, text: Column, key: Column, group: Column | None = None) -> DataFrame:
    """Greedy selection within a token budget: by priority, an item that does not fit is skipped.

    Room only shrinks, so of equally long items a prefix by priority is taken: of length t at most
    budget / t can be. The ordered fold therefore sees at most budget * ln(budget) items a group,
    however many there are. Items without tokens are always taken and have no place.
    """
    g = F.lit(1) if group is None else group
    rows = items.select(g.alias("g"), (-priority.cast("double")).alias("p"), key.cast("bigint").alias("key"), token_estimate(text).alias("t")).where(F.col("t") <= budget)
    same = Window.partitionBy("g", "t").orderBy("p", "key")
    able = rows.where("t > 0").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= F.floor(F.lit(budget) / F.col("t")))
    ordered = F.array_sort(F.collect_list(F.struct("p", "key", "t")))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<key:bigint,t:bigint>>").alias("taken"))

    def step(acc: Column, r: Column) -> Column:
        fits = acc["used"] + r["t"] <= budget
        return F.when(fits, F.struct((acc["used"] + r["t"]).alias("used"), F.concat(acc["taken"], F.array(F.struct(r["key"].alias("key"), r["t"].alias("t")))).alias("taken"))).otherwise(acc)

    packed = able.groupBy("g").agg(F.aggregate(ordered, start, step).alias("s"))
    taken = packed.select("g", F.posexplode("s.taken").alias("pos", "x")).select("g", F.col("x.key").alias("key"), F.col("x.t").alias("tokens"), (F.col("pos") + 1).cast("bigint").alias("place"))
    return taken.unionByName(rows.where("t = 0").select("g", "key", F.col("t").alias("tokens"), F.lit(None).cast("bigint").alias("place")))


def git_scores(commits: DataFrame, now: str, latest: int = 50) -> DataFrame:
    """Activity of every path over its ``latest`` newest commits. ``commits``: path, ts."""
    w = Window.partitionBy("path").orderBy(F.col("ts").desc())
    top = commits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= latest)
    at = F.lit(now).cast("timestamp")
    n = top.groupBy("path").agg(
        F.count_if(F.col("ts") >= at - F.expr("INTERVAL 7 DAYS")).alias("commits_7d"), F.count_if(F.col("ts") >= at - F.expr("INTERVAL 30 DAYS")).alias("commits_30d"), F.max("ts").alias("last_commit"),
    )
    days = (F.unix_timestamp(at) - F.unix_timestamp(F.col("last_commit").cast("timestamp"))) / 86400.0
    parts = scores.git_activity(F.col("commits_7d"), F.col("commits_30d"), days)
    return n.select("path", "commits_7d", "commits_30d", *[F.round(v, 6).alias(k) for k, v in parts.items()])


def recently_changed(commits: DataFrame, now: str, hours: int) -> DataFrame:
    return commits.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")).select("path").distinct()
