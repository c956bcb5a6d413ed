"""Queries of the training-data problems and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.paths import extension
from kelpline.llm import credentials, leximin, mixing, neighbours, packing, provenance, stuffing, syntax, tokens
from kelpline.runtime import cut, table

SCORES = ["recency", "relevance", "centrality", "git_activity"]


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = leximin.ranked(leximin.leximin(table(spark, sf_dir, "file_scores"), "query_id", "path", SCORES))
    return ranked.select(F.col("q").alias("query_id"), F.col("item").alias("path"), F.col("rank").cast("bigint").alias("rank"), *[F.round(F.col("key")[i], 6).alias(f"p{i + 1}") for i in range(len(SCORES))])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = leximin.leximin(table(spark, sf_dir, "file_scores"), "query_id", "path", SCORES)
    return leximin.top_k(ranked, 5).select(F.col("q").alias("query_id"), F.col("item").alias("path"))


#: Language by extension, where the language column is null.
BY_EXTENSION = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "rb": "ruby", "go": "go", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown", "markdown": "markdown",
}
CODE = ["rust", "typescript", "javascript", "python", "ruby", "go", "java", "c", "cpp"]


def _language() -> Column:
    known = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.lower(F.trim("language")), F.element_at(known, extension(F.col("path"))), F.lit("unknown"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, text): every indexed file with its content; one shuffle by file id."""
    chunks = table(spark, sf_dir, "chunk_embeddings").where("file_id is not null and lower(trim(chunk_type)) = 'file'").groupBy("file_id").agg(F.min("chunk_text").alias("text"))
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path", _language().alias("lang"))
    return files.join(chunks, "file_id").select("path", "lang", "text")


def _checked(spark: SparkSession, sf_dir: str, repairs: bool = True) -> DataFrame:
    return syntax.check_files(_contents(spark, sf_dir), "path", "lang", "text", repairs)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, repairs=False).where("not valid").select("path")


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_rates(_checked(spark, sf_dir, repairs=False))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = provenance.classify(_contents(spark, sf_dir), "path", "text", F.col("lang").isin(CODE))
    return judged.where("origin <> 'hand'").select("path")


def p6_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.classify(_contents(spark, sf_dir), "path", "text", F.col("lang").isin(CODE))


_HOLDERS = [("chunk_embeddings", "id", "chunk_text"), ("search_hits", "hit_id", "content")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [credentials.scan(table(spark, sf_dir, t), i, x).where("row_id is not null").select(F.lit(t).alias("found_in"), "row_id") for t, i, x in _HOLDERS]
    return parts[0].unionByName(parts[1]).distinct()


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [credentials.scan(table(spark, sf_dir, t), i, x, masked=True).select(F.lit(t).alias("found_in"), "row_id", "n_found", F.col("masked").alias("text")) for t, i, x in _HOLDERS]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.clean_vectors(table(spark, sf_dir, "chunk_embeddings"), 64)
    return neighbours.pairs_once(neighbours.most_similar(vectors, 64, k=5, least=0.9))


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows, whatever the similarity."""
    vectors = neighbours.clean_vectors(table(spark, sf_dir, "chunk_embeddings"), 64)
    return neighbours.nearest(vectors, F.col("id") % 20 == 0, 64, k=5)


def p7_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the five nearest of every row whose id is divisible by 20, by brute force in blocks, how many p7_neighbours finds."""
    vectors = cut(neighbours.clean_vectors(table(spark, sf_dir, "chunk_embeddings"), 64))
    asked = F.col("id") % 20 == 0
    return neighbours.recall(neighbours.nearest(vectors, asked, 64, k=5), neighbours.exact_nearest(vectors, asked, 64, k=5))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))


def _budgets(spark: SparkSession, sf_dir: str) -> list:
    return table(spark, sf_dir, "token_budgets").where("capacity_tokens > 0").orderBy("budget_id").collect()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_sizes(spark, sf_dir), 8192)
    split = packed.groupBy("item_id").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1")
    return split.select(F.col("item_id").alias("doc_id"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, out = _sizes(spark, sf_dir), None
    for b in _budgets(spark, sf_dir):
        part = packing.pack(sizes, b["capacity_tokens"]).select(F.lit(b["budget_id"]).alias("budget_id"), F.col("item_id").alias("doc_id"), "piece", "start", F.col("size").alias("n_tokens"), "container")
        out = part if out is None else out.unionByName(part)
    return out


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, out = _sizes(spark, sf_dir), None
    for b in _budgets(spark, sf_dir):
        r = packing.fill_report(packing.pack(sizes, b["capacity_tokens"])).select(F.lit(b["budget_name"]).alias("budget_name"), "containers", "tokens", (F.col("tokens") / (F.col("containers") * b["capacity_tokens"])).alias("fill"), "split_items")
        out = r if out is None else out.unionByName(r)
    return out


def _mixed(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, DataFrame]:
    counts = tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    named = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    return mixing.mix(counts.join(named, "item_id"), table(spark, sf_dir, "source_weights"), **how)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the weighted sources hold: the exponent is bisected against the repetition limits."""
    return _mixed(spark, sf_dir, budget="natural")[0].select("source", F.col("item_id").alias("doc_id"), "pass_no", "n_tokens", "order_key")


def _shares(report: DataFrame) -> DataFrame:
    return report.select("source", F.round("target_share", 6).alias("target_share"), F.round("actual_share", 6).alias("actual_share"), "tokens", "available_tokens", "repeats")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(_mixed(spark, sf_dir, budget="natural")[1])


def p9_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No budget: all targets exactly, as far as the scarcest source goes."""
    return _shares(_mixed(spark, sf_dir)[1])


def p9_entropy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets from the temperature family at 0.95 of the greatest entropy, its exponent bisected."""
    return _shares(_mixed(spark, sf_dir, budget="natural", entropy_share=0.95)[1])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = stuffing.judge_pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return judged.where("marked").select(F.col("item_id").alias("doc_id"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = stuffing.judge_pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return judged.withColumnRenamed("item_id", "doc_id")


QUERIES = {
    "p2_found": p2_found, "p2_ranking": p2_ranking,
    "p3_found": p3_found, "p3_files": p3_files, "p3_rates": p3_rates,
    "p4_found": p4_found, "p4_masked": p4_masked,
    "p6_found": p6_found, "p6_origin": p6_origin,
    "p7_found": p7_found, "p7_neighbours": p7_neighbours, "p7_recall": p7_recall,
    "p8_found": p8_found, "p8_pack": p8_pack, "p8_fill": p8_fill,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_exact_shares": p9_exact_shares, "p9_entropy_shares": p9_entropy_shares,
    "p10_found": p10_found, "p10_scores": p10_scores,
}

_PERCENTILES = """WITH base AS (SELECT query_id, path, max(recency) AS s0, max(relevance) AS s1, max(centrality) AS s2, max(git_activity) AS s3
  FROM file_scores WHERE query_id IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
long AS (SELECT query_id, path, unnest([0, 1, 2, 3]) AS k, unnest([s0, s1, s2, s3]) AS v FROM base),
ranked AS (SELECT query_id, path, k, CASE WHEN count(*) OVER w = 1 THEN 0.5 ELSE
  (rank() OVER (PARTITION BY query_id, k ORDER BY v) - 1 + (count(*) OVER (PARTITION BY query_id, k, v) - 1) / 2.0) / (count(*) OVER w - 1) END AS p
  FROM long WHERE v IS NOT NULL WINDOW w AS (PARTITION BY query_id, k)),
own AS (SELECT l.query_id, l.path, l.k, r.p, coalesce(avg(r.p) OVER (PARTITION BY l.query_id, l.path), 0.5) AS a
  FROM long l LEFT JOIN ranked r USING (query_id, path, k)),
keys AS (SELECT query_id, path, list_sort(list(round(coalesce(p, a), 9))) AS key FROM own GROUP BY ALL)"""

ORACLE = {
    "p2_ranking": _PERCENTILES + " SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY key[1] DESC, key[2] DESC, key[3] DESC, key[4] DESC, path) AS rank, round(key[1], 6) AS p1, round(key[2], 6) AS p2, round(key[3], 6) AS p3, round(key[4], 6) AS p4 FROM keys",
    "p2_found": _PERCENTILES + " SELECT query_id, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key[1] DESC, key[2] DESC, key[3] DESC, key[4] DESC, path) AS rn FROM keys) WHERE rn <= 5",
}
