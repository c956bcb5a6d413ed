"""One query per operator over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions import scores, vectors
from kelpline.functions.globs import glob_match, ignored, path_filter
from kelpline.functions.jsoncols import decode_list, encode_list
from kelpline.functions.paths import extension
from kelpline.functions.text import cache_key, chunk_type, content_hash, duration, fence_tag, language_of_extension, normalise_query, relative_path, signature_line, token_estimate, visibility
from kelpline.operators import chunking, context, retrieval, search, tables
from kelpline.operators.numbering import global_rank
from kelpline.runtime import scratch, table
from kelpline.sources import manifests
from kelpline.streaming import changes, results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-01-31 00:00:00"
#: The newest indexing time of the data is close to this instant.
NOW_S = 1_767_000_000


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def long(c: str):
    return F.col(c).cast("bigint").alias(c)


def files(s, d):
    return table(s, d, "files")


def symbols(s, d):
    return table(s, d, "symbols").distinct()


def chunks(s, d):
    return table(s, d, "chunk_embeddings").dropDuplicates(["id"])


def contents(s, d):
    c = table(s, d, "chunk_embeddings").where("lower(trim(chunk_type)) = 'file'").groupBy("file_id").agg(F.min("chunk_text").alias("text"))
    return files(s, d).join(c, F.col("id") == F.col("file_id")).select("path", "language", "text")


_CONTENTS = "contents AS (SELECT f.path, f.language, c.text FROM files f JOIN (SELECT file_id, min(chunk_text) AS text FROM chunk_embeddings WHERE lower(trim(chunk_type)) = 'file' GROUP BY 1) c ON f.id = c.file_id)"
_LINES = _CONTENTS + r""",
lines AS (SELECT path, i AS line_number, CASE WHEN l LIKE '%' || chr(13) THEN l[:-2] ELSE l END AS content FROM (SELECT path, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT path, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM contents)) WHERE trim(l) <> '')"""


# scans and joins


@q("S11_files", "SELECT path, hash, size, language FROM files")
def _(s, d):
    return files(s, d).select("path", "hash", "size", "language")


@q("S05_parsed_files", "WITH " + _CONTENTS + " SELECT path, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS bytes, coalesce(language, 'unknown') AS language FROM contents")
def _(s, d):
    return contents(s, d).select("path", content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("bigint").alias("bytes"), F.coalesce("language", F.lit("unknown")).alias("language"))


@q("J01_symbols_with_files", "SELECT DISTINCT s.id, s.name, f.path FROM symbols s JOIN files f ON s.file_id = f.id")
def _(s, d):
    return symbols(s, d).join(files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "path")


@q("J02_embeddings_with_paths", "SELECT e.id, s.name AS symbol_name, f.path FROM (SELECT DISTINCT id, symbol_id, file_id FROM chunk_embeddings) e LEFT JOIN (SELECT DISTINCT id, file_id, name FROM symbols) s ON e.symbol_id = s.id LEFT JOIN files f ON coalesce(e.file_id, s.file_id) = f.id")
def _(s, d):
    return retrieval.embeddings_with_paths(chunks(s, d), symbols(s, d), files(s, d)).select("id", "symbol_name", "path")


@q("J03_parent_by_name", """WITH n AS (SELECT DISTINCT s.id, s.file_id, s.name, p.name AS parent_name FROM symbols s JOIN symbols p ON s.parent_symbol_id = p.id),
last AS (SELECT file_id, name, max(id) AS last_id FROM n GROUP BY 1, 2)
SELECT n.id, CASE WHEN n.id = l.last_id THEN u.last_id END AS parent_symbol_id FROM n JOIN last l USING (file_id, name) LEFT JOIN last u ON u.file_id = n.file_id AND u.name = n.parent_name""")
def _(s, d):
    sy = symbols(s, d)
    p = sy.select(F.col("id").alias("pid"), F.col("name").alias("parent_name"))
    parsed = sy.join(p, F.col("parent_symbol_id") == F.col("pid")).select(F.col("file_id").alias("path"), F.col("id").alias("ordinal"), "id", "name", "parent_name")
    return tables.link_parents(parsed).select("id", "parent_symbol_id")


@q("J06_files_without_embeddings", "SELECT id, path FROM files WHERE id NOT IN (SELECT file_id FROM chunk_embeddings WHERE file_id IS NOT NULL AND embedding IS NOT NULL)")
def _(s, d):
    have = chunks(s, d).where("file_id is not null and embedding is not null").select(F.col("file_id").alias("id"))
    return files(s, d).join(have, "id", "left_anti").select("id", "path")


@q("J07_path_set", "SELECT path, size FROM files WHERE path IN (SELECT DISTINCT path FROM search_hits WHERE query_id = 1)")
def _(s, d):
    return files(s, d).join(table(s, d, "search_hits").where("query_id = 1").select("path").distinct(), "path", "left_semi").select("path", "size")


@q("J08_hits_per_path", "SELECT f.path, coalesce(h.n, 0) AS hits FROM files f LEFT JOIN (SELECT path, count(*) AS n FROM search_hits WHERE query_id = 2 GROUP BY 1) h ON f.path = h.path")
def _(s, d):
    h = table(s, d, "search_hits").where("query_id = 2").groupBy("path").agg(F.count(F.lit(1)).alias("hits"))
    return files(s, d).select("path").join(h, "path", "left").select("path", F.coalesce("hits", F.lit(0)).alias("hits"))


@q("J09_symbols_per_file", "SELECT f.path, coalesce(n, 0) AS n_symbols FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM (SELECT DISTINCT id, file_id FROM symbols) GROUP BY 1) s ON s.file_id = f.id")
def _(s, d):
    n = symbols(s, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"))
    return files(s, d).join(n, F.col("id") == F.col("file_id"), "left").select("path", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


@q("J11_symbol_id_by_name", "SELECT file_id, name, min(id) AS id FROM symbols WHERE file_id IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return symbols(s, d).where("file_id is not null").groupBy("file_id", "name").agg(F.min("id").alias("id"))


# writes


@q("K01_upsert_files", """WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY modified_at DESC, hash DESC) AS rn FROM file_inserts WHERE batch_no = 1) WHERE rn = 1)
SELECT coalesce(f.path, n.path) AS path, CASE WHEN n.path IS NOT NULL THEN n.hash ELSE f.hash END AS hash, CASE WHEN n.path IS NOT NULL THEN n.size ELSE f.size END AS size, coalesce(f.priority_score, 0.5) AS priority_score, CASE WHEN n.path IS NOT NULL THEN 1767000000 ELSE f.indexed_at END AS indexed_at
FROM files f FULL JOIN n ON f.path = n.path""")
def _(s, d):
    new = table(s, d, "file_inserts").where("batch_no = 1")
    return tables.upsert_files(files(s, d), new, NOW_S).select("path", "hash", "size", "priority_score", "indexed_at")


@q("K04_delete_cascade", """WITH gone AS (SELECT id FROM files WHERE language = 'go'), left_s AS (SELECT DISTINCT id, parent_symbol_id FROM symbols WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM gone)),
dead AS (SELECT id FROM symbols WHERE file_id IN (SELECT id FROM gone))
SELECT id, CASE WHEN parent_symbol_id IN (SELECT id FROM dead) THEN NULL ELSE parent_symbol_id END AS parent_symbol_id FROM left_s""")
def _(s, d):
    f = files(s, d)
    return tables.delete_files({"files": f, "symbols": symbols(s, d)}, f.where("language = 'go'").select("path"))["symbols"].select("id", "parent_symbol_id")


@q("K09_delete_embeddings_of_files", "SELECT count(*) AS removed FROM (SELECT DISTINCT id, file_id FROM chunk_embeddings) WHERE file_id IN (SELECT id FROM files WHERE language = 'ruby')")
def _(s, d):
    return chunks(s, d).join(files(s, d).where("language = 'ruby'").select(F.col("id").alias("file_id")), "file_id", "left_semi").agg(F.count(F.lit(1)).alias("removed"))


@q("K10_text_lines", "WITH " + _LINES + " SELECT path, line_number, content FROM lines")
def _(s, d):
    return search.text_lines(contents(s, d), "path", "text")


@q("K17_symbol_text", "SELECT DISTINCT id, coalesce(name, '') || ' ' || coalesce(signature, '') || ' ' || coalesce(doc_comment, '') AS text FROM symbols")
def _(s, d):
    from kelpline.functions.embedding import symbol_text

    return symbols(s, d).select("id", symbol_text().alias("text"))


@q("K22_context_item", "WITH " + _CONTENTS + " SELECT path, '## ' || path || chr(10) || chr(10) || '```' || regexp_extract(path, '([^.]*)$', 1) || chr(10) || text || chr(10) || '```' || chr(10) AS item FROM contents")
def _(s, d):
    return contents(s, d).withColumnRenamed("text", "content").select("path", context.item_text("markdown").alias("item"))


@q("K22_context_plain", "WITH " + _CONTENTS + " SELECT path, '// ' || path || chr(10) || text || chr(10) AS item FROM contents")
def _(s, d):
    return contents(s, d).withColumnRenamed("text", "content").select("path", context.item_text("plain").alias("item"))


@q("F06_embeddings_of_files", "SELECT DISTINCT f.path, e.id, e.symbol_id FROM chunk_embeddings e JOIN files f ON f.id = e.file_id")
def _(s, d):
    found = retrieval.embeddings_of_files(chunks(s, d), files(s, d))
    return found.select("path", "id", "symbol_id")


@q("H24_hit_line", "SELECT hit_id, min(path || ':' || line_number || ': ' || trim(content)) AS line FROM search_hits WHERE path IS NOT NULL AND line_number IS NOT NULL AND content IS NOT NULL GROUP BY 1")
def _(s, d):
    h = table(s, d, "search_hits").where("path is not null and line_number is not null and content is not null")
    return h.groupBy("hit_id").agg(F.min(context.hit_line()).alias("line"))


# filters


@q("F02_symbol_exact", "SELECT DISTINCT id, name FROM symbols WHERE name = 'tree'")
def _(s, d):
    return symbols(s, d).where("name = 'tree'").select("id", "name")


@q("F03_symbol_fuzzy", "SELECT DISTINCT id, name FROM symbols WHERE name ILIKE '%parse%'")
def _(s, d):
    return symbols(s, d).where(F.ilike("name", F.lit("%parse%"))).select("id", "name")


@q("F04_by_visibility", "SELECT DISTINCT id, visibility FROM symbols WHERE visibility = 'protected'")
def _(s, d):
    return symbols(s, d).where("visibility = 'protected'").select("id", "visibility")


@q("F05_children", "SELECT c.parent_symbol_id AS parent_id, count(*) AS children FROM (SELECT DISTINCT id, parent_symbol_id FROM symbols) c WHERE c.parent_symbol_id IS NOT NULL GROUP BY 1")
def _(s, d):
    return symbols(s, d).where("parent_symbol_id is not null").groupBy(F.col("parent_symbol_id").alias("parent_id")).agg(F.count(F.lit(1)).alias("children"))


@q("F09_path_filter", "SELECT path FROM files WHERE contains(path, 'src/') OR (starts_with(path, 'atlas-core') AND ends_with(path, '.rs'))")
def _(s, d):
    return files(s, d).where(path_filter(["src/", "atlas-core/**/*.rs"], F.col("path"))).select("path")


@q("F10_glob", "SELECT path, ends_with(path, '.rs') AS any_rs, starts_with(path, 'atlas-core/') AND ends_with(path, '.py') AS one_star, starts_with(path, 'atlas-core') AND ends_with(path, '.ts') AS two_stars, contains(path, 'core') AS plain FROM files")
def _(s, d):
    p = F.col("path")
    return files(s, d).select("path", glob_match("*.rs", p).alias("any_rs"), glob_match("atlas-core/*.py", p).alias("one_star"), glob_match("atlas-core/**/*.ts", p).alias("two_stars"), glob_match("core", p).alias("plain"))


@q("F12_chunk_type", """SELECT DISTINCT id, CASE WHEN lower(chunk_type) IN ('function', 'method', 'fn') THEN 'function' WHEN lower(chunk_type) IN ('type', 'struct', 'class', 'enum', 'interface', 'trait') THEN 'type' WHEN lower(chunk_type) IN ('module', 'namespace', 'mod') THEN 'module'
WHEN lower(chunk_type) IN ('constant', 'const', 'static') THEN 'constant' WHEN lower(chunk_type) IN ('documentation', 'doc', 'comment') THEN 'documentation' ELSE 'code' END AS kind FROM chunk_embeddings""")
def _(s, d):
    return chunks(s, d).select("id", chunk_type(F.col("chunk_type")).alias("kind"))


@q("F13_ignored", r"SELECT path FROM files WHERE regexp_matches(path, '(^|/)\.git(/|$)') OR regexp_matches(path, '^(?:.*/)?node_modules/.*$') OR regexp_matches(path, '^(?:.*/)?[^/]*\.lock$')")
def _(s, d):
    return files(s, d).where(ignored(F.col("path"), ["**/node_modules/**", "**/*.lock"])).select("path")


@q("F16_included_types", r"SELECT path FROM files WHERE lower(regexp_extract(path, '\.([^./]+)$', 1)) IN ('rs', 'ts', 'tsx', 'js', 'jsx', 'py', 'go', 'java', 'md', 'json', 'toml', 'yaml', 'yml')")
def _(s, d):
    from kelpline.functions.globs import INCLUDED

    return files(s, d).where(extension(F.col("path")).isin(INCLUDED)).select("path")


@q("F19_known_visibility", "SELECT count(*) FILTER (visibility IS NOT NULL AND visibility <> 'unknown') AS known FROM (SELECT DISTINCT id, visibility FROM symbols)")
def _(s, d):
    return symbols(s, d).agg(F.count_if(F.col("visibility").isNotNull() & (F.col("visibility") != "unknown")).alias("known"))


@q("F21_with_embeddings", "SELECT path FROM files WHERE id IN (SELECT file_id FROM chunk_embeddings WHERE embedding IS NOT NULL)")
def _(s, d):
    return files(s, d).join(chunks(s, d).where("embedding is not null").select(F.col("file_id").alias("id")), "id", "left_semi").select("path")


# aggregates


@q("A01_counts", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM (SELECT DISTINCT id FROM symbols)) AS symbols, (SELECT count(DISTINCT id) FROM chunk_embeddings) AS embeddings")
def _(s, d):
    return retrieval.index_stats(files(s, d), symbols(s, d), chunks(s, d)).select("files", "symbols", "embeddings")


@q("A02_by_kind", "SELECT coalesce(kind, 'unknown') AS kind, count(*) AS n FROM (SELECT DISTINCT id, kind FROM symbols) GROUP BY 1")
def _(s, d):
    return symbols(s, d).groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@q("A03_by_visibility", "SELECT coalesce(visibility, 'unknown') AS visibility, count(*) AS n FROM (SELECT DISTINCT id, visibility FROM symbols) GROUP BY 1")
def _(s, d):
    return symbols(s, d).groupBy(F.coalesce("visibility", F.lit("unknown")).alias("visibility")).agg(F.count(F.lit(1)).alias("n"))


@q("A04_coverage", "SELECT count(*) FILTER (visibility <> 'unknown') AS with_visibility, count(parent_symbol_id) AS with_parent, round(100.0 * count(parent_symbol_id) / count(*), 1) AS parent_pct FROM (SELECT DISTINCT id, visibility, parent_symbol_id FROM symbols)")
def _(s, d):
    n = F.count_if(F.col("parent_symbol_id").isNotNull())
    return symbols(s, d).agg(F.count_if(F.col("visibility") != "unknown").alias("with_visibility"), n.alias("with_parent"), F.round(100.0 * n / F.count(F.lit(1)), 1).alias("parent_pct"))


@q("A06_files_having_chunks", "SELECT DISTINCT file_id FROM chunk_embeddings WHERE file_id IS NOT NULL")
def _(s, d):
    return table(s, d, "chunk_embeddings").where("file_id is not null").select("file_id").distinct()


@q("A07_totals_by_language", "SELECT coalesce(language, 'unknown') AS language, count(*) AS files, sum(size)::BIGINT AS bytes, max(modified_at) AS newest FROM files GROUP BY 1")
def _(s, d):
    return files(s, d).groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("modified_at").alias("newest"))


@q("A10_git_activity", """WITH top AS (SELECT * FROM (SELECT user_id AS path, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 50),
n AS (SELECT path, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS commits_7d, count(*) FILTER (ts >= TIMESTAMP '2024-01-01') AS commits_30d, (epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts)))) / 86400.0 AS days FROM top GROUP BY 1),
p AS (SELECT *, CASE WHEN commits_7d = 0 THEN 0 ELSE least(ln(commits_7d) / ln(10.0) + 0.3, 1) END AS a, least(commits_30d / (30 / 7.0) / 3, 1) AS b, exp(-0.1 * days) AS c FROM n)
SELECT path, commits_7d, commits_30d, round(a, 6) AS recent, round(b, 6) AS frequency, round(c, 6) AS recency, round(0.4 * a + 0.3 * b + 0.3 * c, 6) AS combined FROM p""")
def _(s, d):
    return retrieval.git_scores(table(s, d, "events").select(F.col("user_id").alias("path"), "ts"), NOW)


@q("A11_access_log", "SELECT user_id AS path, count(*) AS accesses, max(ts) AS last_access FROM events GROUP BY 1")
def _(s, d):
    log = table(s, d, "events").select(F.col("user_id").alias("path"), "ts", F.lit(False).alias("is_entry"), F.lit(0).alias("references"))
    return changes.access_state(log).select("path", "accesses", "last_access")


@q("A12_request_counts", "SELECT event_type AS tool, count(*) AS calls, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("error_rate"))


@q("A15_vector_reductions", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_min(embedding), 5) AS low, round(list_max(embedding), 5) AS high, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64, 5) AS mean FROM embeddings")
def _(s, d):
    e = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", F.round(vectors.norm(e), 5).alias("norm"), F.round(F.array_min(e).cast("double"), 5).alias("low"), F.round(F.array_max(e).cast("double"), 5).alias("high"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / 64, 5).alias("mean"))


@q("A16_mean_pooling", "SELECT label, i AS dim, round(avg(v), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def _(s, d):
    return table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@q("A18_checksum")
def _(s, d):
    return table(s, d, "embeddings").agg(F.count(F.lit(1)).alias("vectors"), F.bit_xor(F.xxhash64("vec_id", "embedding")).alias("checksum"))


@q("A19_lines_per_path", "SELECT path, count(*) AS hits FROM search_hits GROUP BY 1")
def _(s, d):
    return table(s, d, "search_hits").groupBy("path").agg(F.count(F.lit(1)).alias("hits"))


# ranking


_BM25 = _LINES + r""",
t AS (SELECT path, line_number, content, list_filter(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'), lambda x: strlen(x) <= 40) AS ts FROM lines),
st AS (SELECT count(*) AS n, sum(len(ts)) / count(*)::DOUBLE AS avgdl, count(*) FILTER (list_contains(ts, 'error')) AS d1, count(*) FILTER (list_contains(ts, 'checksum')) AS d2 FROM t),
tf AS (SELECT path, line_number, content, len(ts) AS dl, len(list_filter(ts, lambda x: x = 'error')) AS f1, len(list_filter(ts, lambda x: x = 'checksum')) AS f2 FROM t),
sc AS (SELECT path, line_number, content, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM tf, st WHERE f1 + f2 > 0)"""


@q("T01_bm25", "WITH " + _BM25 + " SELECT path, line_number, round(score, 4) AS score FROM sc ORDER BY sc.score DESC, path, line_number LIMIT 50")
def _(s, d):
    return search.bm25(search.text_lines(contents(s, d), "path", "text"), "error checksum", 50).select("path", "line_number", F.round("score", 4).alias("score"))


@q("T01_bm25_indexed", ORACLE["T01_bm25"])
def _(s, d):
    lines, where = search.text_lines(contents(s, d), "path", "text"), scratch(s, "postings")
    search.write_postings(lines, where)
    return search.bm25_indexed(lines, where, "error checksum", 50).select("path", "line_number", F.round("score", 4).alias("score"))


@q("T18_grep", "WITH " + _BM25 + " SELECT path, line_number, trim(content) AS content FROM sc ORDER BY score DESC, path, line_number LIMIT 50")
def _(s, d):
    return search.bm25(search.text_lines(contents(s, d), "path", "text"), "error checksum", 50).select("path", "line_number", F.trim("content").alias("content"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_COS = f"{_DOT.format(a='e.embedding', b='v.embedding')} / sqrt({_DOT.format(a='e.embedding', b='e.embedding')} * {_DOT.format(a='v.embedding', b='v.embedding')})"


def _query_vector(s, d) -> list[float]:
    return table(s, d, "embeddings").where("vec_id = 0").first()["embedding"]


@q("T03_vector_top_k", f"SELECT e.vec_id, round({_COS}, 5) AS similarity FROM embeddings e, embeddings v WHERE v.vec_id = 0 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def _(s, d):
    return retrieval.vector_top_k(table(s, d, "embeddings"), _query_vector(s, d), 10, keep=("vec_id",)).select("vec_id", F.round("similarity", 5).alias("similarity"))


@q("T04_vector_filtered", f"SELECT e.vec_id, round({_COS}, 5) AS similarity FROM embeddings e, embeddings v WHERE v.vec_id = 0 AND e.label = 3 AND {_COS} >= 0.1 ORDER BY {_COS} DESC, e.vec_id LIMIT 20")
def _(s, d):
    return retrieval.vector_top_k(table(s, d, "embeddings").where("label = 3"), _query_vector(s, d), 20, least=0.1, keep=("vec_id",)).select("vec_id", F.round("similarity", 5).alias("similarity"))


@q("F20_threshold_after_top_k", f"SELECT vec_id, round(c, 5) AS similarity FROM (SELECT e.vec_id, {_COS} AS c FROM embeddings e, embeddings v WHERE v.vec_id = 0 ORDER BY c DESC, e.vec_id LIMIT 20) WHERE c >= 0.3")
def _(s, d):
    return retrieval.vector_top_k(table(s, d, "embeddings"), _query_vector(s, d), 20, keep=("vec_id",)).where("similarity >= 0.3").select("vec_id", F.round("similarity", 5).alias("similarity"))


@q("J05_query_against_all", f"SELECT e.vec_id, round({_COS}, 5) AS similarity FROM embeddings e, embeddings v WHERE v.vec_id = 0")
def _(s, d):
    qv = F.array(*[F.lit(float(x)) for x in _query_vector(s, d)])
    return table(s, d, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), qv), 5).alias("similarity"))


_HITS = "(SELECT DISTINCT hit_id, query_id, path, content, line_number, score FROM search_hits)"


@q("T07_rank_fusion", f"""WITH k AS (SELECT path, line_number, row_number() OVER (ORDER BY score DESC, hit_id) AS r FROM {_HITS} WHERE query_id = 1 AND score IS NOT NULL QUALIFY r <= 120),
v AS (SELECT path, line_number, row_number() OVER (ORDER BY score DESC, hit_id) AS r FROM {_HITS} WHERE query_id = 2 AND score IS NOT NULL QUALIFY r <= 120),
u AS (SELECT path, line_number, 'Keyword' AS side, 0.5 / (60 + r) AS p FROM k UNION ALL SELECT path, line_number, 'Semantic', 0.5 / (60 + r) FROM v),
m AS (SELECT path, line_number, sum(p) AS score, CASE WHEN count(*) > 1 THEN 'Hybrid' ELSE min(side) END AS match_type FROM u GROUP BY 1, 2)
SELECT path, line_number::BIGINT AS line_number, round(m.score, 8) AS score, match_type FROM m ORDER BY round(m.score, 12) DESC, path, line_number LIMIT 40""")
def _(s, d):
    hits = table(s, d, "search_hits").distinct().where("score is not null")
    side = lambda n: hits.where(F.col("query_id") == n).orderBy(F.col("score").desc(), "hit_id").limit(120).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "hit_id")))
    return retrieval.fuse(side(1), side(2), 40).select("path", "line_number", F.round("score", 8).alias("score"), "match_type")


@q("J04_key_merge", f"""WITH r AS (SELECT query_id, path, line_number, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS r FROM {_HITS} WHERE query_id IS NOT NULL AND score IS NOT NULL),
u AS (SELECT path, line_number, CASE WHEN query_id % 2 = 0 THEN 'Keyword' ELSE 'Semantic' END AS side, 0.5 / (60 + r) AS p FROM r)
SELECT path, line_number::BIGINT AS line_number, round(sum(p), 8) AS score, CASE WHEN count(*) > 1 THEN 'Hybrid' ELSE min(side) END AS match_type FROM u GROUP BY 1, 2""")
def _(s, d):
    hits = table(s, d, "search_hits").distinct().where("score is not null and query_id is not null")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "hit_id")))
    merged = retrieval.fuse(ranked.where("query_id % 2 = 0"), ranked.where("query_id % 2 = 1"), None)
    return merged.select("path", "line_number", F.round("score", 8).alias("score"), "match_type")


@q("T09_top_k_per_group", f"SELECT query_id, hit_id, rank FROM (SELECT query_id, hit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM {_HITS} WHERE query_id IS NOT NULL AND score IS NOT NULL) WHERE rank <= 3")
def _(s, d):
    hits = table(s, d, "search_hits").distinct().where("score is not null and query_id is not null")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "hit_id"))).where("rank <= 3").select("query_id", "hit_id", long("rank"))


_FACTOR_NAMES = ["recency", "relevance", "centrality", "git_activity", "user_focus"]
_FACTORS = "(SELECT path, " + ", ".join(f"least(greatest(coalesce(max({c}::DOUBLE), 0), 0), 1) AS {c}" for c in _FACTOR_NAMES) + " FROM file_scores GROUP BY 1)"


def _factors(s, d):
    """The best of a path's scores over all queries, as factors between 0 and 1."""
    best = [F.least(F.greatest(F.coalesce(F.max(F.col(c).cast("double")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias(c) for c in _FACTOR_NAMES]
    return table(s, d, "file_scores").groupBy("path").agg(*best)


_SCORE = "0.25 * recency + 0.30 * relevance + 0.20 * centrality + 0.15 * git_activity + 0.10 * user_focus"


@q("T10_priority", f"SELECT path, round({_SCORE}, 6) AS score FROM {_FACTORS}")
def _(s, d):
    return retrieval.priority_ranking(_factors(s, d)).select("path", F.round("score", 6).alias("score"))


@q("F17_score_band", f"SELECT path, round({_SCORE}, 6) AS score FROM {_FACTORS} WHERE {_SCORE} BETWEEN 0.3000001 AND 0.5000001")
def _(s, d):
    return retrieval.priority_ranking(_factors(s, d), least=0.3000001, most=0.5000001).select("path", F.round("score", 6).alias("score"))


@q("T11_context", """WITH n AS (SELECT file_id, count(*) AS n FROM (SELECT DISTINCT id, file_id FROM symbols) GROUP BY 1),
r AS (SELECT f.path, greatest(0, least(1, exp(-((1767000000 - coalesce(f.indexed_at, f.modified_at)) / 3600.0) / 24))) AS recency, least(coalesce(n.n, 0) / 20.0, 1) AS centrality FROM files f LEFT JOIN n ON n.file_id = f.id),
x AS (SELECT path, 0.25 * recency + 0.3 * 0.5 + 0.2 * centrality + 0.15 * 0.5 + 0.1 * 0.5 AS score FROM r)
SELECT path, round(x.score, 6) AS score FROM x ORDER BY x.score DESC, path LIMIT 10""")
def _(s, d):
    return retrieval.context_ranking(files(s, d), symbols(s, d), None, None, NOW_S, 10).select("path", F.round("score", 6).alias("score"))


@q("T12_budget")
def _(s, d):
    docs = table(s, d, "documents")
    return retrieval.pack_budget(docs, 8000, F.col("n_chars") % 97, F.col("text"), F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("none"))).withColumnRenamed("key", "doc_id")


@q("T13_outline", "SELECT f.path, s.id, s.name, row_number() OVER (PARTITION BY s.file_id ORDER BY s.start_line NULLS FIRST, s.id) AS place FROM (SELECT DISTINCT id, file_id, name, start_line FROM symbols) s JOIN files f ON f.id = s.file_id")
def _(s, d):
    return retrieval.outline(symbols(s, d), files(s, d)).select("path", "id", "name", long("place"))


@q("T17_find_symbol", "SELECT DISTINCT s.id, s.name, f.path FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.name ILIKE '%cache%' AND lower(s.kind) = 'function' AND lower(s.visibility) = 'public'")
def _(s, d):
    return retrieval.find_symbols(symbols(s, d), files(s, d), "cache", fuzzy=True, kind="Function", visibility="PUBLIC").select("id", "name", "path")


@q("S18_recently_changed", "SELECT DISTINCT user_id AS path FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 HOUR")
def _(s, d):
    return retrieval.recently_changed(table(s, d, "events").select(F.col("user_id").alias("path"), "ts"), NOW, 30)


# scalar functions


@q("X01_language", r"""SELECT path, CASE lower(regexp_extract(path, '\.([^./]+)$', 1)) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'rb' THEN 'ruby' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java'
WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'json' THEN 'json' WHEN 'toml' THEN 'toml' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'md' THEN 'markdown' ELSE 'unknown' END AS language FROM files""")
def _(s, d):
    return files(s, d).select("path", language_of_extension(extension(F.col("path"))).alias("language"))


@q("X02_visibility", "SELECT DISTINCT id, CASE WHEN lower(visibility) IN ('public', 'pub') THEN 'public' WHEN lower(visibility) IN ('private', 'priv') THEN 'private' WHEN lower(visibility) = 'protected' THEN 'protected' WHEN lower(visibility) = 'internal' THEN 'internal' WHEN lower(visibility) IN ('crate', 'pub(crate)') THEN 'crate' ELSE 'unknown' END AS level FROM symbols")
def _(s, d):
    return symbols(s, d).select("id", visibility(F.col("visibility")).alias("level"))


@q("X03_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


@q("X04_normalise", r"SELECT DISTINCT id, trim(regexp_replace(lower(signature), '\s+', ' ', 'g')) AS norm FROM symbols")
def _(s, d):
    return symbols(s, d).select("id", normalise_query(F.col("signature")).alias("norm"))


@q("X05_cache_key", r"SELECT DISTINCT id, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) || ':20:0.30' AS key FROM symbols WHERE name IS NOT NULL")
def _(s, d):
    return symbols(s, d).where("name is not null").select("id", cache_key(F.col("name"), F.lit(20), F.lit(0.3)).alias("key"))


@q("X06_token_estimate", "SELECT doc_id, CAST(floor(strlen(text) / 4) AS BIGINT) AS tokens FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@q("X08_relative_path", "SELECT path, CASE WHEN starts_with(path, 'atlas-core/') THEN substr(path, 12) ELSE path END AS rel, regexp_extract(path, '([^.]*)$', 1) AS tag FROM files")
def _(s, d):
    return files(s, d).select("path", relative_path(F.col("path"), "atlas-core").alias("rel"), fence_tag(F.col("path")).alias("tag"))


@q("X11_first_line", "WITH " + _CONTENTS + " SELECT path, trim(string_split(text, chr(10))[1]) AS signature FROM contents")
def _(s, d):
    return contents(s, d).select("path", signature_line(F.col("text"), F.lit(1)).alias("signature"))


@q("X13_duration", "SELECT id, CASE WHEN size // 3600 > 0 THEN (size // 3600) || 'h ' || (size % 3600 // 60) || 'm ' || (size % 60) || 's' WHEN size % 3600 // 60 > 0 THEN (size % 3600 // 60) || 'm ' || (size % 60) || 's' ELSE (size % 60) || 's' END AS took FROM files")
def _(s, d):
    return files(s, d).select("id", duration(F.col("size")).alias("took"))


@q("M01_cosine_pairs", f"SELECT e.vec_id, round({_COS}, 5) AS similarity, round(1 - {_COS}, 5) AS distance FROM embeddings e JOIN embeddings v ON v.vec_id = e.vec_id + 1")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    v = table(s, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(v, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 5).alias("similarity"), F.round(vectors.distance(F.col("a"), F.col("b")), 5).alias("distance"))


@q("M03_normalise", "SELECT vec_id, i AS dim, round(v / sqrt(n), 5) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS n FROM embeddings)")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode(vectors.normalise(F.col("embedding"))).alias("dim", "x")).select("vec_id", long("dim"), F.round("x", 5).alias("x"))


_QUANT = "(SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i, list_min(embedding)::DOUBLE AS lo, (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) / 255 AS sc FROM embeddings)"


@q("M04_quantise", f"SELECT vec_id, i AS dim, greatest(-128, least(127, round((v - lo) / sc - 128)))::BIGINT AS q FROM {_QUANT}")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode(vectors.quantise(F.col("embedding"))["values"]).alias("dim", "q")).select("vec_id", long("dim"), long("q"))


@q("A17_quantisation_error", f"SELECT vec_id, round(avg(abs(v - ((q + 128) * sc + lo))), 6) AS mean_error, round(max(abs(v - ((q + 128) * sc + lo))), 6) AS max_error FROM (SELECT *, greatest(-128, least(127, round((v - lo) / sc - 128))) AS q FROM {_QUANT}) GROUP BY 1")
def _(s, d):
    e = table(s, d, "embeddings").withColumn("s", vectors.quantise(F.col("embedding")))
    back = vectors.dequantise(F.col("s.values"), F.col("s.min"), F.col("s.scale"))
    err = F.zip_with("embedding", back, lambda a, b: F.abs(a.cast("double") - b))
    return e.select("vec_id", F.round(F.aggregate(err, F.lit(0.0), lambda a, x: a + x) / F.size("embedding"), 6).alias("mean_error"), F.round(F.array_max(err), 6).alias("max_error"))


@q("M05_dequantise", "SELECT id, i AS dim, round((q::DOUBLE + 128) * sc + mn, 4) AS x FROM (SELECT id, unnest(embedding_quantized) AS q, generate_subscripts(embedding_quantized, 1) - 1 AS i, embedding_scale::DOUBLE AS sc, embedding_min::DOUBLE AS mn FROM (SELECT DISTINCT ON (id) * FROM chunk_embeddings WHERE embedding_quantized IS NOT NULL))")
def _(s, d):
    x = vectors.dequantise(F.col("embedding_quantized"), F.col("embedding_min"), F.col("embedding_scale"))
    return chunks(s, d).where("embedding_quantized is not null").select("id", F.posexplode(x).alias("dim", "x")).select("id", long("dim"), F.round("x", 4).alias("x"))


@q("M06_int_dot", "SELECT id, list_sum(list_transform(embedding_quantized, lambda x: x::BIGINT * x::BIGINT))::BIGINT AS dot FROM (SELECT DISTINCT ON (id) * FROM chunk_embeddings WHERE embedding_quantized IS NOT NULL AND len(embedding_quantized) > 0)")
def _(s, d):
    c = F.col("embedding_quantized")
    return chunks(s, d).where("embedding_quantized is not null and size(embedding_quantized) > 0").select("id", vectors.int_dot(c, c).alias("dot"))


@q("M09_recency", "SELECT id, round(greatest(0, least(1, exp(-((1767000000 - modified_at) / 3600.0) / 24))), 6) AS recency FROM files")
def _(s, d):
    return files(s, d).select("id", F.round(scores.recency((F.lit(NOW_S) - F.col("modified_at")) / 3600), 6).alias("recency"))


@q("M10_watch_score", "SELECT path, round(least(0.25 * exp(-(epoch(TIMESTAMP '2024-01-31') - floor(epoch(last))) / 3600) + 0.25 * least(ln(1 + n) / 10, 1) + 0.2 * least(ln(1 + n % 9) / 5, 1), 1), 6) AS score FROM (SELECT user_id AS path, count(*) AS n, max(ts) AS last FROM events GROUP BY 1)")
def _(s, d):
    n = table(s, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    seconds = F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return n.select("path", F.round(scores.watch_score(F.lit(False), seconds, F.col("n"), F.col("n") % 9), 6).alias("score"))


@q("M13_tier", f"SELECT path, CASE WHEN {_SCORE} >= 0.7 THEN 'High' WHEN {_SCORE} >= 0.4 THEN 'Medium' ELSE 'Low' END AS tier FROM {_FACTORS} WHERE abs({_SCORE} - 0.4) > 1e-9 AND abs({_SCORE} - 0.7) > 1e-9")
def _(s, d):
    x = scores.weighted()
    return _factors(s, d).where((F.abs(x - 0.4) > 1e-9) & (F.abs(x - 0.7) > 1e-9)).select("path", scores.score_tier(x).alias("tier"))


@q("Y01_json_lists", "SELECT DISTINCT id, len(type_parameters)::BIGINT AS n FROM symbols WHERE len(type_parameters) > 0")
def _(s, d):
    back = decode_list(encode_list(F.col("type_parameters")))
    return symbols(s, d).select("id", F.size(back).cast("bigint").alias("n")).where("n > 0")


@q("Y02_json_parameters", "SELECT DISTINCT id, parameters[1].name AS first_name, parameters[1].type AS first_type FROM symbols WHERE len(parameters) > 0")
def _(s, d):
    from kelpline.functions.jsoncols import PARAMETERS

    back = decode_list(encode_list(F.col("parameters")), PARAMETERS)
    return symbols(s, d).where("size(parameters) > 0").select("id", back[0]["name"].alias("first_name"), back[0]["type"].alias("first_type"))


# chunks, extraction, manifests


@q("U01_fixed_chunks", "WITH " + _CONTENTS + r""", l AS (SELECT path, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM contents), n AS (SELECT path, ls, len(ls) AS n, ceil(greatest(len(ls) - 25, 0) / 23.0)::BIGINT AS last FROM l),
s AS (SELECT path, n, k * 23 AS s, k FROM (SELECT *, unnest(range(last + 1)) AS k FROM n) UNION ALL SELECT path, n, n - 2, last + 1 FROM n WHERE n - 2 > last * 23)
SELECT path, k AS chunk_no, s + 1 AS start_line, least(s + 25, n) AS end_line FROM s""")
def _(s, d):
    return chunking.fixed_chunks(contents(s, d), "path", "text", 2048, 0.1).select("path", "chunk_no", "start_line", "end_line")


@q("U02_semantic_chunks")
def _(s, d):
    return chunking.chunks(contents(s, d), "path", "text", "semantic")


@q("U03_recursive_chunks")
def _(s, d):
    return chunking.chunks(contents(s, d), "path", "text", "recursive", 512, 0.1)


@q("U05_extract_symbols")
def _(s, d):
    from kelpline.operators.extract import extract_symbols

    return extract_symbols(contents(s, d), "path", "language", "text").select("path", "error", "ordinal", "name", "kind", "start_line", "end_line", "visibility", "parent_name")


def manifest_texts(s, d, name):
    """The documents of that name in the tables."""
    return contents(s, d).where(F.substring_index("path", "/", -1) == name).select("text")


@q("S20_cargo")
def _(s, d):
    return manifests.cargo(manifest_texts(s, d, "Cargo.toml"))


_NAMED = "WITH " + _CONTENTS + ", docs AS (SELECT text FROM contents WHERE regexp_extract(path, '[^/]*$') = '{}')"


@q("S21_package_json", _NAMED.format("package.json") + """, j AS (SELECT TRY_CAST(text AS JSON) AS j FROM docs),
p AS (SELECT j -> '$.dependencies' AS m, 'Runtime' AS t FROM j UNION ALL SELECT j -> '$.devDependencies', 'Development' FROM j UNION ALL SELECT j -> '$.peerDependencies', 'Peer' FROM j),
e AS (SELECT t, unnest(map_entries(TRY_CAST(m AS MAP(VARCHAR, JSON)))) AS e FROM p WHERE json_type(m) = 'OBJECT')
SELECT e.key AS name, CASE WHEN json_type(e.value) = 'VARCHAR' THEN e.value ->> '$' END AS version, t AS dep_type, 'Npm' AS source FROM e""")
def _(s, d):
    return manifests.package_json(manifest_texts(s, d, "package.json"))


@q("S22_requirements", _NAMED.format("requirements.txt") + r""", l AS (SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '\r$', '')) AS l FROM docs)
SELECT regexp_extract(l, '^([^=><!~]*)', 1) AS name, nullif(regexp_extract(l, '^[^=><!~]*([=><!~].*)$', 1), '') AS version, 'Runtime' AS dep_type, 'PyPi' AS source FROM l WHERE l <> '' AND l NOT LIKE '#%' AND l NOT LIKE '-%'""")
def _(s, d):
    return manifests.requirements(manifest_texts(s, d, "requirements.txt"))


@q("S23_pyproject")
def _(s, d):
    return manifests.pyproject(manifest_texts(s, d, "pyproject.toml"))


# streams


_KINDS = "CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' ELSE 'Modified' END"


def _events(s, d):
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "error", "Deleted").otherwise("Modified")
    return table(s, d, "events").select(F.col("user_id").alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


_STATE = "(SELECT user_id AS path, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY 1)"
_TIER = "CASE WHEN (epoch(TIMESTAMP '2024-01-31') - floor(epoch(s.last))) < 86400 THEN 'Hot' WHEN s.n % 9 > 5 OR s.n > 10 THEN 'Warm' ELSE 'Cold' END"


@q("W01_tiers", f"SELECT s.path, {_TIER} AS tier FROM {_STATE} s")
def _(s, d):
    n = table(s, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    seconds = F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return n.select("path", changes.tier(F.lit(False), seconds, F.col("n") % 9, F.col("n"), 86_400).alias("tier"))


@q("W02_routing", f"""WITH t AS (SELECT e.event_id, {_KINDS} AS kind, CASE WHEN s.path IS NULL THEN 'Cold' WHEN (epoch(TIMESTAMP '2024-01-31') - floor(epoch(s.last))) < 300 THEN 'Hot' WHEN s.n > 10 THEN 'Warm' ELSE 'Cold' END AS tier FROM events e LEFT JOIN {_STATE} s ON e.user_id = s.path)
SELECT kind, tier, CASE WHEN kind = 'Deleted' THEN 'RemoveFromIndex' WHEN tier = 'Hot' THEN 'IndexImmediate' WHEN tier = 'Warm' THEN 'QueueForIndex' ELSE 'Ignore' END AS action, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def _(s, d):
    log = table(s, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("path"), "ts", F.lit(False).alias("is_entry"), F.lit(0).alias("references"))
    routed = changes.route(_events(s, d), changes.access_state(log), F.lit(NOW))
    return routed.groupBy("kind", "tier", "action").agg(F.count(F.lit(1)).alias("n"))


@q("W04_debounce", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 60 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)
SELECT user_id AS path, min(ts) AS first_ts, max(ts) + INTERVAL 60 SECOND AS ready_at, count(*) AS events FROM b GROUP BY user_id, burst""")
def _(s, d):
    out = changes.debounce(_events(s, d), "60 seconds")
    return out.select("path", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("ready_at").cast("timestamp_ntz").alias("ready_at"), "events")


@q("W10_result_chunks", "SELECT rank, (rank - 1) // 10 AS chunk, least(((rank - 1) // 10 + 1) * 10, n) >= n AS is_last, 100 * least(((rank - 1) // 10 + 1) * 10, n) // n AS progress FROM (SELECT row_number() OVER (ORDER BY path) AS rank, count(*) OVER () AS n FROM files)")
def _(s, d):
    ranked = global_rank(files(s, d).select("path"), "path")
    e = results.envelope(F.col("rank"), F.lit(ranked.count()))
    return ranked.select("rank", e["chunk"].alias("chunk"), e["is_last"].alias("is_last"), e["progress"].alias("progress"))


@q("S25_listing_changes", "WITH a AS (SELECT path, max(modified_at) AS modified_at, max(size) AS size FROM file_inserts WHERE batch_no <= 3 GROUP BY 1) SELECT coalesce(a.path, f.path) AS path, CASE WHEN a.path IS NULL THEN 'Created' WHEN f.path IS NULL THEN 'Deleted' ELSE 'Modified' END AS kind FROM a FULL JOIN files f ON a.path = f.path WHERE a.path IS NULL OR f.path IS NULL OR a.modified_at IS DISTINCT FROM f.modified_at OR a.size IS DISTINCT FROM f.size")
def _(s, d):
    before = table(s, d, "file_inserts").where("batch_no <= 3").groupBy("path").agg(F.max("modified_at").alias("modified_at"), F.max("size").alias("size"))
    return changes.listing_changes(before, files(s, d))


@q("C10_ping", "SELECT 'ok' AS status")
def _(s, d):
    return s.range(1).select(F.lit("ok").alias("status"))
