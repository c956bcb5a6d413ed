"""One object with the queries a user runs over an indexed folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.embedding import embed, embed_text, symbol_text
from kelpline.functions.text import search_mode
from kelpline.operators import retrieval, search, tables
from kelpline.operators.cache import ResultCache
from kelpline.operators.extract import extract_symbols
from kelpline.sources import corpus as scan
from kelpline.sources.config import Config
from kelpline.streaming.changes import debounce_live, route


class NotIndexed(RuntimeError):
    """Raised where a query needs an index that is still empty."""

    suggestions = ("run reindex(root) first",)


class Corpus:
    def __init__(self, spark: SparkSession, home: str, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.store, self.cache = tables.Store(spark, home), ResultCache(ttl=float((config or Config()).search.cache_ttl_seconds))

    @classmethod
    def open(cls, home: str, config: Config | None = None) -> Corpus:
        return cls(SparkSession.active(), home, config)

    def ping(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "version": self.store.version}

    def reindex(self, root: str, now: int | None = None) -> dict:
        """Scans, skips unchanged contents, prunes vanished files, and commits all tables at once."""
        c = self.config.indexing
        ignore = scan.ignore_globs(self.spark, root, c.ignore_patterns)
        walked = scan.walk(self.spark, root, c.max_file_size, c.include_types, ignore)
        read = scan.read_files(walked).where("error is null")
        return self._index(read, tables.vanished_files(self.store.read("files"), read).select("path"), now)

    def index_files(self, root: str, paths: list[str], now: int | None = None) -> dict:
        """Brings the named files of a folder up to date: new and changed ones are indexed, vanished ones removed."""
        c = self.config.indexing
        ignore = scan.ignore_globs(self.spark, root, c.ignore_patterns)
        read = scan.read_files(scan.read_paths(self.spark, root, paths, c.max_file_size, c.include_types, ignore)).where("error is null")
        named = self.spark.createDataFrame([(p,) for p in paths], "path string")
        known = self.store.read("files").join(named, "path", "left_semi")
        return self._index(read, tables.vanished_files(known, read).select("path"), now)

    def apply_changes(self, root: str, routed: DataFrame, now: int | None = None) -> dict:
        """Consumes a batch of routed events (path, kind, action): what is to be indexed or removed is, the rest waits."""
        act = routed.where(F.col("action") != "Ignore").select("path").distinct()
        return self.index_files(root, [r["path"] for r in act.collect()], now)  # the paths of one micro-batch

    def watch(self, root: str, events: DataFrame, access_log, checkpoint: str):
        """Indexes a stream of change events: bursts are held until they are quiet, whatever micro-batches they span."""
        held = debounce_live(events)

        def step(batch: DataFrame, batch_id: int) -> None:
            if not batch.isEmpty():
                self.apply_changes(root, route(batch.withColumn("ts", F.current_timestamp()), access_log()))

        return held.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()

    def _index(self, read: DataFrame, gone: DataFrame, now: int | None) -> dict:
        c, now = self.config.indexing, int(time.time()) if now is None else now
        old = {n: self.store.read(n) for n in ("files", "symbols", "embeddings", "lines")}
        new = tables.changed_files(old["files"], read).persist()
        clean = tables.delete_files(old, gone.unionByName(new.join(old["files"].select("path"), "path", "left_semi").select("path")))
        pruned = old["files"].join(gone, "path", "left_anti")
        files = tables.upsert_files(pruned, new.select("path", "hash", "modified_at", "size", "language"), now)
        parsed = extract_symbols(new, "path", "language", "text").where("error is null")
        with_id = parsed.withColumn("id", F.xxhash64("path", "name", "start_line", "ordinal"))
        linked = tables.link_parents(with_id).withColumn("file_id", F.xxhash64("path"))
        ids = files.select(F.col("path").alias("f_path"), F.col("id").alias("f_id"))
        linked = linked.join(ids, F.col("path") == F.col("f_path"), "left").withColumn("file_id", F.coalesce("f_id", "file_id"))
        symbols = clean["symbols"].unionByName(tables.conform(linked, tables.SYMBOLS))
        lines = clean["lines"].unionByName(search.text_lines(new, "path", "text"))
        chunk = new.join(ids, F.col("path") == F.col("f_path")).select(F.xxhash64("path", F.lit("file")).alias("id"), F.lit(None).cast("bigint").alias("symbol_id"), F.col("f_id").alias("file_id"), F.col("text").alias("chunk_text"), F.lit("file").alias("chunk_type"))
        named = linked.select(F.xxhash64("path", "id").alias("id"), F.col("id").alias("symbol_id"), "file_id", symbol_text().alias("chunk_text"), F.lit("symbol").alias("chunk_type"))
        embedded = embed(chunk.unionByName(named), ["id", "symbol_id", "file_id", "chunk_text", "chunk_type"], "chunk_text") if c.enable_embeddings else chunk.limit(0)
        embeddings = clean["embeddings"].unionByName(tables.conform(embedded, tables.EMBEDDINGS))
        self.store.write({"files": files, "symbols": symbols, "lines": lines, "embeddings": embeddings})
        done = {"indexed": new.count(), "removed": gone.count(), "version": self.store.version}
        new.unpersist()
        self.cache.bump()
        return done

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        if self.store.version == 0:
            raise NotIndexed("the index is empty")
        return tuple(self.store.read(n) for n in ("files", "symbols", "embeddings", "lines"))  # type: ignore[return-value]

    def _cached(self, name: str, query: str, make, **options) -> list[dict]:
        key = (name, *self.cache.key(query, **options))
        rows = self.cache.get(key)
        if rows is None:
            rows = [r.asDict() for r in make().collect()]  # at most `limit` rows
            self.cache.put(key, rows)
        return rows

    def context_grep(self, query: str, limit: int = 50) -> list[dict]:
        *_, lines = self._tables()
        return self._cached("grep", query, lambda: search.bm25(lines, query, limit).withColumn("content", F.trim("content")), limit=limit)

    def context_search(self, query: str, limit: int = 20, mode: str = "hybrid") -> list[dict]:
        files, symbols, embeddings, lines = self._tables()
        vector = embed_text(query) if self.config.indexing.enable_embeddings else None
        both = lambda: retrieval.hybrid(lines, retrieval.embeddings_with_paths(embeddings, symbols, files), query, vector, limit, search_mode(mode))
        return self._cached("search", query, both, limit=limit, mode=search_mode(mode))

    def semantic_search(self, query: str, limit: int = 10, min_similarity: float = 0.5, paths: list[str] | None = None, types: list[str] | None = None) -> list[dict]:
        files, symbols, embeddings, _ = self._tables()
        rows = lambda: retrieval.vector_top_k(retrieval.embeddings_with_paths(embeddings, symbols, files), embed_text(query), limit, min_similarity, paths, types, keep=("path", "line_number", "chunk_text", "chunk_type"))
        return self._cached("semantic", query, rows, limit=limit, least=min_similarity, paths=paths, types=types)

    def find_symbol(self, name: str, kind: str | None = None, visibility: str | None = None, fuzzy: bool = False) -> DataFrame:
        files, symbols, *_ = self._tables()
        return retrieval.find_symbols(symbols, files, name, fuzzy, kind, visibility)

    def get_file_outline(self, path: str) -> DataFrame:
        files, symbols, *_ = self._tables()
        return retrieval.outline(symbols, files, path)

    def index_status(self) -> dict:
        files, symbols, embeddings, _ = self._tables()
        return retrieval.index_stats(files, symbols, embeddings).first().asDict()

    def get_relevant_context(self, query: str | None = None, paths: list[str] | None = None, limit: int = 10, min_score: float = 0.0, weights: dict[str, float] | None = None, now: int | None = None) -> DataFrame:
        files, symbols, _, lines = self._tables()
        return retrieval.context_ranking(files, symbols, lines, query, int(time.time()) if now is None else now, limit, min_score, paths, weights)

    def remove_file(self, path: str) -> None:
        held = {n: self.store.read(n) for n in ("files", "symbols", "embeddings", "lines")}
        self.store.write(tables.delete_files(held, self.spark.createDataFrame([(path,)], "path string")))
        self.cache.bump()

    @property
    def has_embeddings(self) -> bool:
        return not self.store.read("embeddings").isEmpty()

    def index_dir_size(self) -> int:
        return self.store.files.size("")
