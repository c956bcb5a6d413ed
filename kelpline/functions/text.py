"""String expressions: languages, visibilities, hashes, query keys, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language.
EXTENSIONS = {
    "rust": ["rs"],
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py", "pyi"],
    "ruby": ["rb", "rake", "gemspec"],
    "go": ["go"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx"],
    "json": ["json"],
    "toml": ["toml"],
    "yaml": ["yaml", "yml"],
    "markdown": ["md", "markdown"],
}
# Chunk type aliases of the search layer; anything else is code.
CHUNK_TYPES = {
    "function": ["function", "method", "fn"],
    "type": ["type", "struct", "class", "enum", "interface", "trait"],
    "module": ["module", "namespace", "mod"],
    "constant": ["constant", "const", "static"],
    "documentation": ["documentation", "doc", "comment"],
}
# Accepted spellings of a visibility; anything else is unknown.
VISIBILITIES = {
    "public": ["public", "pub"],
    "private": ["private", "priv"],
    "protected": ["protected"],
    "internal": ["internal"],
    "crate": ["crate", "pub(crate)"],
}
# Search modes; anything else is hybrid.
SEARCH_MODES = {"keyword": ["keyword", "text", "fulltext"], "semantic": ["semantic", "vector", "embedding"]}


def _choose(c: Column, table: dict[str, list[str]], other: str) -> Column:
    out = None
    for name, spellings in table.items():
        hit = F.lower(c).isin(spellings)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def language_of_extension(ext: Column) -> Column:
    return _choose(ext, EXTENSIONS, "unknown")


def chunk_type(c: Column) -> Column:
    return _choose(c, CHUNK_TYPES, "code")


def visibility(c: Column) -> Column:
    return _choose(c, VISIBILITIES, "unknown")


def search_mode(mode: str | None) -> str:
    return next((m for m, names in SEARCH_MODES.items() if (mode or "").lower() in names), "hybrid")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    """16 hexadecimal digits of a 64-bit hash."""
    return F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def normalise_query(q: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(q), r"\s+", " "))


def cache_key(q: Column, limit: Column, least: Column) -> Column:
    return F.format_string("%s:%d:%.2f", normalise_query(q), limit.cast("bigint"), least.cast("double"))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def fence_tag(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def signature_line(content: Column, start_line: Column) -> Column:
    return F.trim(F.try_element_at(F.split(content, "\n"), start_line.cast("int")))


def lines(text: Column) -> Column:
    """Lines without their terminators; a final terminator opens no further line."""
    return F.transform(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at most 40 bytes."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda t: F.octet_length(t) <= 40)


def duration(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))
