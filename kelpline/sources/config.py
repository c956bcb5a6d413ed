"""Configuration: sections with defaults, read from the first file found, validated, reloaded when it changes."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field

from kelpline.functions.globs import IGNORED, INCLUDED

NAME = "kelpline"


@dataclass
class Indexing:
    max_file_size: int = 500
    ignore_patterns: list[str] = field(default_factory=lambda: list(IGNORED))
    include_types: list[str] = field(default_factory=lambda: list(INCLUDED))
    enable_embeddings: bool = True
    embedding_batch_size: int = 64


@dataclass
class Watching:
    enabled: bool = True
    debounce_ms: int = 1000
    hot_threshold_seconds: int = 300


@dataclass
class Context:
    default_max_tokens: int = 8000
    chunking_strategy: str = "semantic"
    chunk_size: int = 512
    chunk_overlap: float = 0.1


@dataclass
class Git:
    enabled: bool = True
    max_commits: int = 1000
    include_blame: bool = True


@dataclass
class Search:
    min_similarity: float = 0.3
    fusion_k: int = 60
    cache_ttl_seconds: int = 300


@dataclass
class Config:
    indexing: Indexing = field(default_factory=Indexing)
    watching: Watching = field(default_factory=Watching)
    context: Context = field(default_factory=Context)
    git: Git = field(default_factory=Git)
    search: Search = field(default_factory=Search)

    def validate(self) -> list[str]:
        bad = []
        if self.indexing.max_file_size <= 0:
            bad.append("indexing.max_file_size must be positive")
        if not self.indexing.include_types:
            bad.append("indexing.include_types must not be empty")
        if self.watching.debounce_ms <= 0:
            bad.append("watching.debounce_ms must be positive")
        if not 0 <= self.context.chunk_overlap < 1:
            bad.append("context.chunk_overlap must be in [0, 1)")
        if self.context.chunking_strategy not in ("semantic", "fixed", "recursive"):
            bad.append("context.chunking_strategy is unknown")
        return bad


def parse(text: str) -> Config:
    """Unknown keys and sections are ignored; missing ones keep their defaults."""
    doc, parts = tomllib.loads(text), {}
    for f in dataclasses.fields(Config):
        kind = f.default_factory
        known = {x.name for x in dataclasses.fields(kind)}
        parts[f.name] = kind(**{k: v for k, v in doc.get(f.name, {}).items() if k in known})
    return Config(**parts)


def candidates() -> list[str]:
    home = os.path.expanduser("~")
    return [f".{NAME}.toml", f"{os.environ.get('XDG_CONFIG_HOME', home + '/.config')}/{NAME}/config.toml", f"{home}/.{NAME}.toml"]


def load() -> Config:
    for path in candidates():
        if os.path.exists(path):
            with open(path) as f:
                return parse(f.read())
    return Config()


class Reloader:
    """Holds the last valid configuration; ``poll`` swaps in a changed file only if it parses and validates."""

    def __init__(self, path: str):
        self.path, self.current, self.problems, self._seen = path, Config(), [], None

    def poll(self) -> bool:
        stamp = os.stat(self.path).st_mtime_ns if os.path.exists(self.path) else None
        if stamp is None or stamp == self._seen:
            return False
        self._seen = stamp
        try:
            with open(self.path) as f:
                new = parse(f.read())
            self.problems = new.validate()
        except (tomllib.TOMLDecodeError, TypeError) as e:
            self.problems = [str(e)]
        if self.problems:
            return False
        self.current = new
        return True
