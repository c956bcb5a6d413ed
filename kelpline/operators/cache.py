"""Driver-side caches for small results: TTL, LRU and a result cache that knows the index version."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable


class Cache:
    """LRU with optional time to live; an expired entry is dropped when it is asked for, an insert renews it."""

    def __init__(self, capacity: int = 100, ttl: float | None = None, clock: Callable[[], float] = time.monotonic):
        if capacity <= 0:
            raise ValueError("capacity must be positive")
        self.capacity, self.ttl, self.clock = capacity, ttl, clock
        self.rows: OrderedDict[Hashable, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Hashable):
        held = self.rows.get(key)
        if held is None or self.ttl is not None and self.clock() - held[0] >= self.ttl:
            self.rows.pop(key, None)
            self.misses += 1
            return None
        self.rows.move_to_end(key)
        self.hits += 1
        return held[1]

    def put(self, key: Hashable, value: object) -> None:
        self.rows.pop(key, None)
        self.rows[key] = (self.clock(), value)
        while len(self.rows) > self.capacity:
            self.rows.popitem(last=False)

    def cleanup(self) -> int:
        old = [k for k, (t, _) in self.rows.items() if self.ttl is not None and self.clock() - t >= self.ttl]
        for k in old:
            del self.rows[k]
        return len(old)

    def clear(self) -> None:
        self.rows.clear()

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


class ResultCache(Cache):
    """Keys hold all options and the index version, so no filter or write is ever missed."""

    def __init__(self, capacity: int = 100, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        super().__init__(capacity, ttl, clock)
        self.version = 0

    def key(self, query: str, **options: object) -> tuple:
        return (" ".join(query.lower().split()), self.version, tuple(sorted((k, repr(v)) for k, v in options.items())))

    def bump(self) -> None:
        self.version += 1
