"""Answers of recent queries, forgotten when the collection changes."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable
from typing import Any


def cache_key(query: str, codebase: str | None = None) -> str:
    """A hash of query and codebase, then the query itself; a missing codebase differs from any name."""
    part = b"\x00" if codebase is None else b"\x01" + codebase.encode()
    return hashlib.sha256(query.encode() + b"\xff" + part).hexdigest()[:16] + "_" + query


class QueryCache:
    """The latest ``size`` values by query and codebase; the one not used for longest goes first."""

    def __init__(self, size: int = 1000):
        if size < 1:
            raise ValueError("a cache holds at least one value")
        self.size, self.version, self.hits, self.misses = size, 0, 0, 0
        self._held: OrderedDict[str, tuple[int, Any]] = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def get(self, query: str, codebase: str | None = None) -> Any | None:
        key = cache_key(query, codebase)
        found = self._held.get(key)
        if found is None or found[0] != self.version:
            self._held.pop(key, None)
            self.misses += 1
            return None
        self._held.move_to_end(key)
        self.hits += 1
        return found[1]

    def put(self, query: str, value: Any, codebase: str | None = None) -> None:
        key = cache_key(query, codebase)
        self._held[key] = (self.version, value)
        self._held.move_to_end(key)
        while len(self._held) > self.size:
            self._held.popitem(last=False)

    def get_or(self, query: str, make: Callable[[], Any], codebase: str | None = None) -> Any:
        value = self.get(query, codebase)
        if value is None:
            value = make()
            self.put(query, value, codebase)
        return value

    def warm(self, queries: list[str], make: Callable[[str], Any], codebase: str | None = None) -> None:
        for q in queries:
            self.put(q, make(q), codebase)

    def invalidate(self) -> None:
        """What was stored before is stale."""
        self.version += 1

    def clear(self) -> None:
        self._held.clear()
        self.hits = self.misses = 0

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}
