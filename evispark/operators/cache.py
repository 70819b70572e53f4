"""Result and embedding caches as tables."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_key(text: str = "text", model: str = "default"):
    """Hash of the lower-cased text with single spaces, and the model."""
    return F.sha2(F.concat_ws("|", F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(model)), 256)


def split_hits(wanted: DataFrame, cache: DataFrame, now, ttl_seconds: int, model: str = "default") -> tuple[DataFrame, DataFrame]:
    """Rows whose embedding is cached and fresh, with it, and rows that must be computed."""
    keyed = wanted.withColumn("key", text_key("text", model))
    fresh = cache.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {ttl_seconds} SECONDS")).select("key", "embedding")
    return keyed.join(fresh, "key"), keyed.join(fresh, "key", "left_anti")


def expired(cache: DataFrame, now, ttl_seconds: int) -> DataFrame:
    return cache.filter(F.col("created_at") < now - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def hit_rates(log: DataFrame, key: str, at: str, ttl_seconds: int) -> DataFrame:
    """Hits and misses of a TTL cache over a request log: a request hits when the one before with its key is recent enough."""
    from pyspark.sql import Window

    micros = F.unix_micros(F.col(at).cast("timestamp"))
    before = F.lag(micros).over(Window.partitionBy(key).orderBy(at, "event_id"))
    hit = micros - before <= ttl_seconds * 1_000_000
    return log.withColumn("hit", F.coalesce(hit, F.lit(False)))


class QueryCache:
    """Cached DataFrames by query name and parameters: least recently used first out, and built again once older than ``ttl_seconds`` (0: never)."""

    def __init__(self, size: int = 32, ttl_seconds: float = 3600, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl_seconds, clock
        self.held, self.hits, self.misses = OrderedDict(), 0, 0

    @staticmethod
    def key(name: str, parameters: dict) -> str:
        return hashlib.sha256(json.dumps([name, parameters], sort_keys=True, default=str).encode()).hexdigest()

    def get(self, name: str, parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
        key, now = self.key(name, parameters), self.clock()
        if key in self.held and self.ttl and now - self.held[key][2] > self.ttl:
            self.held.pop(key)[1].unpersist()
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
        else:
            self.misses += 1
            self.held[key] = (name, build().persist(), now)
            while len(self.held) > self.size:
                self.held.popitem(last=False)[1][1].unpersist()
        return self.held[key][1]

    def invalidate(self, part: str = "") -> int:
        """Drops entries whose query name contains ``part``; returns how many."""
        gone = [k for k, (name, *_) in self.held.items() if part in name]
        for k in gone:
            self.held.pop(k)[1].unpersist()
        return len(gone)

    def clean(self) -> int:
        """Drops expired entries; returns how many."""
        now = self.clock()
        gone = [k for k, (_, _, at) in self.held.items() if self.ttl and now - at > self.ttl]
        for k in gone:
            self.held.pop(k)[1].unpersist()
        return len(gone)

    def stats(self) -> dict:
        total = self.hits + self.misses
        return {"entries": len(self.held), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / total if total else 0.0}
