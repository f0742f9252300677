"""A semantic response cache."""

from __future__ import annotations

import functools
import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Database
from .embed import get_embedder


@dataclass
class CacheStats:
    hits: int = 0
    misses: int = 0
    saved_ms: float = 0.0

    @property
    def total_queries(self) -> int:
        return self.hits + self.misses

    @property
    def hit_rate(self) -> float:
        return self.hits / self.total_queries if self.total_queries else 0.0


def statistics(calls: DataFrame, hit: Column, saved: str) -> DataFrame:
    """One row, ``total_queries, hit_rate, saved_ms``, of a log of calls."""
    one = calls.agg(F.count("*").alias("total_queries"), F.avg(hit.cast("double")).alias("hit_rate"), F.sum(F.when(hit, F.col(saved)).otherwise(0.0)).alias("saved_ms"))
    return one.select("total_queries", F.coalesce("hit_rate", F.lit(0.0)).alias("hit_rate"), F.coalesce("saved_ms", F.lit(0.0)).alias("saved_ms"))


def latencies(calls: DataFrame, by: str, value: str) -> DataFrame:
    """``<by>, n, mean, low, high`` of each kind of call."""
    return calls.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


class SemanticCache:
    """Responses under the meaning of their queries."""

    def __init__(self, database: Database, embedder=None, threshold: float = 0.92, ttl: int | None = None, name: str = "cache"):
        self.database, self.embedder, self.threshold, self.ttl, self.name = database, get_embedder(embedder), threshold, ttl, name
        self.collection = database.collection(name, self.embedder.dimension, "cosine")
        self.stats = CacheStats()

    @staticmethod
    def key(query: str) -> str:
        return hashlib.sha256(query.encode()).hexdigest()[:16]

    def set(self, query: str, response: Any, ttl: int | None = None, duration_ms: float = 0.0, metadata: dict | None = None) -> str:
        """Store a response; a ttl of 0 counts as none given. Extra metadata overrides."""
        i, v = self.key(query), self.embedder.embed_single(query)
        meta = {"query": query, "response": response, "duration_ms": duration_ms, "cached_at": self.database.clock()} | (metadata or {})
        self.collection.upsert(i, v, meta, ttl or self.ttl)
        self.collection.flush()
        return i

    def get(self, query: str, threshold: float | None = None) -> Any:
        """The nearest query's response, if it is near enough; else None. Only hits are counted here."""
        import json

        best = self.collection.search(self.embedder.embed_single(query), 1).where(F.col("score") >= (threshold or self.threshold)).collect()
        if not best:
            return None
        meta = json.loads(best[0]["metadata"])
        self.stats.hits += 1
        self.stats.saved_ms += meta.get("duration_ms") or 0.0
        return meta.get("response")

    def invalidate(self, query: str) -> bool:
        return self.collection.delete(self.key(query))

    def invalidate_similar(self, query: str, threshold: float = 0.85, most: int | None = 100) -> int:
        """Delete the ``most`` nearest entries over the threshold; None: all of them."""
        k = most if most is not None else max(1, len(self.collection))
        ids = self.collection.search(self.embedder.embed_single(query), k).where(F.col("score") >= threshold).select("id").persist()
        if n := ids.count():
            self.collection.delete_frame(ids)
        ids.unpersist()
        return n

    def clear(self) -> None:
        self.database.drop_collection(self.name)
        self.collection = self.database.collection(self.name, self.embedder.dimension, "cosine")
        self.stats = CacheStats()

    @staticmethod
    def call_key(name: str, args: tuple, kwargs: dict, key_fn: Callable[..., str] | None = None) -> str:
        """What a call is cached under: ``key_fn``'s answer, else a text that is the first positional
        argument, else the function's name with all arguments."""
        if key_fn is not None:
            return key_fn(*args, **kwargs)
        first = args[0] if args else None
        return first if isinstance(first, str) else f"{name}:{args}:{kwargs}"

    def cached(self, threshold: float | None = None, ttl: int | None = None, key_fn: Callable[..., str] | None = None):
        """Decorator over :meth:`call_key`, :meth:`get` and :meth:`set`. None is never a hit."""

        def wrap(f):
            @functools.wraps(f)
            def call(*args, **kwargs):
                asked = self.call_key(f.__name__, args, kwargs, key_fn)
                answer = self.get(asked, threshold)
                if answer is None:
                    self.stats.misses += 1
                    began = time.perf_counter()
                    answer = f(*args, **kwargs)
                    self.set(asked, answer, ttl, 1000 * (time.perf_counter() - began))
                return answer

            return call

        return wrap
