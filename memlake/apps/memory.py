"""Tiered memory: remember, recall, forget."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TIER_TTL
from ..operators import knn
from ..sources.store import Database
from .embed import get_embedder

TIERS = tuple(TIER_TTL)
RESERVED = ("content", "tier", "created_at", "expires_at")


class Memory:
    """One collection for each tier. A memory's expiry is kept in its metadata and applied after the
    search, so that expired rows take places among the k best, and can be recalled on demand."""

    def __init__(self, database: Database, embedder=None, prefix: str = "memory"):
        self.database, self.embedder, self.prefix = database, get_embedder(embedder), prefix
        self.tiers = {t: database.collection(f"{prefix}_{t}", self.embedder.dimension, "cosine") for t in TIERS}

    def _named(self, tiers: Sequence[str] | None) -> list[str]:
        got = list(tiers or TIERS)
        if bad := [t for t in got if t not in TIERS]:
            raise ValueError(f"unknown tiers: {bad}")
        return got

    def remember(self, content: str, tier: str = "session", ttl: float | None = None, metadata: dict | None = None) -> str:
        """Store a text; ttl 0 or None is the tier's default. User metadata may override reserved keys."""
        self._named([tier])
        now, i = self.database.clock(), str(uuid.uuid4())
        meta = {"content": content, "tier": tier, "created_at": now, "expires_at": now + (ttl or TIER_TTL[tier])} | (metadata or {})
        self.tiers[tier].add_sync(self.embedder.embed_single(content), meta, i)
        return i

    def remember_frame(self, rows: DataFrame, tier: str) -> None:
        """Store a DataFrame of ``content`` and optionally ``id``."""
        self._named([tier])
        now = float(self.database.clock())
        meta = F.to_json(F.struct("content", F.lit(tier).alias("tier"), F.lit(now).alias("created_at"), F.lit(now + TIER_TTL[tier]).alias("expires_at")))
        i = F.col("id").cast("string") if "id" in rows.columns else F.expr("uuid()")
        self.tiers[tier].upsert_frame(rows.select(i.alias("id"), self.embedder.column(F.col("content")).alias("vector"), meta.alias("metadata")))

    def rows(self, tiers: Sequence[str] | None = None) -> DataFrame:
        """``tier, id, vector, metadata, content, created_at, expires_at`` of the tiers, as one plan."""
        get = lambda k: F.get_json_object("metadata", f"$.{k}")
        parts = [self.tiers[t].rows().withColumn("tier", F.lit(t)) for t in self._named(tiers)]
        one = reduce(DataFrame.unionByName, parts)
        return one.select("tier", "id", "vector", "metadata", get("content").alias("content"), get("created_at").cast("double").alias("created_at"), F.coalesce(get("expires_at").cast("double"), F.lit(float("inf"))).alias("expires_at"))

    def recall(self, text: str, k: int = 5, threshold: float = 0.3, tiers: Sequence[str] | None = None, include_expired: bool = False) -> DataFrame:
        """``id, content, tier, score, created_at, expires_at, metadata``: metadata without the reserved keys."""
        order = self._named(tiers)
        now = None if include_expired else float(self.database.clock())
        found = knn.tiered_search(self.rows(order), self.embedder.embed_single(text), k, threshold, order, now)
        rest = F.map_filter(F.from_json("metadata", "map<string,variant>"), lambda key, _: ~key.isin(*RESERVED))  # values keep their kinds
        return found.select("id", "content", "tier", "score", "created_at", "expires_at", F.to_json(rest).alias("metadata"))

    def forget(self, text: str, threshold: float = 0.8, tiers: Sequence[str] | None = None, dry_run: bool = False, most: int | None = 100) -> int:
        """Delete the ``most`` nearest memories over the threshold, expired ones too; None: all of them."""
        order = self._named(tiers)
        k = most if most is not None else max(1, self.rows(order).count())
        hits = self.recall(text, k, threshold, order, include_expired=True).select("tier", "id").persist()
        n = {r["tier"]: r["count"] for r in hits.groupBy("tier").count().collect()}
        if not dry_run:
            for t in n:
                self.tiers[t].delete_frame(hits.where(F.col("tier") == t).select("id"))
        hits.unpersist()
        return sum(n.values())

    def forget_by_id(self, i: str) -> bool:
        return any(self.tiers[t].delete(i) for t in TIERS)

    def cleanup_expired(self, tiers: Sequence[str] | None = None) -> int:
        """Delete all memories after their expiry, however many."""
        now, n = float(self.database.clock()), 0
        for t in self._named(tiers):
            gone = self.rows([t]).where(F.lit(now) > F.col("expires_at")).select("id").persist()
            if m := gone.count():
                self.tiers[t].delete_frame(gone)
            n += m
            gone.unpersist()
        return n

    def stats(self) -> DataFrame:
        """``tier, count`` of each tier and in total."""
        each = self.database.spark.createDataFrame([(t,) for t in TIERS], "tier string")
        n = self.rows().groupBy("tier").agg(F.count("*").alias("n"))
        one = each.join(F.broadcast(n), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))  # four rows
        return one.rollup("tier").agg(F.sum("n").alias("count")).select(F.coalesce("tier", F.lit("total")).alias("tier"), "count")

    def clear(self, tiers: Sequence[str] | None = None) -> None:
        for t in self._named(tiers):
            self.database.drop_collection(f"{self.prefix}_{t}")
            self.tiers[t] = self.database.collection(f"{self.prefix}_{t}", self.embedder.dimension, "cosine")

    def context(self, text: str, budget: int, k: int = 10, threshold: float = 0.25, tiers: Sequence[str] | None = None) -> str:
        """Recalled texts, best first, each taken while its words still fit the budget."""
        found = self.recall(text, k, threshold, tiers).withColumn("cost", F.size(F.split(F.trim("content"), r"\s+")).cast("long")).withColumn("_w", -F.col("score"))
        return "\n".join(f"[{r['tier']}] {r['content']}" for r in knn.budget(found, budget, ["_w", "id"], "cost").collect())


_TIER = {"type": "string", "enum": list(TIERS)}
_TIER_LIST = {"type": "array", "items": _TIER}


def _schema(name: str, description: str, required: list[str], **properties: dict) -> dict:
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": properties, "required": required}}


#: The tools as clients list them; names, arguments and defaults are fixed values.
SCHEMAS = [
    _schema("memory_remember", "Store a text under a tier, for the tier's lifetime or a given one.", ["content"], content={"type": "string"}, tier=_TIER | {"default": "project"}, ttl={"type": "integer"}),
    _schema("memory_recall", "Find stored texts that are near a query.", ["query"], query={"type": "string"}, k={"type": "integer", "default": 5}, threshold={"type": "number", "default": 0.3}, tiers=_TIER_LIST),
    _schema("memory_forget", "Remove stored texts that are near a query.", ["query"], query={"type": "string"}, threshold={"type": "number", "default": 0.8}, tiers=_TIER_LIST),
    _schema("memory_stats", "Count the stored texts of each tier.", []),
]


class Tools:
    """The tool calls of an agent: checked arguments, answers as text."""

    def __init__(self, memory: Memory):
        self.memory = memory

    def call(self, name: str, arguments: dict | None = None) -> str:
        verbs = {"memory_remember": self._remember, "memory_recall": self._recall, "memory_forget": self._forget, "memory_stats": self._stats}
        try:
            if name not in verbs:
                raise ValueError(f"unknown tool: {name}")
            return verbs[name](arguments or {})
        except (ValueError, TypeError) as e:
            return f"Error: {e}"

    @staticmethod
    def _text(a: dict, key: str) -> str:
        x = a.get(key)
        if not isinstance(x, str) or not x.strip():
            raise ValueError(f"{key} must be a text")
        return x

    @staticmethod
    def _share(a: dict, default: float) -> float:
        x = a.get("threshold", default)
        if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 <= x <= 1:
            raise ValueError("threshold must be between 0 and 1")
        return float(x)

    def _remember(self, a: dict) -> str:
        return f"Remembered {self.memory.remember(self._text(a, 'content'), a.get('tier', 'project'), a.get('ttl'), a.get('metadata'))}"

    def _recall(self, a: dict) -> str:
        k = a.get("k", 5)
        if isinstance(k, bool) or not isinstance(k, int) or k < 1:
            raise ValueError("k must be a positive integer")
        rows = self.memory.recall(self._text(a, "query"), k, self._share(a, 0.3), a.get("tiers")).collect()
        return "\n".join(f"{n}. [{r['tier']}] ({r['score']:.3f}) {r['content']}" for n, r in enumerate(rows, 1)) or "No memories found."

    def _forget(self, a: dict) -> str:
        return f"Forgot {self.memory.forget(self._text(a, 'query'), self._share(a, 0.8), a.get('tiers'))} memories."

    def _stats(self, a: dict) -> str:
        return json.dumps({r["tier"]: r["count"] for r in self.memory.stats().collect()}, sort_keys=True)

    def answer(self, message: dict) -> dict | None:
        """The answer to one JSON-RPC message of a tool client; None to a notification."""
        if "id" not in message:
            return None
        out: dict = {"jsonrpc": "2.0", "id": message["id"]}
        params = message.get("params") or {}
        match message.get("method"):
            case "initialize":
                out["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "memlake", "version": "1"}}
            case "ping":
                out["result"] = {}
            case "tools/list":
                out["result"] = {"tools": SCHEMAS}
            case "tools/call":
                text = self.call(params.get("name", ""), params.get("arguments"))
                out["result"] = {"content": [{"type": "text", "text": text}], "isError": text.startswith("Error:")}
            case method:
                out["error"] = {"code": -32601, "message": f"unknown method: {method}"}
        return out

    def serve(self, source: Iterable[str], target: TextIO) -> None:
        """Answer messages, one to a line, until there are no more."""
        for line in source:
            if not line.strip():
                continue
            try:
                got = self.answer(json.loads(line))
            except (json.JSONDecodeError, TypeError) as e:
                got = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if got is not None:
                target.write(json.dumps(got) + "\n")
                target.flush()
