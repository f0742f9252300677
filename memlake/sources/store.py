"""Databases and collections as append-only Parquet logs.

Layout below a database's root::

    _registry/<collection>.json        dimensions, metric, creation time
    <collection>/log/seq=<n>-<uuid>/   rows of one commit
    <collection>/commits/<n>.json      written last: a commit is visible when its marker is there
    <collection>/index/<uuid>/         inverted lists, if the collection is searched through them
    <collection>/index/current.json    which of them, and the commit that they are made of

A marker is created without overwriting and names its folder, so two writers can't take one
number, nor mix their files. Readers pin the markers that they have listed (a snapshot) and
see for each id the row with the highest (seq, ord). The last compacted commit has each id
once: it is read as it is, without the ids of later commits, and only the rows of those are
aggregated.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import knn
from ..operators.ivf import PRESETS, AnnConfig, IvfIndex
from ..types import LOG, RESULT, CollectionExists, CollectionNotFound, Corruption, DimensionMismatch, InvalidInput, Metric, TransactionConflict, check_dimensions

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.\-]{0,127}")
#: Candidates of the index for each result that is asked for.
OVER_FETCH = 4
#: Pending rows are flushed at so many, or when the oldest is this old (fixed values).
WRITE_DEFAULT, WRITE_IMMEDIATE, WRITE_THROUGHPUT = (100, 0.1), (0, 0.0), (1000, 0.2)


class _Files:
    """Small files of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> Any:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, value: Any) -> None:
        """Write a new file; it is an error if it is there."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            raise TransactionConflict(f"{name} is there already") from e
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def replace(self, name: str, value: Any) -> None:
        stream = self.fs.create(self._path(name), True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self._path(name), True))

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self._path(name)))

    def size(self, name: str) -> int:
        return int(self.fs.getContentSummary(self._path(name)).getLength()) if self.exists(name) else 0


class Database:
    """Named collections below one root path."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.files = _Files(spark, root)
        self._open: dict[str, Collection] = {}

    @staticmethod
    def _checked(name: str) -> str:
        if not _NAME.fullmatch(name):
            raise InvalidInput(f"not a collection name: {name!r}")
        return name

    def collection(self, name: str, dimensions: int, metric: Metric | str = Metric.COSINE, write: tuple[int, float] = WRITE_DEFAULT, index: AnnConfig | str | None = None) -> Collection:
        """Open, or create, a collection; other dimensions or another metric are errors. With an ``index``
        it is searched through inverted lists, which are built and kept up to date on the way."""
        check_dimensions(dimensions)
        metric, entry = Metric.parse(metric), f"_registry/{self._checked(name)}.json"
        if self.files.exists(entry):
            info = self.files.read(entry)
            if info["dimensions"] != dimensions:
                raise DimensionMismatch(f"{name} has {info['dimensions']} dimensions, not {dimensions}")
            if info["metric"] != metric.value:
                raise CollectionExists(f"{name} has the metric {info['metric']}")
        else:
            self.files.create(entry, {"name": name, "dimensions": dimensions, "metric": metric.value, "created_at": int(self.clock())})
        if name not in self._open:
            self._open[name] = Collection(self, name, dimensions, metric, write)
        if index is not None:
            self._open[name].index = PRESETS[index] if isinstance(index, str) else index
        return self._open[name]

    def get_collection(self, name: str) -> Collection:
        entry = f"_registry/{self._checked(name)}.json"
        if not self.files.exists(entry):
            raise CollectionNotFound(name)
        info = self.files.read(entry)
        return self.collection(name, info["dimensions"], info["metric"])

    def collections(self) -> list[str]:
        return [x.removesuffix(".json") for x in self.files.names("_registry") if x.endswith(".json")]

    def registry(self) -> DataFrame:
        rows = [(i["name"], i["dimensions"], i["metric"], i["created_at"]) for i in (self.files.read(f"_registry/{n}.json") for n in self.collections())]
        return self.spark.createDataFrame(rows, "name string, dimensions int, metric string, created_at long")

    def listing(self) -> DataFrame:
        """``name, count, dimensions, metric`` of all collections."""
        out = self.spark.createDataFrame([], "name string, count long, dimensions int, metric string")
        for c in map(self.get_collection, self.collections()):
            out = out.unionByName(c.live().agg(F.count("*").alias("count")).select(F.lit(c.name).alias("name"), "count", F.lit(c.dimensions).alias("dimensions"), F.lit(c.metric.value).alias("metric")))
        return out

    def drop_collection(self, name: str) -> bool:
        if not self.files.exists(f"_registry/{self._checked(name)}.json"):
            return False
        self.files.delete(f"_registry/{name}.json")
        self.files.delete(name)
        self._open.pop(name, None)
        return True

    def sync(self) -> None:
        for c in self._open.values():
            c.sync()

    def recover(self) -> dict[str, int]:
        """Remove commits without a marker (a writer died); how many were promoted and rolled back."""
        gone = sum(self.get_collection(n)._roll_back() for n in self.collections())
        return {"promoted": 0, "rolled_back": gone}

    def validate(self) -> DataFrame:
        """``name, ok, count, pending, problem`` of each collection."""
        rows = []
        for n in self.collections():
            try:
                c = self.get_collection(n)
                wrong = c.live().where(F.size("vector") != c.dimensions).count()
                rows.append((n, not wrong, len(c), c.pending_count(), f"{wrong} rows of other dimensions" if wrong else None))
            except Exception as e:  # a report, not a failure
                rows.append((n, False, 0, 0, str(e)[:200]))
        return self.spark.createDataFrame(rows, "name string, ok boolean, count long, pending long, problem string")


class Collection:
    """Vectors of one dimension and metric with JSON metadata and lifetimes."""

    def __init__(self, database: Database, name: str, dimensions: int, metric: Metric, write: tuple[int, float] = WRITE_DEFAULT):
        self.database, self.name, self.dimensions, self.metric, self.write = database, name, dimensions, metric, write
        self.spark, self.files = database.spark, database.files
        self.index: AnnConfig | None = None
        self._pending: dict[str, tuple] = {}
        self._since = 0.0

    # --- reading ---------------------------------------------------------------------------

    def now(self) -> int:
        return int(self.database.clock())

    def commits(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self.files.names(f"{self.name}/commits") if x.endswith(".json")]

    def _marker(self, seq: int) -> dict[str, Any]:
        return self.files.read(f"{self.name}/commits/{seq:012d}.json")

    def _parts(self, at: int | None = None) -> tuple[list[str], list[str]]:
        """Folders of the last compacted commit (none or one) and of the later ones."""
        later: list[str] = []
        for seq in reversed([s for s in self.commits() if at is None or s <= at]):
            marker = self._marker(seq)
            if marker.get("compacted"):
                return [marker["folder"]], later[::-1]
            later.append(marker["folder"])
        return [], later[::-1]

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.database.root}/{self.name}/log/{f}" for f in folders])

    def snapshot(self, at: int | None = None) -> DataFrame:
        """All log rows that a reader of commit ``at`` (the last) needs."""
        base, later = self._parts(at)
        return self._read(base + later)

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        rest = [c for c in LOG.names if c != "id"]
        return rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("seq", "ord")).alias("r")).select("id", "r.*")

    def latest(self, at: int | None = None) -> DataFrame:
        """Each id's last row, deletions included, without the pending ones."""
        base, later = self._parts(at)
        if not later:
            return self._read(base)
        new = self._last(self._read(later))
        if not base:
            return new
        return self._read(base).join(self._read(later).select("id").distinct(), "id", "left_anti").unionByName(new)

    def _staged(self) -> DataFrame:
        return self.spark.createDataFrame(list(self._pending.values()), LOG)

    def live(self, now: float | None = None, at: int | None = None) -> DataFrame:
        """Rows that are neither deleted nor expired, pending ones first in line."""
        rows = self.latest(at)
        if self._pending and at is None:
            rows = rows.where(~F.col("id").isin(*self._pending)).unionByName(self._staged())
        t = self.now() if now is None else now
        return rows.where((F.col("op") == "put") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(t))))

    def rows(self) -> DataFrame:
        """``id, vector, metadata`` of the live rows."""
        return self.live().select("id", "vector", "metadata")

    def get(self, i: str) -> DataFrame:
        """``id, score (0.0), metadata``; no row if the id isn't there."""
        return self.live().where((F.col("id") == i) & V.searchable(F.col("vector"))).select("id", F.lit(0.0).alias("score"), "metadata").limit(1)

    def get_with_vector(self, i: str) -> DataFrame:
        return self.live().where((F.col("id") == i) & V.searchable(F.col("vector"))).select("id", "vector", "metadata").limit(1)

    def search(self, query: Sequence[float], k: int = 10, where: Any = None, dialect: str = "core") -> DataFrame:
        """``id, score, metadata`` of the k best live rows, pending ones too; through the index if there is one."""
        self._check([query])
        if not k:
            return self.spark.createDataFrame([], RESULT)
        q = [float(x) for x in query]
        if self.index is None or dialect == "wasm":
            return knn.search(self.rows(), q, k, self.metric, where, dialect)
        # candidates are looked up among the live rows, as they may have expired since
        found = self.ensure_index().search(q, OVER_FETCH * k, where).select("id", "score")
        live = self.live().select("id", "metadata")
        if self._pending:
            live = live.where(~F.col("id").isin(*self._pending))
        old = live.join(F.broadcast(found), "id").select("id", "score", "metadata")  # some times k rows
        parts = [old.orderBy(V.order(self.metric), "id").limit(k)]
        if self._pending:
            parts.append(knn.search(self.live().where(F.col("id").isin(*self._pending)).select("id", "vector", "metadata"), q, k, self.metric, where, dialect))
        return knn.merge_top(parts, k, self.metric)

    def ensure_index(self, config: AnnConfig | str | None = None) -> IvfIndex:
        """The index of all committed rows: built if there is none or it can't be read, else brought up
        to date with the commits since, and built anew where these hold more rows than it does."""
        config = PRESETS[config] if isinstance(config, str) else config or self.index or PRESETS["default"]
        seqs = self.commits()
        last, entry = seqs[-1] if seqs else 0, f"{self.name}/index/current.json"
        if self.files.exists(entry):
            info = self.files.read(entry)
            try:
                index = IvfIndex.load(self.spark, f"{self.database.root}/{self.name}/index/{info['folder']}")
            except Corruption:
                index = None
            if index is not None and info["seq"] == last:
                return index
            since = [s for s in seqs if s > info["seq"]]
            # a compacted commit tells nothing of what went before it
            if index is not None and not any(self._marker(s).get("compacted") for s in since):
                new = self._last(self._read([self._marker(s)["folder"] for s in since])).persist()
                if new.count() <= len(index):
                    index.delete(new.select("id"))
                    index.insert(new.where("op = 'put'"))
                    new.unpersist()
                    self.files.replace(entry, {"folder": info["folder"], "seq": last})
                    return index
                new.unpersist()
        folder = uuid.uuid4().hex
        rows = self.latest(last).where("op = 'put'") if seqs else self._read([])
        index = IvfIndex.build(rows.select("id", "vector", "metadata"), f"{self.database.root}/{self.name}/index/{folder}", self.metric, config, self.dimensions)
        old = self.files.read(entry)["folder"] if self.files.exists(entry) else None
        self.files.replace(entry, {"folder": folder, "seq": last})
        if old:
            self.files.delete(f"{self.name}/index/{old}")
        return index

    def index_node_count(self) -> int:
        """Rows in the index, 0 without one."""
        entry = f"{self.name}/index/current.json"
        return len(IvfIndex.load(self.spark, f"{self.database.root}/{self.name}/index/{self.files.read(entry)['folder']}")) if self.files.exists(entry) else 0

    def visit(self, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """What a function makes of the live records, in batches where they are."""
        return self.live().mapInPandas(f, schema)

    def batch_search(self, queries: DataFrame, k: int = 10, where: Any = None) -> DataFrame:
        return knn.batch_search(queries, self.rows(), k, self.metric, where)

    def __len__(self) -> int:
        return self.live().count()

    def is_empty(self) -> bool:
        return self.live().limit(1).count() == 0

    def stats(self) -> DataFrame:
        one = self.live().agg(F.count("*").alias("count"), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0)).cast("long").alias("vector_storage_bytes"))
        extra = {"name": self.name, "dimensions": self.dimensions, "metric": self.metric.value, "pending_writes": self.pending_count(), "file_size": self.files.size(self.name), "has_index": self.files.exists(f"{self.name}/index/current.json"), "index_node_count": self.index_node_count()}
        return one.select(*[F.lit(v).alias(k) for k, v in extra.items()], "count", "vector_storage_bytes")

    def preload(self) -> DataFrame:
        return self.rows().persist()

    # --- writing ---------------------------------------------------------------------------

    def _check(self, vectors: Sequence[Sequence[float]]) -> None:
        for v in vectors:
            if len(v) != self.dimensions:
                raise DimensionMismatch(f"{self.name} has {self.dimensions} dimensions, not {len(v)}")

    def _stored(self, v: Sequence[float]) -> list[float]:
        x = np.asarray(v, np.float64)
        if self.metric is Metric.COSINE:
            n = float(np.sqrt((x * x).sum()))
            x = np.zeros_like(x) if n < V.EPSILON else x / n
        return x.astype(np.float32).tolist()

    @staticmethod
    def _text(metadata: Any) -> str:
        return metadata if isinstance(metadata, str) else json.dumps({} if metadata is None else metadata)

    def add(self, vector: Sequence[float], metadata: Any = None, id: str | None = None, ttl: int | None = None) -> str:
        """Stage a row; it is visible at once, and durable after the next flush."""
        self._check([vector])
        i, t = id or str(uuid.uuid4()), self.now()
        self._since = self._since if self._pending else self.database.clock()
        self._pending.pop(i, None)
        self._pending[i] = (i, self._stored(vector), self._text(metadata), t, None if ttl is None else t + int(ttl), "put", 0, len(self._pending))
        if len(self._pending) > max(0, self.write[0] - 1) or self.database.clock() - self._since >= self.write[1] > 0:
            self.flush()
        return i

    def add_sync(self, vector: Sequence[float], metadata: Any = None, id: str | None = None, ttl: int | None = None) -> str:
        i = self.add(vector, metadata, id, ttl)
        self.flush()
        return i

    def upsert(self, id: str, vector: Sequence[float], metadata: Any = None, ttl: int | None = None) -> None:
        self.add(vector, metadata, id, ttl)

    def add_batch(self, vectors: Sequence, metadatas: Sequence | None = None, ids: Sequence[str] | None = None, ttls: Sequence | None = None) -> list[str]:
        """All rows in one commit, or none: everything is checked before anything is written."""
        n = len(vectors)
        for what, x in (("metadatas", metadatas), ("ids", ids), ("ttls", ttls)):
            if x is not None and len(x) != n:
                raise InvalidInput(f"{len(x)} {what} for {n} vectors")
        self._check(vectors)
        self.flush()
        t, names = self.now(), [i or str(uuid.uuid4()) for i in (ids or [None] * n)]
        life = [None if x is None else t + int(x) for x in (ttls or [None] * n)]
        rows = [(i, self._stored(v), self._text(m), t, e, "put", 0, k) for k, (i, v, m, e) in enumerate(zip(names, vectors, metadatas or [None] * n, life, strict=True))]
        if rows:
            self._commit(self.spark.createDataFrame(rows, LOG))
        return names

    def upsert_frame(self, rows: DataFrame) -> None:
        """Commit a DataFrame of ``id, vector`` and optionally ``metadata, ttl``; of repeated ids one row, the
        last by metadata and vector, wins. Nothing passes through the driver."""
        self.flush()
        v = V.doubles("vector")
        bad = F.raise_error(F.concat(F.lit(f"{self.name} has {self.dimensions} dimensions, not "), F.size("vector").cast("string")))
        stored = F.when(F.size("vector") == self.dimensions, V.normalize(v) if self.metric is Metric.COSINE else v).otherwise(bad.cast("array<double>"))
        t = F.lit(self.now()).cast("long")
        meta = F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in rows.columns else F.lit("{}")
        life = t + F.col("ttl").cast("long") if "ttl" in rows.columns else F.lit(None).cast("long")
        out = rows.select(F.coalesce(F.col("id").cast("string"), F.expr("uuid()")).alias("id"), stored.cast("array<float>").alias("vector"), meta.alias("metadata"), t.alias("created_at"), life.alias("expires_at"), F.lit("put").alias("op"), F.lit(0).cast("long").alias("seq"))
        self._commit(out.withColumn("ord", F.xxhash64("metadata", "vector")))

    def delete(self, id: str) -> bool:
        """Whether the id was there; an expired row that hasn't been removed counts."""
        staged = self._pending.pop(id, None) is not None
        there = bool(self.latest().where((F.col("id") == id) & (F.col("op") == "put")).limit(1).count())
        if there:
            self.delete_frame(self.spark.createDataFrame([(id,)], "id string"))
        return staged or there

    def delete_frame(self, ids: DataFrame) -> None:
        none = [F.lit(None).cast(LOG[c].dataType).alias(c) for c in ("vector", "metadata", "created_at", "expires_at")]
        self._commit(ids.select(F.col("id").cast("string").alias("id"), *none, F.lit("del").alias("op"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("ord")))

    def _commit(self, rows: DataFrame, compacted: bool = False) -> int:
        seq = max(self.commits(), default=0) + 1
        folder = f"seq={seq:012d}-{uuid.uuid4().hex}"
        rows.withColumn("seq", F.lit(seq).cast("long")).select(*LOG.names).write.parquet(f"{self.database.root}/{self.name}/log/{folder}")
        try:
            self.files.create(f"{self.name}/commits/{seq:012d}.json", {"seq": seq, "folder": folder, "compacted": compacted})
        except TransactionConflict:
            self.files.delete(f"{self.name}/log/{folder}")  # another writer was first; nothing of this one is visible
            raise
        return seq

    def _roll_back(self) -> int:
        done = {self._marker(s)["folder"] for s in self.commits()}
        lost = [x for x in self.files.names(f"{self.name}/log") if x.startswith("seq=") and x not in done]
        for x in lost:
            self.files.delete(f"{self.name}/log/{x}")
        return len(lost)

    def flush(self) -> None:
        if self._pending:
            rows, self._pending = self._staged(), {}
            self._commit(rows)

    def sync(self) -> None:
        self.flush()

    def pending_count(self) -> int:
        return len(self._pending)

    def compact(self) -> dict[str, int]:
        """Write the live rows as a new base; readers of older commits keep their snapshot until :meth:`vacuum`."""
        began, t = time.time(), self.now()
        last = self.latest()
        gone = F.col("expires_at").isNotNull() & (F.col("expires_at") <= t) & (F.col("op") == "put")
        n = last.agg(F.coalesce(F.sum(gone.cast("long")), F.lit(0)).alias("e"), F.coalesce(F.sum((F.col("op") == "del").cast("long")), F.lit(0)).alias("d")).first()
        self._commit(last.where((F.col("op") == "put") & ~gone), compacted=True)
        return {"expired_removed": n["e"], "tombstones_removed": n["d"], "bytes_freed": n["e"] * self.dimensions * 4, "duration_ms": int((time.time() - began) * 1000)}

    def vacuum(self) -> int:
        """Delete commits before the last compacted one; their number."""
        seqs = self.commits()
        base = next((s for s in reversed(seqs) if self._marker(s).get("compacted")), 0)
        old = [s for s in seqs if s < base]
        for s in old:
            folder = self._marker(s)["folder"]
            self.files.delete(f"{self.name}/commits/{s:012d}.json")
            self.files.delete(f"{self.name}/log/{folder}")
        return len(old)

    def delete_active(self, id: str) -> bool:
        """As :meth:`delete`, but an expired row doesn't count: the browser's rule."""
        there = bool(self.live().where(F.col("id") == id).limit(1).count())
        return self.delete(id) and there
