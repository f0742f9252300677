"""Approximate nearest neighbours over inverted lists.

Rows are filed under the nearest of some centroids, in a Parquet table partitioned by
cell. A query reads the cells with the nearest centroids only (partition pruning), filters
inside them, and scores exactly.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..types import Corruption, Metric
from . import knn
from .quant import kmeans


@dataclass(frozen=True)
class AnnConfig:
    """``cells`` None: the square root of the rows. ``sample`` bounds the rows that centroids are fitted on.

    ``recall``: more than ``probes`` cells are probed where so many are needed for this share of the
    10 nearest, as measured on a sample when the index is built; None leaves the probes as they are.
    """

    cells: int | None = None
    probes: int = 8
    rounds: int = 8
    sample: int = 20_000
    recall: float | None = None

    def with_probes(self, n: int) -> AnnConfig:
        return replace(self, probes=n)

    def with_cells(self, n: int) -> AnnConfig:
        return replace(self, cells=n)

    def with_rounds(self, n: int) -> AnnConfig:
        return replace(self, rounds=n)


#: Sampled rows whose neighbours are sought to find out how many cells to probe.
SAMPLED_QUERIES = 1000

#: The tables of an index; files may be none yet.
TABLES = {"cells": "id string, vector array<float>, metadata string, at long, cell int", "deleted": "id string, at long"}

#: Presets by name, from quick to thorough.
PRESETS = {
    "fast": AnnConfig(probes=4, rounds=4),
    "high_throughput": AnnConfig(probes=6, rounds=4),
    "default": AnnConfig(),
    "high_recall": AnnConfig(probes=16, rounds=10, recall=0.96),
    "production": AnnConfig(probes=20, rounds=10, recall=0.96),
    "max_recall": AnnConfig(probes=32, rounds=15, recall=0.99),
    "pq_optimized": AnnConfig(probes=24, rounds=12),
}


def probes_needed(q: np.ndarray, rows: np.ndarray, centroids: np.ndarray, metric: Metric, recall: float, k: int = 10) -> int:
    """Cells to probe so that this share of the k nearest rows of the queries is found.

    ``q`` are the first of ``rows``; no query counts as its own neighbour. Nearest among a sample
    are farther off, so if anything in farther cells, than the nearest among all rows.
    """
    n = np.square(centroids).sum(1)[None]
    cell = np.concatenate([(n - 2 * rows[i : i + 4096] @ centroids.T).argmin(1) for i in range(0, len(rows), 4096)])
    found = []
    for i in range(0, len(q), 64):
        part = q[i : i + 64]
        near = part @ rows.T
        if metric is Metric.L2:
            near = 2 * near - np.square(rows).sum(1)[None]
        near[np.arange(len(part)), np.arange(i, i + len(part))] = -np.inf
        best = np.argpartition(-near, min(k, len(rows) - 1) - 1, axis=1)[:, : min(k, len(rows) - 1)]
        turn = np.argsort(np.argsort(n - 2 * part @ centroids.T, axis=1, kind="stable"), axis=1)
        found.append(np.take_along_axis(turn, cell[best], 1).ravel())
    ranks = np.sort(np.concatenate(found)) + 1
    return int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)])


class IvfIndex:
    """An index at a path: ``cells/`` by cell and ``deleted/`` ids, both only appended to and stamped with
    a count of changes, and ``manifest/`` with centroids, settings and their checksum."""

    def __init__(self, spark, path: str, centroids: np.ndarray, metric: Metric, config: AnnConfig):
        self.spark, self.path, self.centroids, self.metric, self.config = spark, path, centroids, metric, config

    @classmethod
    def build(cls, rows: DataFrame, path: str, metric: Metric | str = Metric.COSINE, config: AnnConfig | str = "default", dimensions: int = 1) -> IvfIndex:
        """``rows``: id, vector, metadata. Rows whose vectors can't be searched are left out. ``dimensions`` is for no rows at all."""
        config = PRESETS[config] if isinstance(config, str) else config
        spark, metric = rows.sparkSession, Metric.parse(metric)
        rows = rows.where(V.searchable(F.col("vector")))
        n = rows.count()
        cells = config.cells or max(1, int(np.sqrt(n)))
        # a hash range holds about the sample, so that only few vectors are moved
        share = min(1.0, (config.sample + 100) / max(1, n))

        def sample(part: int) -> np.ndarray:
            low, high = (min((1 << 63) - 1, int(min(1.0, share * x) * (1 << 64)) - (1 << 63)) for x in (part, part + 1))
            h = F.xxhash64("id")
            held = rows.where((h <= high) & (h > low if part else F.lit(True)))
            return np.array([r["v"] for r in held.select(V.doubles("vector").alias("v")).limit(2 * config.sample).collect()])

        data = sample(0)
        centroids = kmeans(data, cells, config.rounds) if len(data) else np.zeros((1, dimensions))
        if config.recall is not None and len(data) > 1:
            # centroids are closer to the rows that they were fitted on than to others, so others are asked where there are any
            other = sample(1) if share < 1 else data
            data = other if len(other) > 10 else data
            data = np.random.default_rng(7).permutation(data)
            config = config.with_probes(max(config.probes, probes_needed(data[:SAMPLED_QUERIES], data, centroids, metric, config.recall)))
        index = cls(spark, path, centroids, metric, config)
        index._write(index._assign(rows, 0), "overwrite")
        spark.createDataFrame([], TABLES["deleted"]).write.mode("overwrite").parquet(f"{path}/deleted")
        info = json.dumps({"metric": metric.value, "probes": config.probes, "rounds": config.rounds, "centroids": centroids.tolist()})
        spark.createDataFrame([(info, zlib.crc32(info.encode()))], "manifest string, crc32 long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        return index

    @classmethod
    def load(cls, spark, path: str) -> IvfIndex:
        try:
            row = spark.read.parquet(f"{path}/manifest").first()
            info = json.loads(row["manifest"])
        except Exception as e:
            raise Corruption(f"no index at {path}") from e
        if zlib.crc32(row["manifest"].encode()) != row["crc32"]:
            raise Corruption(f"the manifest at {path} doesn't fit its checksum")
        return cls(spark, path, np.array(info["centroids"]), Metric.parse(info["metric"]), AnnConfig(probes=info["probes"], rounds=info["rounds"]))

    @classmethod
    def load_or_build(cls, rows: DataFrame, path: str, metric: Metric | str = Metric.COSINE, config: AnnConfig | str = "default") -> IvfIndex:
        try:
            return cls.load(rows.sparkSession, path)
        except Corruption:
            return cls.build(rows, path, metric, config)

    def _write(self, filed: DataFrame, mode: str) -> None:
        """Rows of a cell meet before they are written, in so many tasks that a large cell has several:
        a file for each task and cell would be too many."""
        parts = max(len(self.centroids), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        salt = F.pmod(F.xxhash64("id"), F.lit(max(1, parts // len(self.centroids))))
        filed.repartition(parts, "cell", salt).write.mode(mode).partitionBy("cell").parquet(f"{self.path}/cells")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def _next(self) -> int:
        """The number of the next change: beyond all that rows and deletions are stamped with."""
        seen = [self._table(t).agg(F.max("at")).first()[0] for t in ("cells", "deleted")]
        return 1 + max(x or 0 for x in seen)

    def _assign(self, rows: DataFrame, at: int) -> DataFrame:
        c = self.centroids
        schema = TABLES["cells"]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    m = np.stack(p["vector"].to_numpy()).astype(float)
                    yield p.assign(at=at, cell=(np.square(c).sum(1)[None] - 2 * m @ c.T).argmin(1))

        return rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("metadata")).mapInPandas(run, schema)

    def rows(self) -> DataFrame:
        """What is indexed and wasn't deleted since."""
        gone = self._table("deleted").groupBy("id").agg(F.max("at").alias("gone"))
        return self._table("cells").join(gone, "id", "left").where(F.col("gone").isNull() | (F.col("at") > F.col("gone"))).drop("gone", "at")

    def insert(self, rows: DataFrame) -> int:
        """File rows whose ids aren't indexed and whose vectors can be searched; their number. A deleted id may come back."""
        rows = rows.where(V.searchable(F.col("vector")))
        new = self._assign(rows.join(self.rows().select("id"), "id", "left_anti"), self._next()).persist()
        n = new.count()
        self._write(new, "append")
        new.unpersist()
        return n

    def delete(self, ids: DataFrame) -> None:
        """Ids are no longer found, and their rows go with the next rewrite."""
        ids.select(F.col("id").cast("string").alias("id"), F.lit(self._next()).cast("long").alias("at")).distinct().write.mode("append").parquet(f"{self.path}/deleted")

    def deleted_count(self) -> int:
        return self._table("deleted").select("id").distinct().count()

    def contains(self, i: str) -> bool:
        return bool(self.rows().where(F.col("id") == i).limit(1).count())

    def __len__(self) -> int:
        return self.rows().count()

    def _near(self, q: np.ndarray, probes: int) -> np.ndarray:
        far = np.square(self.centroids).sum(1)[None] - 2 * q @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :probes]

    def search(self, query: Sequence[float], k: int = 10, where: Any = None, probes: int | None = None) -> DataFrame:
        """``id, score, metadata``; fewer than k if the probed cells hold fewer."""
        q = np.asarray(query, float)
        unit = q / n if self.metric is Metric.COSINE and (n := float(np.sqrt((q * q).sum()))) >= V.EPSILON else q
        cells = self._near(unit[None], probes or self.config.probes)[0]
        return knn.search(self.rows().where(F.col("cell").isin(*cells.tolist())), query, k, self.metric, where)

    def batch_search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """``qid, id, score, rank``: queries are sent to their cells and joined with the rows there."""
        n, c = probes or self.config.probes, self.centroids
        kind = queries.schema["qid"].dataType.simpleString()

        def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    q = np.stack(p["q"].to_numpy())
                    cells = np.argsort(np.square(c).sum(1)[None] - 2 * q @ c.T, axis=1, kind="stable")[:, :n]
                    yield pd.DataFrame({"qid": p["qid"].repeat(cells.shape[1]), "q": p["q"].repeat(cells.shape[1]), "cell": cells.ravel()})

        unit = V.normalize(V.doubles("vector")) if self.metric is Metric.COSINE else V.doubles("vector")
        asked = queries.select("qid", unit.alias("q")).mapInPandas(route, f"qid {kind}, q array<double>, cell int")
        scored = self.rows().join(asked, "cell").select("qid", "id", V.score(self.metric, V.doubles("vector"), F.col("q")).alias("score"))
        w = Window.partitionBy("qid").orderBy(V.order(self.metric), "id")
        return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
