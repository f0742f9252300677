"""Exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import vector as V
from ..functions.jsonfilter import compile_filter
from ..types import InvalidInput, Metric

#: So many queries, and bytes of their vectors, are sent to all executors; more meet the rows in a grid of cells.
QUERY_BLOCK, QUERY_BYTES = 4096, 64 << 20
#: Bytes of a grid cell's rows, and of the scores that are held at a time, about.
CELL_BYTES, SCORE_BYTES = 128 << 20, 32 << 20
#: Rows that a budget is dealt to at a time on the driver.
BUDGET_CHUNK = 1000


def _predicate(where: Any, dialect: str) -> Column:
    return where if isinstance(where, Column) else F.lit(True) if where is None else compile_filter(where, "metadata", dialect)


def search(rows: DataFrame, query: Sequence[float], k: int = 10, metric: Metric | str = Metric.COSINE, where: Any = None, dialect: str = "core") -> DataFrame:
    """``id, score, metadata`` of the k best of ``id, vector, metadata``, best first, ties to the smaller id.

    Rows are filtered before they are scored. Cosine takes unit vectors in the table and
    normalises the query. The plan is one scan and a bounded top-k, nothing is shuffled.
    """
    metric = Metric.parse(metric)
    if k < 0:
        raise InvalidInput("k can't be negative")
    q = V.literal(query)
    if dialect == "wasm":
        value = V.browser_score(metric, V.doubles("vector"), q)
        by = F.desc("score")
    else:
        if metric is Metric.COSINE:
            n = float(np.sqrt(np.square(np.asarray(query, float)).sum()))
            q = V.literal([x / n for x in query] if n >= V.EPSILON else [0.0] * len(query))
        value = V.score(metric, V.doubles("vector"), q)
        by = V.order(metric)
    found = rows.where(V.searchable(F.col("vector")) & _predicate(where, dialect))
    scored = found.select("id", value.alias("score"), "metadata").where(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.orderBy(by, "id").limit(k)


def _best(q: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, id, value) of each query, ties to the smaller id."""
    order = np.lexsort((ids, value if metric is Metric.L2 else -value, q))
    q, ids, value = q[order], ids[order], value[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], ids[rank < k], value[rank < k]


class _Tops:
    """The k best rows so far of each of some queries."""

    def __init__(self, q: np.ndarray, k: int, metric: Metric):
        if metric is Metric.COSINE:
            n = np.sqrt(np.square(q).sum(1, keepdims=True))
            q = np.where(n < V.EPSILON, 0.0, q / np.where(n < V.EPSILON, 1.0, n))
        self.q, self.k, self.metric = q, k, metric
        self.found: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, int), np.zeros(0, object), np.zeros(0))
        # a query's k-th best so far, larger is better: rows below it needn't be looked at
        self.bound = np.full(len(q), -np.inf)

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        parts = [self.found]
        step = max(1, SCORE_BYTES // (8 * max(1, len(ids))))
        for i in range(0, len(self.q), step):
            q = self.q[i : i + step]
            s = q @ m.T
            if self.metric is Metric.L2:
                s = 2 * s - np.square(m).sum(1)[None] - np.square(q).sum(1)[:, None]
            if np.isnan(s.sum()):
                s = np.where(np.isnan(s), -np.inf, s)
            low = self.bound[i : i + step]
            if len(ids) > self.k and not np.isfinite(low).all():
                low = np.maximum(low, np.partition(s, -self.k, axis=1)[:, -self.k])
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(low), low, 0)))
            a, b = np.nonzero((s >= (low - slack)[:, None]) & (s > -np.inf))
            # the few that are left are scored component by component: equal vectors get equal scores
            value = np.empty(len(a))
            for j in range(0, len(a), 1 << 14):
                x, y = q[a[j : j + (1 << 14)]], m[b[j : j + (1 << 14)]]
                value[j : j + (1 << 14)] = np.square(y - x).sum(1) if self.metric is Metric.L2 else (x * y).sum(1)
            parts.append((a + i, ids[b], value))
        self.found = _best(*(np.concatenate(x) for x in zip(*parts, strict=True)), self.k, self.metric)
        n = np.bincount(self.found[0], minlength=len(self.q))
        full = np.flatnonzero(n == self.k)
        last = self.found[2][np.cumsum(n)[full] - 1]
        self.bound[full] = -last if self.metric is Metric.L2 else last


def _vectors(col: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def batch_search(queries: DataFrame, rows: DataFrame, k: int = 10, metric: Metric | str = Metric.COSINE, where: Any = None) -> DataFrame:
    """``qid, id, score, rank`` of each query's k best rows. ``queries``: qid, vector; ``rows``: id, vector.

    A bounded set of queries goes to all executors, and each partition of the rows keeps k
    candidates for each query, so that only these are shuffled to be ranked. More queries and
    the rows are dealt by hash to the cells of a grid, in which each pair meets once.
    """
    metric = Metric.parse(metric)
    if k < 1:
        raise InvalidInput("k must be positive")
    spark = rows.sparkSession
    asked = queries.select("qid", V.doubles("vector").alias("vector")).where(F.col("vector").isNotNull())
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    kinds = {"qid": queries.schema["qid"].dataType, "id": rows.schema["id"].dataType}
    schema = StructType([StructField("qid", kinds["qid"]), StructField("id", kinds["id"]), StructField("score", DoubleType())])
    if not size["n"]:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1).cast("long"))
    dim = size["d"]
    asked = asked.where(F.size("vector") == dim)
    found = rows.where(V.searchable(F.col("vector")) & (F.size("vector") == dim) & _predicate(where, "core")).select("id", "vector")
    arrow = {c: pa.field(c, to_arrow_type(t)).type for c, t in kinds.items()}

    def result(names: np.ndarray, tops: _Tops) -> pa.RecordBatch:
        q, ids, value = tops.found
        return pa.RecordBatch.from_arrays([pa.array(names[q].tolist(), arrow["qid"]), pa.array(ids.tolist(), arrow["id"]), pa.array(value)], names=["qid", "id", "score"])

    if size["n"] <= QUERY_BLOCK and size["n"] * dim * 8 <= QUERY_BYTES:
        block = asked.orderBy("qid").collect()
        names = np.empty(len(block), object)
        names[:] = [r["qid"] for r in block]
        held = spark.sparkContext.broadcast((names, np.array([r["vector"] for r in block], float)))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            tops = _Tops(q, k, metric)
            for p in parts:
                if p.num_rows:
                    tops.add(p.column("id").to_numpy(zero_copy_only=False), _vectors(p.column("vector")))
            yield result(names, tops)

        out = found.mapInArrow(run, schema)
    else:
        across = max(1, -(-size["n"] // QUERY_BLOCK), -(-size["n"] * dim * 8 // QUERY_BYTES))
        down = max(1, -(-found.count() * dim * 8 // CELL_BYTES))
        cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
        left = asked.withColumn("r", F.pmod(F.xxhash64("qid"), F.lit(across))).withColumn("c", cells(down))
        right = found.withColumn("c", F.pmod(F.xxhash64("id", "vector"), F.lit(down))).withColumn("r", cells(across))

        def cell(a: pa.Table, b: pa.Table) -> pa.Table:
            a, b = a.combine_chunks(), b.combine_chunks()
            tops = _Tops(_vectors(a.column("vector").combine_chunks()), k, metric) if a.num_rows else _Tops(np.zeros((0, dim)), k, metric)
            for p in b.to_batches(10_000) if a.num_rows else ():
                tops.add(p.column("id").to_numpy(zero_copy_only=False), _vectors(p.column("vector")))
            names = np.empty(a.num_rows, object)
            names[:] = a.column("qid").to_pylist()
            return pa.Table.from_batches([result(names, tops)])

        out = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(cell, schema)
    w = Window.partitionBy("qid").orderBy(V.order(metric), "id")
    return out.where(~F.isnan("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


def search_join(queries: DataFrame, rows: DataFrame, k: int, metric: Metric | str = Metric.COSINE) -> DataFrame:
    """The join of queries with their k best rows: :func:`batch_search` without a filter."""
    return batch_search(queries, rows, k, metric)


def merge_top(parts: list[DataFrame], k: int, metric: Metric | str = Metric.COSINE) -> DataFrame:
    """The k best of several result sets."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(V.order(metric), "id").limit(k)


def tiered_search(rows: DataFrame, query: Sequence[float], k: int, threshold: float, tiers: Sequence[str], now: float | None = None) -> DataFrame:
    """The k best over several tiers: each tier's k best first, then threshold and expiry, then all by score and tier.

    ``rows``: tier, id, vector, expires_at. Expired rows take places in their tier's k, as they do one tier at a time.
    """
    order = {t: i for i, t in enumerate(tiers)}
    number = F.create_map(*[x for t, i in order.items() for x in (F.lit(t), F.lit(i))])[F.col("tier")]
    n = float(np.sqrt(np.square(np.asarray(query, float)).sum())) or 1.0
    scored = rows.where(F.col("tier").isin(*tiers)).withColumn("score", V.dot(V.doubles("vector"), V.literal([x / n for x in query]))).withColumn("_tier", number)
    w = Window.partitionBy("tier").orderBy(F.desc("score"), "id")
    best = scored.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).where(F.col("score") >= threshold)
    if now is not None:
        best = best.where(F.col("expires_at").isNull() | ~(F.lit(now) > F.col("expires_at")))
    return best.orderBy(F.desc("score"), "_tier", "id").limit(k).drop("_rank", "_tier")


def recall(exact: DataFrame, approximate: DataFrame, by: Sequence[str] = ("qid", "id")) -> DataFrame:
    """One row, ``recall``: the share of exact results that are found; 1 if there are none."""
    hit = approximate.select(*by).distinct().withColumn("_hit", F.lit(1))
    return exact.select(*by).join(hit, list(by), "left").agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(1.0)).alias("recall"))


def budget(rows: DataFrame, limit: int, order: Sequence[str], cost: str) -> DataFrame:
    """Greedy choice under a total cost: rows in order, each taken if it still fits.

    What is left only shrinks, so after each BUDGET_CHUNK rows that could fit, the next ones are
    sought by a top-k over all rows among those that still can. The driver holds a chunk and the
    keys of what is taken at a cost, which the limit bounds; rows without a cost all fit. Costs
    can't be negative, and a null cost never fits. Among rows of one place the cheapest is first.
    """
    spark, at, c = rows.sparkSession, F.struct(*order, cost), F.col(cost)
    if (least := rows.agg(F.min(cost)).first()[0]) is not None and least < 0:
        raise InvalidInput("costs can't be negative")
    each = rows.where((c > 0) & ~F.isnan(c.cast("double"))).groupBy(*order, cost).agg(F.count("*").alias("_n"))
    kinds = each.schema
    left, last, taken = limit, None, []
    while left > 0:
        able = each.where(c <= F.lit(left))
        if last is not None:
            able = able.where(at > F.struct(*[F.lit(last[f]).cast(kinds[f].dataType).alias(f) for f in (*order, cost)]))
        got = able.orderBy(at).limit(BUDGET_CHUNK).collect()
        for r in got:
            if n := int(min(r["_n"], left // r[cost])):
                taken.append((*[r[f] for f in (*order, cost)], n))
                left -= n * r[cost]
        if len(got) < BUDGET_CHUNK:
            break
        last = got[-1]
    free = rows.where(c == 0) if limit >= 0 else rows.limit(0)
    if not taken:
        return free.orderBy(at)
    keys = spark.createDataFrame(taken, StructType([*[StructField(f"_k{i}", kinds[f].dataType) for i, f in enumerate((*order, cost))], StructField("_n", LongType())]))
    match = [F.col(f).eqNullSafe(F.col(f"_k{i}")) for i, f in enumerate((*order, cost))]
    found = rows.join(F.broadcast(keys), match)
    # of rows that repeat place and cost only so many were taken
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(match))]).orderBy(F.lit(0))
    paid = found.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= F.col("_n")).select(*rows.columns)
    return paid.unionByName(free).orderBy(at)
