"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt to the cells of a grid: a query to every column of its
row, a candidate to every row of its column, so each pair meets in one cell. In a cell,
tiles of int8 products give cosines with an error bound from quantisation; only pairs
whose upper bound reaches the k-th best lower bound are recomputed in double precision
on the original vectors. Heaps merge the tiles of a cell, and a ranking the cells of a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell's sides at least; more where there are enough for all cores, up to so many bytes of
#: vectors: larger cells mean fewer copies of either side, their bytes bound a task's memory.
QUERY_ROWS, ROWS = 2048, 8192
QUERY_BYTES, CELL_BYTES = 16 << 20, 32 << 20
TILE = (256, 4096)
#: More than the rounding of double sums.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` (doubles) of the rows that take part: with an id and a vector that is neither
    null, empty nor zero and whose components are all there and finite."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def _matrix(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    v = t.column("v").combine_chunks()
    lens = np.diff(v.offsets.to_numpy())
    return t.column("id").to_numpy(), np.split(v.flatten().to_numpy(zero_copy_only=False), np.cumsum(lens)[:-1]) if len(lens) else []


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in the order of the components: equal vectors have equal sums."""
    s = np.zeros(len(a))
    for k in range(a.shape[1]):
        s += a[:, k] * b[:, k]
    return s


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(_dots(a, a))


def _quantised(v: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (as floats, for exact products), scales, and the lengths of errors and of codes."""
    u = v / norm[:, None]
    scale = np.abs(u).max(1) / 127
    code = np.rint(u / scale[:, None])
    back = code * scale[:, None]
    kind = np.float32 if v.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return code.astype(np.int8).astype(kind), scale, np.sqrt(((u - back) ** 2).sum(1)), np.sqrt((back**2).sum(1))


def _once(found: Iterable[tuple[float, int]]) -> Iterator[tuple[float, int]]:
    """The first entry of each id."""
    seen: set[int] = set()
    for x in found:
        if x[1] not in seen:
            seen.add(x[1])
            yield x


def cell_top(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """The k nearest of each query in a cell as (-score, id), in order; of rows that repeat an id the nearest counts."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    qn, cn = _norms(q), _norms(c)
    q8, qs, qe, _ = _quantised(q, qn)
    c8, cs, ce, cl = _quantised(c, cn)
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    for i in range(0, len(qid), TILE[0]):
        rows = slice(i, i + TILE[0])
        for j in range(0, len(cid), TILE[1]):
            cols = slice(j, j + TILE[1])
            near = (q8[rows] @ c8[cols].T) * qs[rows, None] * cs[None, cols]
            bound = ce[None, cols] + qe[rows, None] * cl[None, cols] + SLACK
            other = qid[rows, None] != cid[None, cols]
            low = np.where(other, near - bound, -np.inf)
            # a lower bound of each id, not of each row: copies don't push the k-th up
            first = np.flatnonzero(np.diff(cid[cols], prepend=cid[j] - 1))
            if len(first) < low.shape[1]:
                low = np.maximum.reduceat(low, first, axis=1)
            kth = np.partition(low, -k, 1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
            best = np.array([-h[k - 1][0] if len(h) == k else -np.inf for h in heaps[i : i + TILE[0]]])
            a, b = np.nonzero((near + bound >= np.maximum(kth, best)[:, None]) & other)
            if not len(a):
                continue
            a, b = a + i, b + j
            score = _dots(q[a], c[b]) / (qn[a] * cn[b])
            order = np.lexsort((cid[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            cut = np.flatnonzero(np.diff(a, prepend=-1))
            for s, e in zip(cut, [*cut[1:], len(a)], strict=True):
                own = zip((-score[s:e]).tolist(), cid[b[s:e]].tolist(), strict=True)
                heaps[a[s]] = list(islice(_once(heapq.merge(heaps[a[s]], own)), k))
    return heaps


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, <id_col>, score``: each query's k nearest rows with another id, by cosine.

    Exact: bounds only spare work. Ties go to the smaller id; fewer candidates give fewer
    rows. Vectors that are null, empty or zero, or hold a null or non-finite component, and
    rows without an id take no part; vectors of different length are never partners. Of
    rows that repeat an id the nearest counts. Other columns don't matter.
    """
    # whole copies of a row would share a cell
    q, c = usable(queries, id_col, vec_col).distinct(), usable(vectors, id_col, vec_col).distinct()
    nq = q.count()
    nc, dim = c.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    spare = 4 * q.sparkSession.sparkContext.defaultParallelism
    rows, cols = (max(1, -(-n // max(1, min(most // (8 * dim), max(least, n // spare))))) for n, least, most in ((nq, QUERY_ROWS, QUERY_BYTES), (nc, ROWS, CELL_BYTES)))
    # ids fall on rows and columns by hash, so one repeated vector doesn't fill a cell
    h = F.xxhash64("id")
    q = q.withColumn("r", F.pmod(h, F.lit(rows))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)).cast("array<bigint>")))
    c = c.withColumn("c", F.pmod(h, F.lit(cols))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)).cast("array<bigint>")))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, qv = _matrix(left)
        cid, cv = _matrix(right)
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        ql, cl = np.array([len(x) for x in qv], int), np.array([len(x) for x in cv], int)
        for d in np.unique(ql):
            i, j = np.flatnonzero(ql == d), np.flatnonzero(cl == d)
            if not len(j):
                continue
            for query, heap in zip(qid[i].tolist(), cell_top(qid[i], np.stack([qv[x] for x in i]), cid[j], np.stack([cv[x] for x in j]), k), strict=True):
                for neg, other in heap:
                    out["query_id"].append(query)
                    out["id"].append(other)
                    out["score"].append(-neg)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = q.groupBy("r", "c").cogroup(c.groupBy("r", "c")).applyInArrow(cell, "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) / (q.n * c.n)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
