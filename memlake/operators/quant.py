"""Scalar and product quantisation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..types import InvalidInput, Metric

#: Rows that product quantisers are trained on at most, centroids of a subspace, and rounds (fixed values).
TRAIN_ROWS, CENTROIDS, ROUNDS = 10_000, 256, 10
#: More than rounding changes sums of some thousand products of doubles, relative to the lengths of the vectors.
ROUNDING = 1e-11


def fit_scalar(rows: DataFrame, vec: str = "vector") -> DataFrame:
    """``i, low, high, scale``: range of each dimension in 255 steps; scale 1 where there is no range.

    Each partition of the rows gives one row a dimension, so that no component is shuffled.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, float] = {}
        high: dict[int, float] = {}
        for p in parts:
            v = p.column("v")
            lens = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            keep = ~np.isnan(flat)
            if not keep.any():
                continue
            small, large = np.full(lens.max(), np.inf), np.full(lens.max(), -np.inf)
            np.minimum.at(small, at[keep], flat[keep])
            np.maximum.at(large, at[keep], flat[keep])
            for i, (x, y) in enumerate(zip(small.tolist(), large.tolist(), strict=True)):
                low[i], high[i] = min(x, low.get(i, np.inf)), max(y, high.get(i, -np.inf))
        found = sorted(i for i in low if low[i] <= high[i])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([low[i] for i in found], pa.float64()), pa.array([high[i] for i in found], pa.float64())], names=["i", "low", "high"])

    each = rows.select(V.doubles(vec).alias("v")).where("v is not null").mapInArrow(run, "i int, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    width = F.col("high") - F.col("low")
    return each.withColumn("scale", F.when(width < V.EPSILON, F.lit(1.0)).otherwise(width / 255))


@dataclass
class ScalarQuantizer:
    low: list[float]
    scale: list[float]

    @classmethod
    def fit(cls, rows: DataFrame, vec: str = "vector") -> ScalarQuantizer:
        """Two numbers for each dimension reach the driver."""
        got = sorted(fit_scalar(rows, vec).collect(), key=lambda r: r["i"])
        return cls([r["low"] for r in got], [r["scale"] for r in got])

    def _with(self, v: Column, f) -> Column:
        z = F.arrays_zip(v.alias("x"), V.literal(self.low).alias("low"), V.literal(self.scale).alias("scale"))
        return F.transform(z, lambda t: f(t["x"], t["low"], t["scale"]))

    def quantize(self, v: Column) -> Column:
        """Codes 0 to 255, cut off, not rounded."""
        return self._with(v, lambda x, low, scale: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - low) * (F.lit(1.0) / scale)))).cast("int"))

    def dequantize(self, codes: Column) -> Column:
        return self._with(codes, lambda x, low, scale: x * scale + low)

    def asymmetric_dot(self, query: list[float], codes: Column) -> Column:
        """Inner product of an exact query with decoded codes, from per-dimension weights."""
        weights = V.literal([q * s for q, s in zip(query, self.scale, strict=True)])
        return V.dot(codes.cast("array<double>"), weights) + F.lit(float(sum(q * m for q, m in zip(query, self.low, strict=True))))


def integer_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)


def integer_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def signed_codes(v: Column) -> Column:
    """Codes -127 to 127 of unit vectors, cut towards zero."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x * 127)).cast("int"))


def subspaces(dim: int) -> int:
    """Parts of a vector: the largest of 48, 32, 16 and 8 that divides it, else one for each dimension."""
    return next((m for m in (48, 32, 16, 8) if dim % m == 0), dim)


@dataclass
class ProductQuantizer:
    """Codebooks of shape (parts, centroids, dimensions of a part)."""

    books: np.ndarray

    @classmethod
    def train(cls, rows: DataFrame, vec: str = "vector", parts: int | None = None, centroids: int = CENTROIDS, rounds: int = ROUNDS, sample: int = TRAIN_ROWS) -> ProductQuantizer:
        """Fit on a bounded sample: the rows with the least hashes of their vectors. Subspaces are trained in parallel."""
        spark = rows.sparkSession
        got = rows.where(F.col(vec).isNotNull()).select(V.doubles(vec).alias("v"), F.xxhash64(vec).alias("h")).orderBy("h").limit(sample).collect()
        if not got:
            raise InvalidInput("no vectors to train on")
        data = np.array([r["v"] for r in got])
        m = parts or subspaces(data.shape[1])
        if data.shape[1] % m:
            raise InvalidInput(f"{data.shape[1]} dimensions don't fall into {m} parts")
        held = spark.sparkContext.broadcast(np.stack(np.split(data, m, axis=1)))

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in it:
                for part in p["id"]:
                    yield pd.DataFrame({"part": [part], "book": [kmeans(held.value[part], centroids, rounds).ravel()]})

        books = spark.range(0, m, 1, min(m, 64)).mapInPandas(run, "part long, book array<double>").collect()
        return cls(np.stack([np.array(r["book"]).reshape(-1, data.shape[1] // m) for r in sorted(books, key=lambda r: r["part"])]))

    def _encode(self, v: np.ndarray) -> np.ndarray:
        m, _, d = self.books.shape
        parts = v.reshape(len(v), m, d)
        out = np.empty((len(v), m), np.int16)
        for j in range(m):
            b = self.books[j]
            out[:, j] = (np.square(b).sum(1)[None] - 2 * parts[:, j] @ b.T).argmin(1)
        return out

    def encode(self, rows: DataFrame, vec: str = "vector", column: str = "codes", error: str | None = None) -> DataFrame:
        """Add the number of the nearest centroid of each part and, if named, an upper bound of the length of what the codes lose."""
        rows = rows.drop(column, *[error] if error else [])
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, `{column}` array<smallint>{f', `{error}` double' if error else ''}"

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in it:
                if len(p):
                    v = np.stack(p[vec].to_numpy()).astype(float)
                    codes = self._encode(v)
                    # the second term is more than rounding adds to this length, and to products with the vector
                    lost = {error: np.sqrt(np.square(v - self.decode(codes)).sum(1)) * (1 + ROUNDING) + np.sqrt(np.square(v).sum(1)) * ROUNDING} if error else {}
                    yield p.assign(**{column: list(codes)}, **lost)

        return rows.mapInPandas(run, schema)

    def search(self, coded: DataFrame, query: Sequence[float], k: int = 10, vec: str = "vector", column: str = "codes", error: str = "error") -> DataFrame:
        """``id, score`` of the k largest inner products with a query, largest first, ties to the smaller id: the
        same as without codes. ``coded``: id, vector, and what :meth:`encode` adds, the error included.

        A product differs from that of the codes by the error times the query's length at most. Each partition
        keeps the k largest lower ends so far, and drops rows whose upper ends are below all of these; however
        many are left, their vectors are scored. The plan is one scan and a bounded top-k, nothing is shuffled.
        """
        if k < 1:
            raise InvalidInput("k must be positive")
        t, length = self.table(np.asarray(query, float)), float(np.sqrt(np.square(np.asarray(query, float)).sum()))

        def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full(k, -np.inf)
            for p in it:
                if not p.num_rows:
                    continue
                codes = p.column(column).flatten().to_numpy(zero_copy_only=False).reshape(p.num_rows, -1)
                score = t[np.arange(len(t)), codes].sum(1)
                gap = p.column(error).to_numpy(zero_copy_only=False) * length
                low = score - gap
                best = np.partition(np.append(best, np.where(np.isnan(low), -np.inf, low)), -k)[-k:]
                # a bound that is no number drops nothing
                yield p.select(["id", vec]).filter(pa.array(~(score + gap < best[0])))

        rows = coded.select("id", vec, column, error).mapInArrow(near, coded.select("id", vec).schema)
        scored = rows.select("id", V.score(Metric.DOT, V.doubles(vec), V.literal(query)).alias("score"))
        return scored.where(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), "id").limit(k)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[j][codes[:, j]] for j in range(len(self.books))], axis=1)

    def table(self, query: np.ndarray, higher_is_better: bool = True) -> np.ndarray:
        """Each centroid's share of the score with a query."""
        q = np.asarray(query, float).reshape(len(self.books), 1, -1)
        return (self.books * q).sum(2) if higher_is_better else np.square(self.books - q).sum(2)

    def books_frame(self, spark: SparkSession) -> DataFrame:
        """``part, code, book``: the codebooks as a table."""
        rows = [(j, c, x.tolist()) for j, b in enumerate(self.books) for c, x in enumerate(b)]
        return spark.createDataFrame(rows, "part int, code int, book array<double>")

    def asymmetric_distance(self, query, codes: Column, higher_is_better: bool = True) -> Column:
        """The score of codes with an exact query from the centroids themselves, without a table: for a
        few codes of a query. The same as :meth:`score`."""
        books, q = self.books, np.asarray(query, float).reshape(len(self.books), -1)

        @F.pandas_udf("double")
        def decode(c: pd.Series) -> pd.Series:
            k = np.stack(c.to_numpy()).astype(int)
            near = books[np.arange(len(books)), k]
            return pd.Series(((near * q) if higher_is_better else np.square(near - q)).sum((1, 2)))

        return decode(codes)

    def score(self, query, codes: Column, higher_is_better: bool = True) -> Column:
        """The score of codes with an exact query, by table look-ups."""
        t = self.table(query, higher_is_better)

        @F.pandas_udf("double")
        def look_up(c: pd.Series) -> pd.Series:
            k = np.stack(c.to_numpy()).astype(int)
            return pd.Series(t[np.arange(t.shape[0]), k].sum(1))

        return look_up(codes)


def kmeans(data: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from k-means++ seeds; a cluster that loses all rows keeps its centre."""
    rng = np.random.default_rng(seed)
    k = min(k, len(data))
    centres = [data[0]]
    near = np.square(data - centres[0]).sum(1)
    while len(centres) < k:
        total = near.sum()
        i = int(np.searchsorted(np.cumsum(near), rng.random() * total)) if total > 0 else len(centres)
        centres.append(data[min(i, len(data) - 1)])
        near = np.minimum(near, np.square(data - centres[-1]).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        who = (np.square(c).sum(1)[None] - 2 * data @ c.T).argmin(1)
        n = np.bincount(who, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, who, data)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c
