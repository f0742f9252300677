"""Metrics, schemas and errors."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

MAX_DIMENSIONS = 65536


class MemError(Exception):
    """Base of all errors of the engine."""


class DimensionMismatch(MemError, ValueError):
    pass


class DimensionsTooLarge(MemError, ValueError):
    pass


class InvalidDimensions(MemError, ValueError):
    pass


class InvalidInput(MemError, ValueError):
    pass


class InvalidFormat(MemError, ValueError):
    pass


class Deserialization(MemError, ValueError):
    pass


class Serialization(MemError, ValueError):
    pass


class NotFound(MemError, KeyError):
    pass


class CollectionNotFound(MemError, KeyError):
    pass


class CollectionExists(MemError, ValueError):
    pass


class Corruption(MemError, IOError):
    pass


class TransactionConflict(MemError, RuntimeError):
    pass


class Metric(str, Enum):
    COSINE = "cosine"
    DOT = "dot"
    L2 = "l2"

    @classmethod
    def parse(cls, name: str | Metric) -> Metric:
        """By name, in any case; ``euclidean`` is l2."""
        key = str(getattr(name, "value", name)).lower()
        key = "l2" if key == "euclidean" else key
        try:
            return cls(key)
        except ValueError:
            raise InvalidInput(f"unknown metric: {name}") from None

    @property
    def higher_is_better(self) -> bool:
        return self is not Metric.L2


def check_dimensions(n: int) -> int:
    if n < 1:
        raise InvalidDimensions("a collection has one dimension at least")
    if n > MAX_DIMENSIONS:
        raise DimensionsTooLarge(f"{n} dimensions; at most {MAX_DIMENSIONS} are allowed")
    return n


#: A row of a collection's append-only log. ``ord`` orders the rows of one commit.
LOG = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType(), False)),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("expires_at", T.LongType()),
        T.StructField("op", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ord", T.LongType(), False),
    ]
)
RESULT = T.StructType([T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("metadata", T.StringType())])
