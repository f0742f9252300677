"""Vector arithmetic as columns. Everything is computed in double precision."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Metric

#: Vectors shorter than this count as zero when they are normalised (fixed value: the machine epsilon of 32-bit floats).
EPSILON = 1.1920929e-07


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(values: Iterable[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def normalize(a: Column) -> Column:
    """Unit vector; a vector shorter than the machine epsilon becomes zero."""
    # the norm is bound to a variable: within the inner lambda it would be computed for each component
    one = F.transform(F.array(norm(a)), lambda n: F.when(n < EPSILON, F.transform(a, lambda x: F.lit(0.0))).otherwise(F.transform(a, lambda x: x / n)))
    return F.get(one, F.lit(0))


def is_normalized(a: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(norm(a) - 1.0) < tolerance


def score(metric: Metric | str, a: Column, b: Column) -> Column:
    """Cosine and dot products are inner products (cosine of unit vectors); l2 is the squared distance."""
    return l2_squared(a, b) if Metric.parse(metric) is Metric.L2 else dot(a, b)


def browser_score(metric: Metric | str, a: Column, b: Column) -> Column:
    """The browser build's scores: cosine of raw vectors (0 for a zero vector), and minus the
    distance for l2, so that more is always better."""
    metric = Metric.parse(metric)
    if metric is Metric.L2:
        return -F.sqrt(l2_squared(a, b))
    if metric is Metric.DOT:
        return dot(a, b)
    n = norm(a) * norm(b)
    return F.when(n == 0.0, F.lit(0.0)).otherwise(dot(a, b) / n)


def searchable(v: Column) -> Column:
    """False for a vector whose first component is NaN: it is skipped by searches and reads."""
    return v.isNotNull() & ~F.coalesce(F.isnan(F.get(v, F.lit(0))), F.lit(False))


def order(metric: Metric | str, by: str = "score") -> Column:
    return F.desc(by) if Metric.parse(metric).higher_is_better else F.asc(by)


def parse_vector(text: Column) -> Column:
    """``"0.1, 0.2"`` as floats; parts that aren't numbers become null."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("float"))


def format_vector(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")
