"""Newline-delimited JSON export and import of collections.

The first line is a header: version, collection, dimensions, metric, record_count,
exported_at. Each further line is a record: id, vector, metadata, and created_at and ttl
(the seconds that are left) where there are any.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Deserialization, InvalidDimensions, InvalidFormat
from .store import Collection

VERSION = 1
_RECORD = "id string, vector array<float>, metadata string, created_at long, ttl long, _bad string"


def records(c: Collection) -> DataFrame:
    """The live records as they are exported."""
    now = c.now()
    left = F.when(F.col("expires_at").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("expires_at") - now))
    return c.live(now).select("id", "vector", "metadata", "created_at", left.alias("ttl"))


def _line() -> tuple[Column, Column]:
    whole = F.to_json(F.struct("id", "vector", "created_at", "ttl"))  # nulls are left out
    return F.concat(F.expr("substring(_j, 1, length(_j) - 1)"), F.lit(',"metadata":'), F.coalesce("metadata", F.lit("null")), F.lit("}")), whole


def export(c: Collection, path: str) -> int:
    """Write a folder of text files, the header in the first; the number of records."""
    c.flush()
    spark = c.spark
    rows = records(c)
    n = rows.count()
    head = json.dumps({"version": VERSION, "collection": c.name, "dimensions": c.dimensions, "metric": c.metric.value, "record_count": n, "exported_at": c.now()})
    line, whole = _line()
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    rows.withColumn("_j", whole).select(line.alias("value")).write.mode("overwrite").text(f"{path}/records")
    return n


def import_file(c: Collection, path: str) -> dict[str, int]:
    """Upsert all records of an export folder or of a single file, in one commit.

    Blank lines are skipped; records of other dimensions are counted as failed; a line
    that isn't JSON, a newer version or another dimension in the header is an error, and
    nothing is imported. The metric isn't compared.
    """
    began, spark = time.time(), c.spark
    split = c.files.fs.exists(c.files.jvm.org.apache.hadoop.fs.Path(f"{path}/header"))
    lines = spark.read.text([f"{path}/header", f"{path}/records"] if split else path).where(F.trim("value") != "")
    heads = lines.where(F.get_json_object("value", "$.version").isNotNull() & F.get_json_object("value", "$.record_count").isNotNull()).limit(2).collect()
    if len(heads) != 1:
        raise InvalidFormat("an export begins with one header")
    head = json.loads(heads[0]["value"])
    if head["version"] > VERSION:
        raise InvalidFormat(f"version {head['version']} isn't known")
    if head["dimensions"] != c.dimensions:
        raise InvalidDimensions(f"{head['dimensions']} dimensions; {c.name} has {c.dimensions}")
    body = lines.where(F.col("value") != heads[0]["value"])
    rows = body.select(F.from_json("value", _RECORD, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"), F.get_json_object("value", "$.metadata").alias("meta")).select("r.*", "meta")
    if rows.where(F.col("_bad").isNotNull() | F.col("id").isNull() | F.col("vector").isNull()).limit(1).count():
        raise Deserialization("a record can't be read")
    fits = F.size("vector") == c.dimensions
    n = rows.agg(F.count_if(fits).alias("ok"), F.count_if(~fits).alias("bad")).first()
    c.upsert_frame(rows.where(fits).select("id", "vector", F.coalesce("meta", F.lit("null")).alias("metadata"), "ttl"))
    return {"imported": n["ok"], "skipped": 0, "failed": n["bad"], "duration_ms": int((time.time() - began) * 1000)}
