"""Helpers shared by the corpus operators.

Intermediate tables are written as Parquet below the folder that the session
names in ``spark.checkpoint.dir``: every executor can read them, and a lost
executor costs only its running tasks.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in one Arrow batch: bounds a Python worker's memory for long texts.
BATCH_ROWS = 500
#: Words are separated by the ASCII white space that ``bytes.split`` knows: \x20 and \x09-\x0D.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch length to ``rows`` where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: Intermediate tables that this session wrote and that nobody has deleted yet.
_written: list[str] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared folder; in local mode, where none is named, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "memlake-checkpoint")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder, cutting its lineage; the table and its path."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written() -> list[str]:
    """Paths of the intermediate tables that are still there."""
    return list(_written)


def cleanup(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Delete all intermediate tables of this session but those in ``keep``: to be called when
    results have been written, as results are read from them."""
    keep = set(keep)
    release(spark, *[p for p in _written if p not in keep])


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more and let Spark drop unused shuffle files."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)
        if p in _written:
            _written.remove(p)
    gc.collect()
    jvm.System.gc()


def local_path(path: str) -> str:
    """The POSIX form of a shared path; memory-mapped files need a mounted folder."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped files need spark.checkpoint.dir on a mounted shared file system")
    return path


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that are no columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: A key is hot if it holds more than this share of all rows (and this many): so there are few of them.
HOT_SHARE, HOT_ROWS = 1e-4, 1000


def join_back(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``counted`` (one row a key, its number of rows in ``c``) for their keys.

    ``how``: inner, or left to keep rows without.

    Rows of hot keys meet theirs by broadcast, 10,000 rows at most whatever the size, and stay
    where they are; so no task has to take a key that holds a large share of all rows. Both
    sides should be tables that were written, as they are read twice.
    """
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = F.broadcast(counted.where(F.col("c") > limit))
    cold = rows.join(F.broadcast(counted.where(F.col("c") > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(counted.where(F.col("c") <= limit), keys, how))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """UTF-8 bytes of each text of a batch, without decoding them."""
    col = batch.column(name).cast(pa.binary())
    return (None if x is None else x for x in col.to_pylist())


def rebatched(batches: Iterable[pa.RecordBatch], max_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``max_bytes`` at most, so that long texts stay few at a time."""
    for b in batches:
        n = max(1, -(-b.nbytes // max_bytes))
        step = max(1, -(-b.num_rows // n))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def class_sample(rows: DataFrame, kind: str, h: str, limit: int) -> DataFrame:
    """Up to ``limit`` rows of each class, those with the smallest signed 64-bit hash ``h``; of rows
    that share class and hash one.

    A class's hashes are first cut to a range that holds about twice the limit, so that no
    class has to be gathered, and no other column moves before the rows are chosen. There may
    be any number of classes: their counts are joined by broadcast only while Spark finds
    them small.
    """
    count, rank = free_names(rows, "_count", "_rank")
    counts, p0 = materialise(rows.groupBy(kind).agg(F.count("*").alias(count)), "class-counts")
    share = (F.col(h).cast("double") + float(1 << 63)) / float(1 << 64)
    near = rows.select(kind, h).join(counts, kind).where(share <= (2 * limit + 50) / F.col(count)).select(kind, h).distinct()
    w = Window.partitionBy(kind).orderBy(h)
    least, _ = materialise(near.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit).select(kind, h), "class-sample")
    release(rows.sparkSession, p0)
    return rows.join(least, [kind, h], "left_semi").dropDuplicates([kind, h])
