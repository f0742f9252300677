"""Substring deduplication by a relative Lempel-Ziv parse of the whole corpus.

Reference blocks. Every window of 35 words has an anchor: of the 8-word sequences in it
the one with the least hash. Successive windows with the same anchor make a block, some 35
to 62 words, that is indexed by its anchor. Equal windows have equal anchors, so a window
can only repeat in blocks under the same anchor, and every block of the corpus is indexed.

Matches. Every block that repeats as a whole gets a reference: the first place that holds it,
in the order of a hash of the document, or for that place itself the last. Where a block under a repeated
anchor isn't repeated as a whole, its windows are looked up one by one among those of the
other blocks of that anchor, and get references likewise.

Factors. A document is parsed from left to right. At a window with a reference, matches on
the same diagonal of the same source join into one, and the longest becomes a factor (first
word, words, source document, first word there). At the factor's end the next window, which
crosses it, is checked in turn: if it has a reference the next factor starts there. Words
in no factor are literals. Factors hold 35 words at least, and all repeated windows lie in
them, so the duplicate spans are the factors' union.

Nothing is compared in pairs: blocks and windows are looked up by two 64-bit hashes, so a
passage that a third of all documents share is only a large count. Two different windows
agree in both with a chance of some n * n / 2**129: 1e-13 for the 1e13 windows of 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import free_names, join_back, materialise, rebatched, release, small_batches, texts

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 35, 8

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Powers:
    """Powers of odd bases and of their inverses modulo 2**64, as far as they have been needed."""

    def __init__(self) -> None:
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        if not self.up or len(self.up[0]) < n:
            n = 1 << n.bit_length()
            self.up, self.down = ([self._series(f(b), n) for b in _BASES] for f in (int, lambda b: pow(b, -1, 1 << 64)))

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)


_powers = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Hashes of any run of a document's words, in constant time each."""

    def __init__(self, words: list[bytes]):
        h = xxhash.xxh3_128_digest
        raw = np.frombuffer(b"".join([h(w) for w in words]), "<u8").reshape(-1, 2)
        _powers.grow(len(words) + 1)
        self.n = len(words)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw[:, k] * _powers.up[k][: self.n], dtype=np.uint64)]) for k in (0, 1)]

    def of(self, k: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[k][end] - self.sums[k][first]) * _powers.down[k][first])

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, block hash, first window and number of windows of each block."""
        if self.n < WINDOW:
            z = np.zeros(0, np.uint64)
            return z, z, z.astype(np.int64), z.astype(np.int64)
        i = np.arange(self.n - ANCHOR + 1)
        grams = self.of(0, i, i + ANCHOR)
        at = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - ANCHOR + 1).argmin(1) + np.arange(self.n - WINDOW + 1)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        n = np.diff(np.append(first, len(at)))
        anchor = at[first]
        place = ((anchor - first) * (2 * WINDOW) + n).astype(np.uint64)
        return grams[anchor], _mixed(self.of(1, first, first + n + WINDOW - 1) + place * np.uint64(_BASES[0])), first, n


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    for i, t in enumerate(texts(batch)):
        yield i, (t or b"").split()


def _keyed(docs: DataFrame, name: str = "_key") -> DataFrame:
    return docs.withColumn(name, F.xxhash64("text"))


def index(docs: DataFrame) -> DataFrame:
    """``anchor, block, doc_id, key, first, n`` of every block of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches):
            got, who = [], []
            for i, words in _rows(b):
                x = Hashed(words).blocks() if len(words) >= WINDOW else None
                if x is not None:
                    got.append(x)
                    who.append(np.full(len(x[0]), i))
            if not got:
                continue
            rows = pa.array(np.concatenate(who))
            a, h, f, n = (np.concatenate(x) for x in zip(*got, strict=True))
            cols = [pa.array(a.view(np.int64)), pa.array(h.view(np.int64)), b.column("doc_id").take(rows), b.column("_key").take(rows), pa.array(f.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["anchor", "block", "doc_id", "key", "first", "n"])

    own = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return own.mapInArrow(run, "anchor long, block long, doc_id long, key long, first int, n int")


def windows(docs: DataFrame) -> DataFrame:
    """``a, b, doc_id, key, first``: the hash of each window of the blocks listed in ``check``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches):
            check = b.column("check").to_pylist()
            out: list[tuple] = []
            for i, words in _rows(b):
                h = Hashed(words)
                at = np.unique(np.concatenate([np.arange(c["first"], c["first"] + c["n"]) for c in check[i]]))
                out.append((np.full(len(at), i), h.of(0, at, at + WINDOW), h.of(1, at, at + WINDOW), at))
            if not out:
                continue
            who, x, y, at = (np.concatenate(z) for z in zip(*out, strict=True))
            rows = pa.array(who)
            cols = [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), b.column("doc_id").take(rows), b.column("_key").take(rows), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "doc_id", "key", "first"])

    return docs.mapInArrow(run, "a long, b long, doc_id long, key long, first int")


def _place() -> Column:
    """Orders places by document, so that neighbouring blocks shared by the same documents get the same source."""
    low = 0xFFFFFF
    return F.xxhash64("doc_id", "key").bitwiseAND(F.lit(~low)).bitwiseOR(F.col("first").cast("long").bitwiseAND(F.lit(low)))


def _references(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key its rows ``c`` and two references: its first and its last place."""
    place = _place()
    out = [F.count("*").alias("c")]
    for name, pick, by in (("lo", F.min, F.min_by), ("hi", F.max, F.max_by)):
        out += [pick(place).alias(name), by("doc_id", place).alias(f"{name}_id"), by("first", place).alias(f"{name}_first")]
    return rows.groupBy(*keys).agg(*out)


def _sourced(rows: DataFrame, n: Column) -> DataFrame:
    """Matches: ``doc_id, key, first, n, source, source_first``; a place's reference is another place."""
    own = F.col("lo") == _place()
    source, at = (F.when(own, F.col(f"hi_{x}")).otherwise(F.col(f"lo_{x}")) for x in ("id", "first"))
    return rows.select("doc_id", "key", "first", n.alias("n"), source.alias("source"), at.alias("source_first"))


def matches(docs: DataFrame) -> DataFrame:
    """``doc_id, key, matches``: of each document with repeated windows, these with their references,
    as an array of (first, n, source, source_first): n windows from the first on.

    ``key`` is the text's hash; rows that repeat a document share one row here.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks, p0 = materialise(index(docs), "blocks")
    total = blocks.count()
    anchors = blocks.groupBy("anchor").agg(F.count("*").alias("c"), (F.min("block") != F.max("block")).alias("mixed")).where("c > 1")
    anchors, p1 = materialise(anchors, "repeated-anchors")
    some, p2 = materialise(join_back(blocks, anchors, ["anchor"], total).drop("c"), "blocks-of-repeated-anchors")
    release(spark, p0, p1)
    counted, p3 = materialise(_references(some, ["anchor", "block"]).where("c > 1"), "repeated-blocks")
    marked, p4 = materialise(join_back(some, counted, ["anchor", "block"], total, "left"), "marked-blocks")
    whole = marked.where("c is not null")
    # of blocks that repeat as a whole, one is enough to tell whether other blocks hold its windows
    check = marked.where(F.col("c").isNull() | (F.col("mixed") & (F.col("lo") == _place())))
    check = check.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_of")).agg(F.collect_set(F.struct("first", "n")).alias("check"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of"))
    own = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"))
    looked, p5 = materialise(windows(own.join(check, same).select("doc_id", "_key", "text", "check")), "windows")
    release(spark, p2, p3)
    twice, p6 = materialise(_references(looked, ["a", "b"]).where("c > 1"), "repeated-windows")
    more = _sourced(join_back(looked, twice, ["a", "b"], looked.count()), F.lit(1))
    found = _sourced(whole, F.col("n")).unionByName(more)
    found, _ = materialise(found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n", "source", "source_first")).alias("matches")), "matches")
    release(spark, p4, p5, p6)
    return found


def parse(found: list[dict]) -> list[tuple[int, int, int | None, int]]:
    """Factors (first word, words, source, first word there) of a document from its matches, left to right."""
    joined: list[list] = []  # first window, end, source, diagonal
    last: dict[tuple, list] = {}
    for m in sorted(found, key=lambda m: m["first"]):
        line = (m["source"], m["source_first"] - m["first"])
        if (x := last.get(line)) is not None and m["first"] <= x[1]:
            x[1] = max(x[1], m["first"] + m["n"])
        else:
            last[line] = x = [m["first"], m["first"] + m["n"], *line]
            joined.append(x)
    out = []
    at = k = 0
    reach: list | None = None
    while True:
        # of the matches that hold the next window, the one that goes farthest
        while k < len(joined) and joined[k][0] <= at:
            if reach is None or joined[k][1] > reach[1]:
                reach = joined[k]
            k += 1
        if reach is not None and reach[1] > at:
            out.append((at, reach[1] - at + WINDOW - 1, reach[2], at + reach[3]))
            at = reach[1]  # the window that crosses the factor's end
        elif k < len(joined):
            at = joined[k][0]
        else:
            return out


def deduplicate(docs: DataFrame, column: str = "kept", new: tuple[str, str, str] = ("n_words", "n_removed", "factors")) -> DataFrame:
    """Add ``n_words``, ``n_removed``, the kept text (``column``; words joined by one space) and the
    ``factors`` (array of first, words, source, source_first; words count from 0) to every row.

    Words are runs of anything but ASCII white space. A word is removed if a window of 35
    words that covers it also starts anywhere else, in the same document too. Null texts
    have no words, texts of under 35 words lose none; rows that repeat an id and a text count
    as copies of each other, and so do rows without an id. A factor's source is a doc_id,
    null if that place has none. Columns of these names (``new`` gives others) are replaced;
    all others stay, whatever their names. No rows in, no rows out.
    """
    id_, of, spans, key = free_names(docs, "_id", "_of", "_matches", "_key")
    found = matches(docs).toDF(id_, of, spans)
    docs = docs.drop(*[c for c in new if c != "text"], *([column] if column != "text" else []))
    own = [c for c in docs.columns if c != column]
    joined = _keyed(docs, key).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(of)), "left").select(*docs.columns, spans)
    schema = StructType([docs.schema[c] for c in own]).add(column, "string").add(new[0], "long").add(new[1], "long")
    one = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_first", pa.int32())])
    factor = StructType().add("first", "integer").add("words", "integer").add("source", "long").add("source_first", "integer")
    schema = schema.add(new[2], ArrayType(factor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches):
            spans_of = b.column(spans).to_pylist()
            kept, n, gone, parsed = [], [], [], []
            for i, words in _rows(b):
                rest, factors = words, parse(spans_of[i] or [])
                if factors:
                    rest, end = [], 0
                    for first, size, _, _ in factors:
                        rest += words[end:first]
                        end = max(end, first + size)
                    rest += words[end:]
                kept.append(b" ".join(rest))
                n.append(len(words))
                gone.append(len(words) - len(rest))
                parsed.append([dict(zip(("first", "words", "source", "source_first"), f, strict=True)) for f in factors])
            cols = [b.column(c) for c in own]
            cols += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(parsed, pa.list_(one))]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, column, *new])

    return joined.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    return deduplicate(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), p AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)
), x AS (
  SELECT r, k, w[k] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM x ANTI JOIN p USING (r, k) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
