"""Benchmark decontamination with a distributed positional inverted index.

The postings of all terms of the training documents are stored once, in the shared folder,
in segments of consecutive documents: for each term its positions, for each document its
first position. Any test set, in rounds of a bounded size, is looked up in it. A phrase is
found by taking the postings of its rarest term in the segment, shifting them to the
phrase's start, and intersecting them with the postings of the next-rarest terms, shifted
likewise, until none or all terms are done.

Terms are held as 64-bit hashes (XXH3). Two of a billion terms share a hash with a chance of
3 %, and to be mistaken for a phrase all ten terms would have to agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, rebatched, release, small_batches

#: Words of a window.
WINDOW = 10
#: Test text of one round at most: bounds what is broadcast. More text takes more rounds over the index.
ROUND_BYTES = 8 << 20
#: Words of a segment, about; a longer document is a segment of its own.
SEGMENT_WORDS = 1 << 19
#: Postings that are intersected at a time, about.
CANDIDATES = 1 << 20

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and whatever isn't ASCII, with A to Z in lower case."""
    return (text or b"").translate(_TABLE).split()


def term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


@dataclass
class Test:
    """Windows of test items as numbers of terms, rows padded by -1; ``terms``: the terms' hashes."""

    terms: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, rows: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> Test:
        vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [vocab.setdefault(w, len(vocab)) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                got = found.setdefault(tuple(ids[i : i + window]), set())
                if item is not None:
                    got.add(item)
        w = np.full((len(found), window), -1, np.int32)
        for k, ids in enumerate(found):
            w[k, : len(ids)] = ids
        return cls(np.array([term(x) for x in vocab], np.uint64), w, (w >= 0).sum(1).astype(np.int32), [sorted(x) for x in found.values()])


SEGMENT = "doc_ids array<bigint>, keys array<bigint>, sizes array<int>, terms binary, counts binary, positions binary"


def _numbered(text: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words' hashes, and which of them each word is; the last byte is a space."""
    keep = ~space
    keep[1:] |= ~space[:-1]  # a word and one space after it
    text = text[keep]
    ends = np.flatnonzero(text == 32) + 1
    if len(ends) and ends[0] == 1:  # separators before the first word
        text, ends = text[1:], ends[1:] - 1
    edges = np.concatenate([[0], ends]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(text)]).dictionary_encode()
    hashes = np.array([term(w[:-1]) for w in found.dictionary.to_pylist()], np.uint64)
    return hashes, found.indices.to_numpy()


def _segment(ids: list, keys: list, parts: list[bytes]) -> pa.RecordBatch:
    whole = np.frombuffer(b"".join([*(x for p in parts for x in (p, b" "))]).translate(_TABLE), np.uint8)
    space = whole == 32
    hashes, number = _numbered(whole, space)
    # where words end tells how many a document has
    last = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    ends = np.searchsorted(last, np.cumsum([len(p) + 1 for p in parts]))
    sizes = np.diff(ends, prepend=0).astype(np.int32)
    # positions count from 1 and skip one between documents, so that no phrase spans two of them
    at = np.arange(1, len(number) + 1) + np.repeat(np.arange(len(parts)), sizes)
    by_hash = np.argsort(hashes)
    place = np.empty(len(hashes), np.int32)
    place[by_hash] = np.arange(len(hashes), dtype=np.int32)
    number = place[number]
    order = np.argsort(number, kind="stable")
    counts = np.bincount(number, minlength=len(hashes))
    row = [ids, keys, sizes]
    kinds = [pa.int64(), pa.int64(), pa.int32()]
    cols = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(row, kinds, strict=True)]
    blobs = [hashes[by_hash].astype("<u8"), counts.astype("<i4"), at[order].astype("<i4")]
    return pa.RecordBatch.from_arrays([*cols, *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], names=["doc_ids", "keys", "sizes", "terms", "counts", "positions"])


def build(docs: DataFrame) -> DataFrame:
    """Index segments with the postings of every word of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        keys: list = []
        parts: list[bytes] = []
        total = 0
        for b in rebatched(batches):
            for i, k, text in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                size = len(text or b"") // 6
                if parts and total + size > SEGMENT_WORDS:
                    yield _segment(ids, keys, parts)
                    ids, keys, parts, total = [], [], [], 0
                ids.append(i)
                keys.append(k)
                parts.append(text or b"")
                total += size + 1
        if parts:
            yield _segment(ids, keys, parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, SEGMENT)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: a segment's lists are large as Python objects."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class Segment:
    """Postings of a segment: sorted positions of each term, end to end."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.concatenate([[1], 1 + np.cumsum(self.sizes[:-1] + 1)]).astype(np.int64)
        self.length = int(self.starts[-1] + self.sizes[-1] + 1)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.positions = np.frombuffer(row["positions"], "<i4").astype(np.int64)
        # lists of later terms hold larger keys, so one search finds a position in one term's list
        self.keys = np.repeat(np.arange(len(self.terms)) * (self.length + 1), self.counts) + self.positions

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Which list each term (a hash) has; -1: none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def lists(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of each of these lists, end to end, and whose they are."""
        n = self.counts[which]
        whose = np.repeat(np.arange(len(which)), n)
        return self.positions[np.repeat(self.ends[which] - np.cumsum(n), n) + np.arange(int(n.sum()))], whose

    def holds(self, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each of these lists holds the position."""
        key = which * (self.length + 1) + at
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[k] == key) & (at <= self.length)

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def phrases(self, test: Test) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of every occurrence, from lists of bounded length at a time."""
        place = np.append(self.find(test.terms), -2)  # the last one is padding's
        some = np.flatnonzero((place[test.windows] != -1).all(1))
        if not len(some):
            return
        lists = place[test.windows[some]]
        order = np.argsort(np.where(lists >= 0, self.counts[lists], 1 << 40), axis=1, kind="stable")
        n = np.cumsum(self.counts[lists[np.arange(len(some)), order[:, 0]]])
        cuts = np.searchsorted(n, np.arange(CANDIDATES, int(n[-1]), CANDIDATES))
        for part in np.split(np.arange(len(some)), np.unique(cuts)):
            if not len(part):
                continue
            at, whose = self.lists(lists[part, order[part, 0]])
            w = part[whose]
            at = at - order[w, 0]
            w, at = w[at >= 1], at[at >= 1]
            for k in range(1, lists.shape[1]):
                col = order[w, k]
                own = lists[w, col]
                ok = own < 0
                real = np.flatnonzero(~ok)
                ok[real] = self.holds(own[real], at[real] + col[real])
                w, at = w[ok], at[ok]
                if not len(w):
                    break
            yield some[w], at


HITS = "doc_id long, key long, n_words long, n_hit long, items array<string>, spans array<bigint>"


def hits(index: DataFrame, test: Test) -> DataFrame:
    """``doc_id, key, n_words, n_hit, items, spans`` of every indexed document; spans: first word (from 0) and end of each hit run, end to end."""
    held = index.sparkSession.sparkContext.broadcast(test)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = held.value
        for b in batches:
            for row in _each(b):
                seg = Segment(row)
                edge = np.zeros(seg.length + 1, np.int64)
                pairs: list[np.ndarray] = []
                for w, at in seg.phrases(test) if len(test.windows) else ():
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + test.lengths[w], -1)
                    pairs.append(np.unique(np.stack([seg.documents(at), w]), axis=1))
                hit = np.cumsum(edge) > 0
                sums = np.concatenate([[0], np.cumsum(hit)])
                turn = np.flatnonzero(np.diff(hit, prepend=False))  # runs end within their document
                where = seg.documents(turn[::2])
                turn -= np.repeat(seg.starts[where], 2)
                runs = np.split(turn, 2 * np.searchsorted(where, np.arange(1, len(seg.sizes))))
                n_hit = sums[seg.starts + seg.sizes] - sums[seg.starts]
                found: dict[int, set[str]] = {}
                for d, k in (x for p in pairs for x in p.T.tolist()):
                    found.setdefault(d, set()).update(test.items[k])
                lists = [sorted(found.get(d, ())) for d in range(len(seg.sizes))]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(seg.sizes), pa.array(n_hit), pa.array(lists, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_words", "n_hit", "items", "spans"])

    return index.mapInArrow(run, HITS)


def merged(rounds: list[DataFrame]) -> DataFrame:
    """The hits of several rounds over the same documents as those of one. Rows that repeat a
    document are alike in every round, so they are counted and given back as often."""
    got = rounds[0]
    for other in rounds[1:]:
        got = got.unionByName(other)
    got = got.groupBy("doc_id", "key", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"), (F.count("*") / len(rounds)).cast("int").alias("times"))
    got = got.select("doc_id", "key", "n_words", "items", "spans", F.explode(F.array_repeat(F.lit(0), F.col("times"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            spans = []
            for r in rows:
                edge = np.zeros(r["n_words"] + 1, np.int64)
                np.add.at(edge, np.array(r["spans"][::2], int), 1)
                np.add.at(edge, np.array(r["spans"][1::2], int), -1)
                spans.append(np.flatnonzero(np.diff(np.cumsum(edge) > 0, prepend=False)))
            n = [int((x[1::2] - x[::2]).sum()) for x in spans]
            cols = [b.column("doc_id"), b.column("key"), b.column("n_words"), pa.array(n, pa.int64()), b.column("items"), pa.array(spans, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_words", "n_hit", "items", "spans"])

    return got.mapInArrow(run, HITS)


def proximity(index: DataFrame, words_: list[str], width: int) -> DataFrame:
    """``doc_id, key, position`` (from 1) of each place of a document's rarest such word with all others
    within ``width`` words of it in the same document, in any order. Words that don't occur are nowhere."""
    spark = index.sparkSession
    schema = "doc_id long, key long, position long"
    terms = np.unique(np.array([term(w) for t in words_ for w in words(t.encode())], np.uint64))
    if not len(terms):
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _each(b):
                seg = Segment(row)
                which = seg.find(terms)
                if which.min() < 0:
                    continue
                which = which[np.argsort(seg.counts[which], kind="stable")]
                at, _ = seg.lists(which[:1])
                d = seg.documents(at)
                low = np.maximum(at - width, seg.starts[d])
                high = np.minimum(at + width, seg.starts[d] + seg.sizes[d] - 1)
                ok = np.ones(len(at), bool)
                for t in which[1:]:
                    p, _ = seg.lists(np.array([t]))
                    ok &= np.searchsorted(p, low, "left") < np.searchsorted(p, high, "right")
                d, at = d[ok], at[ok]
                cols = [pa.array([row["doc_ids"][x] for x in d], pa.int64()), pa.array([row["keys"][x] for x in d], pa.int64()), pa.array(at - seg.starts[d] + 1)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "position"])

    return index.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, key, n_words, n_hit, items, spans`` of every document; key: xxhash64 of its text.

    A window is ``window`` consecutive words of an item; a shorter item, but not an empty
    one, is one window. A document's word is hit inside any occurrence of a window.
    ``items`` are the ids, as strings in order, of items with occurring windows; an item
    without an id hits, but can't be listed. A null text has no words. Repeated documents
    and items count each; other columns don't matter, whatever their names.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    index, path = materialise(build(docs), "postings")
    return search(index, rows, window, path)


def search(index: DataFrame, rows: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """The hits of test items ``item, text`` in an index, as ``decontaminate`` gives them."""
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = -(-size // ROUND_BYTES) or 1
    done = []
    for k in range(rounds):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == k)
        got = hits(index, Test.of([(r["item"], r["text"]) for r in part.collect()], window))
        if rounds == 1:
            return got
        done.append(materialise(got, "hits")[0])
    if path:
        release(index.sparkSession, path)
    return merged(done)


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    return decontaminate(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), t AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM t))
), m AS (SELECT g.r, g.n, g.k, t.item FROM g JOIN t ON g.n = t.n AND g.s = t.s
), h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r
), l AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)
"""
