"""Toxicity by compression distance.

Two zstandard dictionaries hold the same frequent words; one adds the segments that are
over-represented in toxic training text, the other those over-represented in ordinary
text. Windows of a document's words are compressed with either, and a window counts as
evidence by how many bytes shorter the toxic dictionary makes it, beyond a threshold
calibrated on other training documents. A monotone fit turns evidence into a score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import class_sample, materialise, rebatched, small_batches

#: At most so many labelled documents of each class are used to train.
TRAIN_DOCS = 2000
#: Longer documents (UTF-8 bytes) aren't trained on, so that the driver holds 256 MB of text at most; they are scored whole.
TRAIN_BYTES = 1 << 16
#: Words whose lengths a worker keeps; bounds memory, not results.
CACHE = 300_000
#: Words of a window. Each is compressed as a block of its own, so that the lengths of repeated
#: words can be kept; a window's length is the sum of its blocks.
WINDOW = 4
#: A segment is over-represented if its share of a class's documents is so many times that of the other.
CONTRAST = 12.0
#: A segment stands in so many different contexts at least, and in this many for each hundred
#: documents of its class. A context is the pair of words around a word: copies of a document add none.
LEAST, LEAST_SHARE = 5, 0.02
#: Bytes of frequent words in either dictionary, and of a class's own segments.
COMMON_BYTES, OWN_BYTES = 4096, 24576
#: Characters that zstandard matches at least, and of a segment at most: only the beginnings of words count, as their ends are shared with others.
PIECE, SEGMENT = 5, 7
#: Bytes after the last segment of a dictionary.
END = b"\0" * 16
#: What every block ends with: zstandard looks for no match in a block's last bytes, and stores raw what hardly shrinks.
TAIL = b"|0123456789-abcdefghijklmnopqrstuvwxyz=9876543210|"
#: Bytes that a window must save to be evidence: the one that fits the calibration documents best is taken.
THRESHOLDS = range(2, 9)

_EDGE = re.compile(r"[^\w]+")


def _clean(text: str) -> list[bytes]:
    """Lower-cased words without the marks around them."""
    return _EDGE.sub(" ", text.lower()).encode().split()


def _prefixes(words: Counter, least: float) -> Counter:
    """Counts, from ``least`` on, of the beginnings of words, with the space before them, and of whole
    words. Longer ones are only sought where the shorter are frequent, so that few are held."""
    alive = {" " + w: n for w, n in words.items()}
    out = Counter({w + " ": n for w, n in alive.items() if len(w) <= 13 and n >= least})
    for k in range(4, 15):
        level: Counter = Counter()
        for w, n in alive.items():
            if len(w) >= k:
                level[w[:k]] += n
        level = Counter({p: n for p, n in level.items() if n >= least})
        out.update(level)
        alive = {w: n for w, n in alive.items() if w[:k] in level}
    return out


def _counts(words: Counter, keys: set[str]) -> Counter:
    """Counts of these beginnings and whole words."""
    out: Counter = Counter()
    for w, n in words.items():
        w = " " + w
        for p in [*(w[:k] for k in range(4, min(len(w), 14) + 1)), w + " "]:
            if p in keys:
                out[p] += n
    return out


def _segments(own: Counter, n_own: int, other: Counter, n_other: int, least: float) -> list[str]:
    """Over-represented word beginnings, the best last: each as long as nearly all its contexts share it."""


    def high(s: str) -> bool:
        return own[s] >= least and (own[s] / n_own) >= CONTRAST * (other[s] + 0.5) / n_other

    grown: dict[str, str] = {}
    longer: dict[str, list[str]] = {}
    for s in own:
        if len(s) > 4 and own[s] >= least:
            longer.setdefault(s[:-1], []).append(s)
    for s in own:
        if high(s) and not (len(s) > 4 and high(s[:-1])):
            t = s
            while len(t) < SEGMENT and t in longer and own[best := max(longer[t], key=lambda x: (own[x], x))] >= 0.9 * own[t]:
                t = best
            grown[t] = s
    return sorted(grown, key=lambda t: (own[t] / n_own - other[t] / n_other, t))


def _content(segments: list[str], size: int) -> bytes:
    """The last segments that fit."""
    out: list[bytes] = []
    for s in reversed(segments):
        b = s.encode()
        if size < len(b):
            break
        size -= len(b)
        out.append(b)
    return b"".join(reversed(out))


@dataclass
class Model:
    """Dictionaries, threshold and fit. Both dictionaries hold the tail, so no block is stored raw."""

    toxic: bytes
    ordinary: bytes
    threshold: int
    steps: list[float]
    scores: list[float]

    def __post_init__(self) -> None:
        self._coders = None
        self._saved: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coders": None, "_saved": {}}

    def gains(self, words: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves against the ordinary one, for each window."""
        if self._coders is None:
            self._coders = [_coder(self.toxic), _coder(self.ordinary)]
            self._saved = {}
        if len(self._saved) > CACHE:
            self._saved.clear()
        saved, (t, o) = self._saved, (x.compress for x in self._coders)
        for w in set(words).difference(saved):
            block = b" %b %b" % (w, TAIL)
            saved[w] = len(o(block)) - len(t(block))
        each = np.fromiter(map(saved.__getitem__, words), np.int64, len(words))
        return np.add.reduceat(each, np.arange(0, len(each), WINDOW)) if len(each) else each

    def evidence(self, gains: np.ndarray) -> float:
        over = gains[gains >= self.threshold]
        return float((over - self.threshold + 1).sum())

    def score(self, evidence: float) -> float:
        return self.scores[bisect_right(self.steps, evidence) - 1]

    def score_all(self, docs: list[str]) -> list[float]:
        return [self.score(self.evidence(self.gains(_clean(t)))) for t in docs]


def _coder(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_LAZY, min_match=PIECE, window_log=16, hash_log=15, chain_log=15, search_log=6, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content or b" " * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def _contexts(docs: list[tuple[str, int]]) -> dict[int, dict[int, str]]:
    """Each class's words by the hash of the word with the words around it; equal words are one object."""
    out: dict[int, dict[int, str]] = {0: {}, 1: {}}
    known: dict[str, str] = {}
    for text, y in docs:
        words = [known.setdefault(w, w) for w in map(bytes.decode, _clean(text))]
        for x in zip(["", *words], words, [*words[1:], ""], strict=False):
            out[y][hash(x)] = x[1]
    return out


def train(docs: list[tuple[str, int]]) -> Model:
    """Fit on (text, label) pairs: two of three of each class make the dictionaries, the third calibrates.

    Segments must hold up in new contexts of the calibration documents. Without toxic or
    without ordinary text every score is the share of toxic labels.
    """
    rate = sum(y for _, y in docs) / len(docs) if docs else 0.0
    flat = Model(b"", b"", 1, [0.0], [rate])
    sides = [[x for x in docs if x[1] == y] for y in (0, 1)]
    fit, rest = ([x for side in sides for i, x in enumerate(side) if (i % 3 == 2) == last] for last in (False, True))
    if len({y for _, y in fit}) < 2:
        return flat
    seen_in = _contexts(fit)
    new = {y: {h: w for h, w in c.items() if h not in seen_in[y]} for y, c in _contexts(rest).items()}
    single = {y: Counter(seen_in[y].values()) for y in seen_in}
    total = {y: max(1, len(seen_in.pop(y))) for y in (0, 1)}
    least = {y: max(LEAST, LEAST_SHARE * sum(z == y for _, z in fit)) for y in single}
    count = {y: _prefixes(single[y], least[y]) for y in single}
    segments = {y: _segments(count[y], total[y], _counts(single[1 - y], set(count[y])), total[1 - y], least[y]) for y in count}
    later = {y: Counter(new[y].values()) for y in new}
    size = {y: max(1, len(new.pop(y))) for y in (0, 1)}
    again = {y: _counts(later[y], {x for z in segments.values() for x in z}) for y in later}
    freq = single[0] + single[1]
    held = {y: [x for x in segments[y] if again[y][x] >= max(2, count[y][x] * size[y] / total[y] / 4) and again[y][x] / size[y] >= CONTRAST / 2 * again[1 - y][x] / size[1 - y]] for y in segments}
    marked = re.compile("|".join(re.escape(x) for y in held for x in held[y]) or "$^")
    common = _content([" " + w for w, _ in sorted(freq.items(), key=lambda x: (x[1], x[0])) if not marked.search(f" {w} ")], COMMON_BYTES)
    own = {y: _content(held[y], OWN_BYTES) for y in held}
    # a class's own segments are nearest to the window, as far from it in either dictionary; its last bytes aren't indexed
    size = max(map(len, own.values()))
    model = Model(common + TAIL + own[1].rjust(size, b"\0") + END, common + TAIL + own[0].rjust(size, b"\0") + END, 1, [0.0], [rate])
    seen = [(model.gains(_clean(t)), y) for t, y in rest]
    fits = []
    for model.threshold in THRESHOLDS:
        points = sorted((model.evidence(g), y) for g, y in seen)
        model.steps, model.scores = _monotone(points)
        loss = -sum(math.log(max(1e-3, min(1 - 1e-3, p if y else 1 - p))) for e, y in points for p in [model.score(e)])
        fits.append((loss, model.threshold, model.steps, model.scores))
    _, model.threshold, model.steps, model.scores = min(fits)
    return model


def _monotone(points: list[tuple[float, int]]) -> tuple[list[float], list[float]]:
    """Rising step function by pooling neighbours that fall; shares are smoothed by half a document."""
    pools: list[list[float]] = []
    for e, y in points:
        if pools and pools[-1][0] == e:
            pools[-1][1] += y
            pools[-1][2] += 1
        else:
            pools.append([e, y, 1])
        while len(pools) > 1 and pools[-1][1] / pools[-1][2] <= pools[-2][1] / pools[-2][2]:
            _, y1, n1 = pools.pop()
            pools[-1][1] += y1
            pools[-1][2] += n1
    if not pools:
        return [0.0], [0.0]
    pools[0][0] = -math.inf
    return [p[0] for p in pools], [(p[1] + 0.5 * (p[1] / p[2])) / (p[2] + 0.5) for p in pools]


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> list[tuple[str, int]]:
    """Up to ``limit`` labelled documents of each class, the first by a hash of their id.

    Only rows whose crc32(doc_id as text) mod 4 is not 2 are taken, and no text beyond
    TRAIN_BYTES. Of several labels of a document the highest counts; null labels and null
    ids don't; of rows that repeat an id and a text one counts.
    """
    fits = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    y = labels.where(F.col("toxic").isin(0, 1)).where(fits).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    y = class_sample(y.withColumn("h", F.xxhash64("doc_id")), "y", "h", limit)  # 2 * limit short rows
    rows = docs.where(F.octet_length("text") <= TRAIN_BYTES).select("doc_id", "text").join(F.broadcast(y), "doc_id")
    rows, _ = materialise(rows.withColumn("k", F.xxhash64("doc_id", "text")), "labelled")  # the corpus is read once
    rows = class_sample(rows, "y", "k", limit)  # an id may stand on many rows
    return [(r["text"], r["y"]) for r in rows.orderBy("h", "doc_id", "text").select("text", "y").collect()]


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Add ``column`` (0 to 1) to every row, from its whole text, however long; a null or empty
    text has no evidence. Nothing is shuffled.

    A column of that name is replaced; other columns and repeated rows stay as they are. No
    rows in, no rows out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(column)
    held = spark.sparkContext.broadcast(model)  # two dictionaries of 32 KB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in rebatched(batches):
            got = m.score_all([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, column])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(column, "double"))


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score_documents(docs.select("doc_id", "text"), train(training_rows(docs, labels)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
