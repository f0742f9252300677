"""Language identification by rank-order profiles of character n-grams.

A language's profile ranks its most frequent n-grams of one to five characters, of which
white space, digits and marks count as one blank. A document's own ranking is compared with
each profile by out-of-place distance: the sum over its n-grams of how far the ranks are
apart, or the profile's length where it lacks the n-gram.

N-grams are held as 64-bit hashes of their characters in lower case, in any script.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import class_sample, materialise, rebatched, small_batches

#: Training documents of a language at most.
TRAIN_DOCS = 300
#: N-grams of a profile and of a document, and characters of the longest.
PROFILE, LONGEST = 400, 5
#: Characters that are counted at a time: bounds memory for long texts.
PIECE = 1 << 20
UNKNOWN = "und"

_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    out[letters] = letters
    return out


def _codes(s: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that start in ``s`` (letters and single blanks); those of one blank don't count."""
    found, h = [], np.zeros(len(s), np.uint64)
    for n in range(1, min(LONGEST, len(s)) + 1):
        h = (h[: len(s) - n + 1] + s[n - 1 :] + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(29)
        found.append(h[s > 0] if n == 1 else h)
    return np.concatenate(found) if found else h


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams, from the whole text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    s = _letters()[raw].astype(np.uint64)
    s = s[(s > 0) | (np.diff(s, prepend=np.uint64(1)) != 0)]
    if not s.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(s) <= PIECE:
        return np.unique(_codes(s), return_counts=True)
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(s), PIECE):
        # pieces share a piece's last characters; what starts there is counted in the next
        own, n = np.unique(_codes(s[i : i + PIECE + LONGEST - 1]), return_counts=True)
        if i + PIECE < len(s):
            over, m = np.unique(_codes(s[i + PIECE : i + PIECE + LONGEST - 1]), return_counts=True)
            n[np.searchsorted(own, over)] -= m
        both, at = np.unique(np.concatenate([codes, own]), return_inverse=True)
        codes, counts = both, np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """Codes by falling count, ties to the smaller code."""
    if len(codes) > most:
        # ties at the last place go to the smaller code, as codes are in order
        last = -np.partition(-counts, most - 1)[most - 1]
        sure, tied = np.flatnonzero(counts > last), np.flatnonzero(counts == last)
        best = np.concatenate([sure, tied[: most - len(sure)]])
        codes, counts = codes[best], counts[best]
    return codes[np.lexsort((codes, -counts))]


class Profiles:
    """Rankings of languages, filed by n-gram: only the profiles that hold an n-gram are looked at."""

    def __init__(self, rankings: dict[str, np.ndarray]):
        self.names = sorted(rankings)
        code = np.concatenate([np.zeros(0, np.uint64), *[rankings[n] for n in self.names]])
        lang = np.repeat(np.arange(len(self.names)), [len(rankings[n]) for n in self.names])
        rank = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(rankings[n])) for n in self.names]])
        order = np.argsort(code, kind="stable")
        self.lang, self.rank = lang[order], rank[order]
        self.codes, self.first, self.n = np.unique(code[order], return_index=True, return_counts=True)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest profile, and how much farther the second is, as a share of its distance.

        Ties go to the first name. A text that is null or has no letter, and any text when
        nothing was learned, is ``und`` with score 0; with one language the score is 1.
        """
        own = ranked(*grams(text)) if text and self.names else ()
        if not len(own):
            return UNKNOWN, 0.0
        k = np.minimum(np.searchsorted(self.codes, own), max(0, len(self.codes) - 1))
        have = np.flatnonzero(self.codes[k] == own) if len(self.codes) else np.zeros(0, int)
        first, n = self.first[k[have]], self.n[k[have]]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        near = PROFILE - np.abs(self.rank[at] - np.repeat(have, n))
        far = PROFILE * len(own) - np.bincount(self.lang[at], near, len(self.names)).astype(np.int64)
        best = int(far.argmin())
        rest = np.delete(far, best)
        score = 1.0 if not len(rest) else float((rest.min() - far[best]) / rest.min()) if rest.min() else 0.0
        return self.names[best], score


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """A ranking for each language, from up to ``limit`` of its documents; there may be any number of languages.

    Only rows with a language and a text whose crc32(doc_id as text) mod 5 isn't 0 are
    learned from, the first by a hash; rows that repeat an id and a text count once. Each
    document counts with the shares of its PROFILE most frequent n-grams, so that a long one
    doesn't outweigh the others. Only the profiles, PROFILE numbers each, reach the driver.
    """
    small_batches(docs.sparkSession)
    fit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(False))
    rows = docs.where(fit & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text", "doc_id").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches):
            who, found, share = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                codes, counts = grams(t)
                if not len(codes):
                    continue
                best = ranked(codes, counts)
                who.append(np.full(len(best), i))
                found.append(best)
                share.append(counts[np.searchsorted(codes, best)] / counts.sum())
            if who:
                langs = b.column("lang").take(pa.array(np.concatenate(who)))
                yield pa.RecordBatch.from_arrays([langs, pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(share))], names=["lang", "gram", "share"])

    shares = class_sample(rows, "lang", "h", limit).mapInArrow(run, "lang string, gram long, share double")
    # rounded: sums of doubles differ in the last bits with the order of rows
    total = shares.groupBy("lang", "gram").agg(F.round(F.sum("share"), 9).alias("share"))
    w = Window.partitionBy("lang").orderBy(F.desc("share"), "gram")
    best, _ = materialise(total.withColumn("r", F.row_number().over(w)).where(F.col("r") <= PROFILE).select("lang", "gram", "r"), "profiles")
    out: dict[str, list] = {}
    for r in best.orderBy("lang", "r").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


def label(docs: DataFrame, rankings: dict[str, np.ndarray]) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row, from whole texts, however long; nothing is shuffled.

    Columns of these names are replaced; other columns and repeated rows stay. No rows in, no rows out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    held = spark.sparkContext.broadcast(rankings)  # PROFILE codes for each language
    made: list[Profiles] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Profiles(held.value))
        for b in rebatched(batches):
            got = [made[0].predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double"))


def predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; a null id is in no fold. Repeated rows stay."""
    out = label(docs.select("doc_id", "text"), train(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
