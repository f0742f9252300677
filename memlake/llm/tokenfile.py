"""Token files: flat unsigned integers, 64-bit document offsets, and a base per part.

Part ``k`` of a corpus is a pair of files in a shared, mounted folder:

* ``part-k.bin``: the token ids of its documents, end to end, as little-endian unsigned
  16-bit integers (32-bit if the vocabulary is larger);
* ``part-k.idx``: a header of four 64-bit integers (magic, bytes of an id, documents,
  tokens), the documents' ids, a byte for each that tells whether its id is null, and
  ``documents + 1`` 64-bit offsets into the tokens.

Parts are in ascending order of doc_id. Their bases in the corpus are prefix sums of their
token counts. Files are memory-mapped when they are read.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path, rebatched, shared_dir, small_batches

MAGIC = 0x4D4C544F4B310A
#: Pieces in either of a worker's two caches; bounds memory, not results.
CACHE = 500_000
#: Longer pieces (characters) aren't kept in the caches.
KEPT = 1 << 10
#: Bytes of text that are encoded together, about: a piece that is in it often is looked up once.
TOGETHER = 8 << 20
#: Text of a part, about, as stored in the input's files.
PART_BYTES = 128 << 20
#: White space in Unicode, beyond that below U+0250.
WIDE_SPACE = (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: From here on Unicode tables may differ by version: runs with such characters go to the library whole.
SURE = 0x250

_WHITE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)


def _classes() -> np.ndarray:
    """The class of each code point below SURE, and one for all above."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(SURE)]
    out = [_LETTER if k == "L" else _NUMBER if k == "N" else _OTHER for k in kinds] + [_UNSURE]
    for c in (*range(9, 14), 32, 0x85, 0xA0):
        out[c] = _WHITE
    return np.array(out, np.uint8)


_CLASS = _classes()


def starts(text: str, docs: np.ndarray, added: list[str]) -> np.ndarray:
    """Where the pieces of the documents start that are encoded alike wherever they stand, in characters.

    Byte-level files of this kind split a text into letters, numbers or other marks, each with
    a space before them or not, and white space; no token crosses the ends of such pieces.
    A run (white space and the rest up to the next) stays whole if it has an apostrophe, as
    English endings are pieces of their own, an added token or a character that isn't SURE.
    ``docs``: first characters of the documents, and the end.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(code, SURE)]
    if not text.isascii():
        kind[np.isin(code, WIDE_SPACE)] = _WHITE
    first = np.zeros(len(code) + 1, bool)
    first[docs] = True
    white = kind == _WHITE
    run = first[:-1].copy()
    run[1:] |= white[1:] & ~white[:-1]
    # the last white space before anything else starts a piece; unless it is a space it is one
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:-1])
    cut = run.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) & ~white[1:] & ~white[:-1]
    cut[last] = True
    cut[last + 1] |= code[last] != 32
    whole = np.flatnonzero((kind == _UNSURE) | (code == 39))
    for t in added:
        if t in text:
            whole = np.append(whole, [m.start() for m in re.finditer(re.escape(t), text)])
    if len(whole):
        at = np.flatnonzero(run)
        k = np.unique(np.searchsorted(at, whole, "right") - 1)
        edge = np.zeros(len(code) + 1, np.int8)
        edge[at[k] + 1] += 1
        edge[np.append(at, len(code))[k + 1]] -= 1
        cut &= np.cumsum(edge[:-1], dtype=np.int8) <= 0
    return np.flatnonzero(cut)


class PieceEncoder:
    """The tokenizers library behind a cache of pieces: a text's ids are those of its pieces, end to end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        # letters, with a space before them or not, are a piece: nothing to split
        self.of_letters = Tokenizer.from_str(self.tok.to_str())
        self.of_letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        cache, last = self.cache, self.last
        if last:
            cache.update((r, last[r]) for r in pieces if r in last)
            pieces = [r for r in pieces if r not in cache]
        letters, rest = [], []
        for r in pieces:
            w = r[1:] if r[0] == " " else r
            (letters if w.isalpha() and (w.isascii() or ord(max(w)) < SURE) else rest).append(r)
        ids = [e.ids for t, x in ((self.of_letters, letters), (self.tok, rest)) for e in t.encode_batch_fast(x, add_special_tokens=False)]
        size = self.kind.itemsize
        ends = list(accumulate([size * len(x) for x in ids]))
        flat = np.fromiter(chain.from_iterable(ids), self.kind).tobytes()
        cache.update(zip([*letters, *rest], [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode_column(self, col: pa.Array) -> list[memoryview]:
        """Ids of each text (null: empty) of a string column, as bytes."""
        col = col.fill_null("")
        if not len(col):
            return []
        first = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[first[0] : first[-1]]
        docs = (first - first[0]).astype(np.int64)
        place = None if len(raw) == 0 or raw.max() < 0x80 else np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        start = starts(str(raw.data, "utf-8"), docs if place is None else np.searchsorted(place, docs), self.added)
        edges = np.append(start if place is None else place[start], len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.cache) > CACHE:
            self.cache, self.last = {}, self.cache
        got = list(map(self.cache.get, distinct))
        new = [r for r, v in zip(distinct, got, strict=True) if v is None]
        if new:
            self._learn(new)
            got = [self.cache[r] if v is None else v for r, v in zip(distinct, got, strict=True)]
            for r in new:
                if len(r) > KEPT:
                    del self.cache[r]
        taken = pa.array(got, pa.large_binary()).take(pieces.indices)
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        ids = memoryview(taken.buffers()[2] or b"") if len(taken) else memoryview(b"")
        ends = at[np.searchsorted(edges[:-1], docs)].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def gathered(batches: Iterator[pa.RecordBatch], size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes: small ones together, large ones cut."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in rebatched(batches, size):
        if held and total + b.nbytes > size:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(b)
        total += b.nbytes
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def load(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _parts(docs: DataFrame) -> int:
    """Parts of about PART_BYTES, by the optimizer's size of the input's files; by a scan where it knows none."""
    size = int(str(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return -(-size // PART_BYTES)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, parts: int | None = None) -> list[tuple[str, int, int, int]]:
    """Encode every document and write its ids and ``end_id``; (part, base, documents, tokens) of each part.

    Documents are dealt by ranges of doc_id (nulls first, repeated ids together, ties by
    text), so no part has to hold more than its range. A part's files get their names only
    when they are whole, so a lost executor or a second attempt leaves no half part behind.
    A null text counts as empty: its document is ``end_id`` alone. Only one row for each
    part reaches the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    target = local_path(folder)
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), _parts(docs))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the hash keeps one repeated id from filling a range of its own
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        os.makedirs(target, exist_ok=True)
        mark = uuid.uuid4().hex
        tmp = f"{target}/.{mark}"
        ids: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        sizes: list[int] = []
        with open(tmp + ".bin", "wb") as out:
            for b in gathered(batches):
                col = b.column("doc_id")
                ids.append(col.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(col.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                gc.disable()  # millions of short lists, and no cycles among them
                for x in enc.encode_column(b.column("text")):
                    out.write(x)
                    out.write(end)
                    sizes.append(len(x) // enc.kind.itemsize + 1)
                gc.enable()
        offsets = np.zeros(len(sizes) + 1, "<i8")
        np.cumsum(np.array(sizes, np.int64), out=offsets[1:])
        with open(tmp + ".idx", "wb") as out:
            np.array([MAGIC, enc.kind.itemsize, len(sizes), offsets[-1]], "<i8").tofile(out)
            for x in (np.concatenate([*ids, np.zeros(0, "<i8")]), np.concatenate([*nulls, np.zeros(0, np.uint8)]), offsets):
                x.tofile(out)
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}"
        for kind in (".bin", ".idx"):
            os.replace(tmp + kind, f"{target}/{name}{kind}")
        yield pa.RecordBatch.from_pydict({"part": [name], "docs": [len(sizes)], "tokens": [int(offsets[-1])]})

    got = sorted((r.part, r.docs, r.tokens) for r in rows.mapInArrow(run, "part string, docs long, tokens long").collect())
    bases = accumulate((t for _, _, t in got), initial=0)
    return [(p, base, d, t) for (p, d, t), base in zip(got, bases, strict=False) if d]


class Part:
    """A memory-mapped part."""

    def __init__(self, folder: str, name: str):
        head = np.fromfile(f"{folder}/{name}.idx", "<i8", 4)
        if len(head) < 4 or head[0] != MAGIC:
            raise ValueError(f"{folder}/{name}.idx is no token index")
        width, n, total = map(int, head[1:])
        at = 32
        self.doc_ids = np.memmap(f"{folder}/{name}.idx", "<i8", "r", at, (n,)) if n else np.zeros(0, "<i8")
        self.null = np.memmap(f"{folder}/{name}.idx", np.uint8, "r", at + 8 * n, (n,)) if n else np.zeros(0, np.uint8)
        self.offsets = np.memmap(f"{folder}/{name}.idx", "<i8", "r", at + 9 * n, (n + 1,))
        self.ids = np.memmap(f"{folder}/{name}.bin", f"<u{width}", "r", 0, (total,)) if total else np.zeros(0, f"<u{width}")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[int(self.offsets[i]) : int(self.offsets[i + 1])]


def read(spark, folder: str, parts: list[tuple[str, int, int, int]]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    source = local_path(folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                part = Part(source, row["part"])
                for i in range(0, len(part), 10_000):
                    j = min(i + 10_000, len(part))
                    off = np.asarray(part.offsets[i : j + 1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(part.doc_ids[i:j]), mask=np.asarray(part.null[i:j]).astype(bool)),
                            pa.array(off[:-1] + row["base"]),
                            pa.array(np.diff(off)),
                            pa.array([zlib.crc32(np.ascontiguousarray(part[k], "<u4")) for k in range(i, j)], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    table = spark.createDataFrame([(p, b) for p, b, _, _ in parts], "part string, base long")
    return table.repartition(min(len(parts), 2000), "part").mapInArrow(run, schema)


def roundtrip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of all documents to the shared folder and read them back."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    return read(spark, folder, write(docs, tokenizer, folder))
