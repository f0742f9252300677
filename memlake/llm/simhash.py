"""SimHash near-duplicates with pivot distance tables.

Fingerprints within 3 bits agree in all but three of any blocks that the 64 bits are cut
into, so each fingerprint is filed under every choice of the other blocks, and links are
sought only among those filed alike. There, tables of Hamming distances to many reference
fingerprints discard pairs: by the triangle inequality two linked fingerprints differ by at
most 3 in every coordinate. Survivors are verified, and links are merged into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialise, rebatched, small_batches, texts
from .components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Reference fingerprints of a distance table.
PIVOTS = 16
#: Fingerprints filed alike, on average, for which more blocks are taken.
FILED = 64
#: More of them are filed again under parts of their other bits.
CROWDED = 20_000
#: Filed fingerprints of a task, about.
TASK_ROWS = 200_000
#: Up to so many filed alike are paired by shifts; more are walked from link to link.
SHIFTS = 48

_LOWER = bytes((c + 32 if 65 <= c <= 90 else c) for c in range(256))
_COUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of a text: majority bits of its shingles' XXH64, 0 without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    h = xxhash.xxh64_intdigest
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    count = np.zeros(64, np.int64)
    for i in range(0, len(spans), 1 << 15):
        part = np.array([h(joined[a:b], SEED) for a, b in spans[i : i + (1 << 15)]], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (as a signed long), ``key`` (a hash of the text) of every row; a null text counts as empty. Nothing is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches):
            fp = np.array([fingerprint(t) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), b.column("key")], names=["doc_id", "fp", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).mapInArrow(run, "doc_id long, fp long, key long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.bitwise_xor(a, b)
    return sum(_COUNT[(x >> np.uint64(s)) & np.uint64(0xFFFF)] for s in (0, 16, 32, 48))


@lru_cache(maxsize=1)
def pivots() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to the reference fingerprints."""
    return np.stack([distance(fps, p) for p in pivots()], 1).astype(np.int8)


def _near(table: np.ndarray, fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of rows link: the table discards most, the rest are verified."""
    ok = np.arange(len(a))
    for c in range(0, PIVOTS, 4):
        d = np.abs(table[a[ok], c : c + 4] - table[b[ok], c : c + 4]).max(1, initial=0)
        ok = ok[d <= BITS]
    return ok[distance(fps[a[ok]], fps[b[ok]]) <= BITS]


def _walk(table: np.ndarray, fps: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that is joined among many rows: each row is compared only with those
    not yet reached whose distance to the first reference fingerprint is close enough."""
    rest = rows[np.argsort(table[rows, 0], kind="stable")]
    out: list[tuple[int, int]] = []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            first = table[rest, 0]
            lo, hi = np.searchsorted(first, int(table[x, 0]) - BITS, "left"), np.searchsorted(first, int(table[x, 0]) + BITS, "right")
            got = _near(table, fps, np.full(hi - lo, x), rest[lo:hi])
            if len(got):
                new = rest[lo:hi][got]
                out += [(x, int(y)) for y in new]
                todo += new.tolist()
                rest = np.delete(rest, lo + got)
    return out


def links(fps: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Pairs of fingerprints (unsigned) that join all that link among those filed alike.

    ``mask``: the bits under which each row is filed.
    """
    key = fps & mask
    order = np.lexsort((fps, key, mask))
    fps, mask, key = fps[order], mask[order], key[order]
    same = (mask[1:] == mask[:-1]) & (key[1:] == key[:-1])
    run = np.concatenate([[0], np.cumsum(~same)]) if len(fps) else np.zeros(0, int)
    sizes = np.bincount(run) if len(fps) else np.zeros(0, int)
    table = pivot_table(fps)
    pairs: list[np.ndarray] = []
    small = np.flatnonzero(sizes[run] <= SHIFTS)
    for k in range(1, min(SHIFTS, int(sizes.max(initial=1)))):
        a = small[small + k < len(fps)]
        a = a[run[a] == run[a + k]]
        if not len(a):
            break
        got = a[_near(table, fps, a, a + k)]
        pairs.append(np.stack([fps[got], fps[got + k]], 1))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for r in np.flatnonzero(sizes > SHIFTS):
        found = _walk(table, fps, np.arange(starts[r], starts[r + 1]))
        if found:
            pairs.append(fps[np.array(found)])
    got = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.uint64)
    return _forest(np.unique(got[got[:, 0] != got[:, 1]], axis=0))


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Stars that join the same as these pairs."""
    nodes, at = np.unique(pairs, return_inverse=True)
    root = list(range(len(nodes)))
    for a, b in at.reshape(-1, 2).tolist():
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(len(root)):
        root[i] = root[root[i]]
    star = np.stack([nodes, nodes[root]], 1) if len(nodes) else pairs
    return star[star[:, 0] != star[:, 1]]


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` nearly equal blocks of these bits."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def masks(n: int) -> list[int]:
    """Bits to file ``n`` fingerprints under: all choices of all but 3 blocks, of so many blocks that few are filed alike."""
    blocks = BITS + 1
    while blocks < 10 and n / 2 ** (64 * (blocks - BITS) / blocks) > FILED:
        blocks += 1
    part = _parts(list(range(64)), blocks)
    return [sum(x) for x in combinations(part, blocks - BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(fps: DataFrame) -> DataFrame:
    """``u, v``: links that join all linked fingerprints. ``fps``: fp, each once."""
    n = fps.count()
    level = masks(n)
    filed = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in level])).alias("mask"))
    while True:
        # masks with 14 free bits or fewer hold no crowds any more, so this ends
        filed = filed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        crowd, _ = materialise(filed.groupBy("mask", "key").count().where(F.col("count") > CROWDED).select("mask", "key"), "crowded")
        full = [r["mask"] & ((1 << 64) - 1) for r in crowd.select("mask").distinct().collect()]  # some of the masks
        full = [m for m in full if m.bit_count() < 64 - 2 * (BITS + 1)]
        if not full:
            break
        crowd = crowd.where(F.col("mask").isin([_signed(m) for m in full]))
        # crowds are told apart by one of four blocks of their other bits: three bits can't differ in all
        finer = {m: [m | p for p in _parts([b for b in range(64) if not m >> b & 1], BITS + 1)] for m in full}
        level = sorted({*level, *(x for v in finer.values() for x in v)})
        by = F.create_map(*[y for m, v in finer.items() for y in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in v]))])
        crowded = filed.join(crowd, ["mask", "key"], "left_semi").select("fp", F.explode(by[F.col("mask")]).alias("mask"))
        filed, _ = materialise(filed.join(crowd, ["mask", "key"], "left_anti").select("fp", "mask").unionByName(crowded), "filed")
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(level) // TASK_ROWS))
    filed = filed.select("fp", "mask", F.pmod(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))), F.lit(tasks)).alias("task"))

    def run(t: pa.Table) -> pa.Table:
        got = links(t.column("fp").to_numpy().view(np.uint64), t.column("mask").to_numpy().view(np.uint64)).view(np.int64)
        return pa.table({"u": got[:, 0], "v": got[:, 1]})

    return filed.groupBy("task").applyInArrow(run, "u long, v long")


def _rooted(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, key, root, component_id`` of every document; a component has one root, ids or not."""
    own, _ = materialise(fingerprints(docs), "fingerprints")
    each, _ = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found, _ = materialise(components(linked(each.select("fp"))).withColumnRenamed("node", "fp"), "components")
    rooted = each.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = materialise(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", "fp", "key", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every document.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id that
    links reach, null only if no document of the component has an id. Null and empty texts
    have fingerprint 0, which links like any other. Repeated rows stay; other columns don't matter.
    """
    return _rooted(docs).select("doc_id", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without their near-duplicates: of each component the one with the smallest doc_id stays.

    A document without an id is a component's last choice; an id that stands on several texts is told
    apart by them. Of rows that repeat the chosen id and text one stays. Null and empty texts are
    near-duplicates of each other. All columns stay, whatever their names; no rows in, no rows out.
    """
    each = _rooted(docs).groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    first = each.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key", "n")).alias("c"))
    id_, key, times, row = free_names(docs, "_kept", "_key", "_times", "_row")
    chosen, _ = materialise(first.select(F.col("c.doc_id").alias(id_), F.col("c.key").alias(key), F.col("c.n").alias(times)), "chosen")
    # a text has one component, so an id and a text are chosen for no other
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key))
    kept = docs.join(chosen, same, "left_semi")
    if not chosen.where(F.col(times) > 1).limit(1).count():
        return kept
    w = Window.partitionBy("doc_id", key).orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)])
    return kept.withColumn(key, F.xxhash64("text")).withColumn(row, F.row_number().over(w)).where(F.col(row) == 1).drop(row, key)
