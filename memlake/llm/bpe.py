"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

A word's leaves hold ``rank * size + position`` of the pair that starts there,
so that a tree's root is the leftmost pair of lowest rank. A merge changes three
leaves and their logarithmically many ancestors. Trees of equal size are kept as
the rows of one matrix and step together.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, MutableSequence
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import rebatched, small_batches

NONE = np.iinfo(np.int64).max
#: Words in either of a Python worker's two caches, the current and the last; bounds memory, not results.
CACHE = 300_000
#: Cells of the matrices that step together.
CELLS = 1 << 21
#: So few trees, and trees of so many leaves, step one by one: a step of a matrix costs as much as many of theirs.
FEW, WIDE = 32, 1 << 13
#: Longer runs (characters) aren't kept in the caches.
KEPT = 1 << 10
#: White space for Python's str.split that isn't white space for the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def _bytes_to_chars() -> dict[int, str]:
    """The visible character that byte-level vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTree:
    """Byte-level BPE of whole words.

    ``merges``: pairs of tokens, best first. ``suffix`` marks a word's last symbol.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        chars = _bytes_to_chars()
        self.size = max(vocab.values(), default=0) + 1
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # of a repeated pair the later rank holds
        uniq, at = np.unique(keys[::-1], return_index=True)
        self.keys, self.ranks = np.append(uniq, NONE), np.append(len(keys) - 1 - at, -1)
        self.rank_of = dict(zip(uniq.tolist(), (len(keys) - 1 - at).tolist(), strict=True))
        self.merged = self.product.tolist()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each (non-empty) word, as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lens, 2))).astype(np.int64))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w >= WIDE:
                for k in rows.tolist():
                    out[k] = self._one(words[k], int(w))
                continue
            step = max(1, CELLS // int(w))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for k, ids in zip(part.tolist(), self._together([words[r] for r in part], lens[part], int(w)), strict=True):
                    out[k] = ids
        return out

    def _together(self, words: list[bytes], lens: np.ndarray, w: int) -> list[bytes]:
        n = len(words)
        raw = np.frombuffer(b"".join(x.ljust(w, b"\0") for x in words), np.uint8).reshape(n, w)
        at = np.arange(w)
        sym = self.first[raw]
        sym[np.arange(n), lens - 1] = self.last[raw[np.arange(n), lens - 1]]
        sym[at >= lens[:, None]] = -1
        nxt = np.broadcast_to(at + 1, (n, w)).copy()
        prv = np.broadcast_to(at - 1, (n, w)).copy()
        tree = np.full((n, 2 * w), NONE, np.int64)
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        ok = (rank >= 0) & (sym[:, 1:] >= 0)
        tree[:, w : 2 * w - 1] = np.where(ok, rank * w + at[:-1], NONE)
        level = w // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        live = np.arange(n)
        flat, s, nx, pv = tree.reshape(-1), sym.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        while True:
            root = tree[live, 1]
            live, root = live[root != NONE], root[root != NONE]
            if len(live) <= FEW:
                for r in live.tolist():
                    own = sym[r].tolist()
                    self._finish(tree[r].tolist(), own, nxt[r].tolist(), prv[r].tolist(), int(lens[r]), w)
                    sym[r] = own
                break
            i, base = root % w, live * w
            j = nx[base + i]
            s[base + i] = self.product[root // w]
            s[base + j] = -1
            k = nx[base + j]
            nx[base + i] = k
            has = k < lens[live]
            pv[(base + k)[has]] = i[has]
            kk = np.where(has, k, i)
            r = np.where(has, self._rank(s[base + i], s[base + kk]), -1)
            self._set(flat, w, live, j, np.full(len(live), NONE))
            self._set(flat, w, live, i, np.where(r >= 0, r * w + i, NONE))
            p = pv[base + i]
            has = p >= 0
            if has.any():
                rows, p, b = live[has], p[has], base[has]
                r = self._rank(s[b + p], s[b + i[has]])
                self._set(flat, w, rows, p, np.where(r >= 0, r * w + p, NONE))
        keep = sym >= 0
        flat_ids = sym[keep].astype("<u4").tobytes()
        ends = (4 * np.cumsum(keep.sum(1))).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _finish(self, tree: MutableSequence[int], sym: MutableSequence[int], nxt: MutableSequence[int], prv: MutableSequence[int], n: int, w: int) -> None:
        """All merges that are left in one tree: the root's pair, then three leaves and those of their
        ancestors that change."""
        none, size, rank_of, merged = NONE, self.size, self.rank_of, self.merged
        while (root := tree[1]) != none:
            i = root % w
            j = nxt[i]
            k = nxt[j]
            s = sym[i] = merged[root // w]
            sym[j] = -1
            nxt[i] = k
            p = prv[i]
            updates = [(j, none)]
            if k < n:
                prv[k] = i
                r = rank_of.get(s * size + sym[k])
                updates.append((i, none if r is None else r * w + i))
            else:
                updates.append((i, none))
            if p >= 0:
                r = rank_of.get(sym[p] * size + s)
                updates.append((p, none if r is None else r * w + p))
            for leaf, v in updates:
                node = leaf + w
                tree[node] = v
                while node > 1:
                    other = tree[node ^ 1]
                    v = v if v < other else other
                    node >>= 1
                    if tree[node] == v:
                        break
                    tree[node] = v

    def _one(self, word: bytes, w: int) -> bytes:
        """A long word alone: some 40 bytes of memory for each of its own."""
        n = len(word)
        sym = np.empty(n, np.int32)
        leaves = np.full(2 * w, NONE, np.int64)
        for i in range(0, n, 1 << 16):
            sym[i : i + (1 << 16)] = self.first[np.frombuffer(word, np.uint8)[i : i + (1 << 16)]]
        sym[-1] = self.last[word[-1]]
        for i in range(0, n - 1, 1 << 16):
            a = sym[i : i + (1 << 16) + 1].astype(np.int64)
            r = self._rank(a[:-1], a[1:])
            leaves[w + i : w + i + len(r)] = np.where(r >= 0, r * w + np.arange(i, i + len(r)), NONE)
        level = w // 2
        while level:
            np.minimum(leaves[2 * level : 4 * level : 2], leaves[2 * level + 1 : 4 * level : 2], out=leaves[level : 2 * level])
            level //= 2
        tree, own = array("q", leaves.tobytes()), array("i", sym.tobytes())
        del leaves, sym
        self._finish(tree, own, array("i", range(1, n + 1)), array("i", range(-1, n - 1)), n, w)
        ids = np.array(own)
        return ids[ids >= 0].astype("<u4").tobytes()

    @staticmethod
    def _set(flat: np.ndarray, w: int, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """Point updates of one leaf per row, and of its ancestors."""
        base, node = rows * (2 * w), leaf + w
        flat[base + node] = value
        while w > 1:
            node = node >> 1
            flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])
            w //= 2


class WordBpe:
    """A tokenizer file of the kind: NFC, one space for white space, lower case; words by a
    pattern; byte-level BPE with word ends; no decoder. Equal to the tokenizers library with
    ``add_special_tokens=False`` (added tokens are found in the raw text)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tree = PairTree(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], object)
        self.cache: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path)
        self.byte = {c: b for b, c in _bytes_to_chars().items()}

    def _words(self, part: str) -> list[bytes]:
        """Words of a run; beyond U+024F, where Unicode tables differ by version, as the library splits it."""
        if part.isascii():
            return [x.encode() for x in self.pattern.findall(part.lower())]
        if max(part) < "\u0250":
            return [x.encode() for x in self.pattern.findall(unicodedata.normalize("NFC", part).lower())]
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.byte.__getitem__, x)) for x, _ in found]

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of every run of non-space characters into the cache."""
        cache, last = self.cache, self.last
        if last:
            cache.update((p, last[p]) for p in pieces if p in last)
            pieces = [p for p in pieces if p not in cache]
        plain, plans = {}, {}
        for p in pieces:
            if p.isalpha() and (p.isascii() or (max(p) < "\u0250" and unicodedata.is_normalized("NFC", p) and "İ" not in p)):
                plain[p] = p.lower().encode()
                continue
            plan: list = []
            for k, part in enumerate(self.split.split(p) if self.split and any(t in p for t in self.added) else [p]):
                if k % 2:
                    plan.append(self.added[part])
                else:
                    plan += self._words(part)
            plans[p] = plan
        words = dict.fromkeys(plain.values())
        for plan in plans.values():
            words.update((x, None) for x in plan if type(x) is bytes)
        ids = dict(zip(words, self.tree.encode(list(words)), strict=True))
        cache.update(zip(plain, map(ids.__getitem__, plain.values()), strict=True))
        for p, plan in plans.items():
            cache[p] = b"".join([ids[x] if type(x) is bytes else x.to_bytes(4, "little") for x in plan])

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if any(c in text for c in ODD_SPACE):
            return regex.findall(r"[^\p{White_Space}]+", text)
        return text.split()

    def encode_all(self, docs: list[str]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text."""
        split = [self._pieces(t) for t in docs]
        words = list(chain.from_iterable(split))
        if len(self.cache) > CACHE:
            self.cache, self.last = {}, self.cache
        got = list(map(self.cache.get, words))
        if new := {w for w, v in zip(words, got, strict=True) if v is None}:
            self._learn(list(new))
            got = list(map(self.cache.__getitem__, words))
            for p in [p for p in new if len(p) > KEPT]:
                del self.cache[p]
        ends = list(accumulate(map(len, split)))
        return [np.frombuffer(b"".join(got[a:b]), "<u4") for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces: what the library gives for a file without a decoder."""
        return " ".join(self.names[ids].tolist())


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` to every row.

    A null text counts as empty: no ids, an empty decoded text. Whole texts are encoded, and
    words of any length: one of a million letters takes seconds, and some 40 MB. Existing
    columns of these names are replaced; others, and repeated rows, stay. Rows stay where they
    are; nothing is shuffled. No rows in, no rows out.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    schema = StructType(list(docs.schema.fields)).add("ids", "binary").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in rebatched(batches):
            got = bpe.encode_all([t or "" for t in b.column(text).to_pylist()])
            ids = pa.array([x.tobytes() for x in got], pa.binary())
            decoded = pa.array([bpe.decode(x) for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, ids, decoded], names=[*b.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    out = encode_documents(docs.select("doc_id", "text"), path)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
