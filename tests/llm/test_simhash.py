import random
import re

import numpy as np
import xxhash

from memlake.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    fps = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    comp = list(range(len(rows)))
    while True:
        new = [min(comp[j] for j in range(len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in range(len(rows))]
        if new == comp:
            break
        comp = new
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def cases():
    r = random.Random(5)
    base = [" ".join(r.choice(["alpha", "Beta", "gamma", "Élan", "d"]) + str(r.randrange(50)) for _ in range(r.randrange(1, 120))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (None, "one"), (3, "one two"), (4, "ONE TWO"), (4, "ONE TWO")]
    for i in range(150):
        w = r.choice(base).split(" ")
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(["x", "y"])
        rows.append((200 - i, (" " if i % 2 else "\n").join(w)))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fp int")
    return sorted(map(tuple, simhash.digests(df.repartition(3)).collect()), key=repr)


def test_matches_brute_force(spark):
    rows = cases()
    assert run(spark, rows) == brute(rows)


def test_crowds_and_walks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 3)
    monkeypatch.setattr(simhash, "SHIFTS", 2)
    rows = cases()
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_links_join_all_that_link():
    r = np.random.default_rng(1)
    fps = r.integers(0, 1 << 64, 40, dtype=np.uint64)
    more = fps[r.integers(0, 40, 400)]
    for _ in range(2):
        more = more ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, more]))
    for n in (10, 10**7, 10**10):
        m = np.array(simhash.masks(n), np.uint64)
        got = simhash.links(np.repeat(fps, len(m)), np.tile(m, len(fps)))
        root = {int(x): int(x) for x in fps}
        for a, b in got.tolist():
            assert bin(a ^ b).count("1") <= 64

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in got.tolist():
            root[find(a)] = find(b)
        for i, a in enumerate(fps.tolist()):
            for b in fps.tolist()[:i]:
                if bin(a ^ b).count("1") <= 3:
                    assert find(a) == find(b)


def test_keep_one(spark):
    df = spark.createDataFrame([(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "other words entirely here"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(df).collect()) == [3, 9]


def test_keep_one_keeps_one_of_each_component(spark):
    def text(n):
        r = random.Random(n)
        return " ".join(f"w{r.randrange(10**6)}" for _ in range(60))

    a, b, c, d, e, f, g = map(text, range(7))
    rows = [
        # unrelated documents without ids, one of them repeated, one a copy of a document with an id
        (None, a, "x"), (None, b, "x"), (None, b, "y"), (1, c, "x"), (None, c, "x"), (None, None, "x"), (None, "", "x"),
        # an id on two texts, the least of both components
        (5, d, "x"), (5, e, "x"), (6, d, "x"), (6, e, "x"),
        # the least of one component only
        (8, f, "x"), (9, f, "x"), (9, g, "x"), (7, g, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted(map(tuple, simhash.keep_one(df).collect()), key=repr)
    assert len({t or "" for _, t, _ in got}) == len(got) == 8
    want = [(None, a, "x"), (None, b, "x"), (1, c, "x"), (5, d, "x"), (5, e, "x"), (8, f, "x"), (7, g, "x")]
    assert [r for r in got if r[1]] == sorted(want, key=repr)
    assert [r[0] for r in got if not r[1]] == [None]
