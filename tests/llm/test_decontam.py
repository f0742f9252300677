import hashlib
import random
import re

from memlake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for k in range(len(w)):
            for m in range(1, n + 1):
                if k + m <= len(w) and (g := grams.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= {str(x) for x in g if x is not None}
        s = sorted(found)
        out.append((d, len(w), len(hit), len(s), hashlib.sha256(",".join(s).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def cases():
    r = random.Random(3)
    vocab = ["the", "of", "Cat", "dog", "Straße", "a1", "x", "yy", "zed"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(1, say(14)), (2, say(10)), (10, "the CAT"), (3, None), (4, ""), (5, "!! ?"), (6, "dog-of"), (None, say(12)), (2, say(12))]
    docs = [(0, None), (1, ""), (2, "... !!!"), (3, "the"), (3, "the"), (None, "xx the cat yy")]
    for i in range(60):
        t = say(r.randrange(1, 60))
        if i % 3 == 0:
            t += " , " + (r.choice(items)[1] or "") + "\n" + say(5)
        docs.append((10 + i, t))
    docs.append((99, say(5000)))
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, key string")
    b = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, n_words int")
    return sorted(map(tuple, decontam.digests(d.repartition(3), b).collect()), key=repr)


def test_matches_brute_force(spark, monkeypatch):
    docs, items = cases()
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    monkeypatch.setattr(decontam, "ROUND_BYTES", 120)
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 100)
    monkeypatch.setattr(decontam, "CANDIDATES", 50)
    assert run(spark, docs, items) == want


def test_empty_tables(spark):
    docs, items = cases()
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "f x x x x x x a"), (3, "b a"), (4, None)], "doc_id long, text string")
    index = decontam.build(d.repartition(1))
    assert sorted((r.doc_id, r.position) for r in decontam.proximity(index, ["a", "b"], 1).collect()) == [(1, 2), (3, 1)]
    assert [r.doc_id for r in decontam.proximity(index, ["f", "a"], 5).collect()] == [1]
    assert decontam.proximity(index, ["f", "zzz"], 5).count() == 0 and decontam.proximity(index, [], 5).count() == 0


def test_one_index_serves_any_test_set(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index, _ = decontam.materialise(decontam.build(d), "postings")
    for some in (items[:3], items[6:], [(7, "straße")]):
        rows = spark.createDataFrame([(i if i is None else str(i), t if t is None else t.encode()) for i, t in some], "item string, text binary")
        got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in decontam.search(index, rows).collect()), key=repr)
        assert got == sorted((x[:4] for x in brute(docs, some)), key=repr)
