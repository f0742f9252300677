import hashlib
import random
import re
from collections import Counter

from memlake.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=35):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    count = Counter(tuple(w[i : i + n]) for _, w in docs for i in range(len(w) - n + 1))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases():
    r = random.Random(9)
    say = lambda n, v=400: [f"w{r.randrange(v)}" if v > 3 else r.choice("ab") for _ in range(n)]
    passages = [say(n) for n in (20, 34, 35, 36, 50, 90, 200)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 34), (4, "b " * 35), (5, "c " * 36), (6, "d e " * 40), (None, " ".join(passages[4]))]
    for i in range(60):
        w = say(r.randrange(80))
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(10)
            w += p[a : len(p) - r.randrange(10)] + say(r.randrange(6))
        rows.append((100 + i, r.choice([" ", "\n", "  "]).join(w)))
    rows += [rows[20], rows[21], (500, rows[22][1])]
    rows.append((501, " ".join(say(3000, 2))))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, first int")
    return sorted(map(tuple, substring.digests(df.repartition(3)).collect()), key=repr)


def test_matches_brute_force(spark):
    rows = cases()
    got, want = run(spark, rows), brute(rows)
    assert got == want
    assert sum(x[2] for x in want) > 500


def test_factors_can_be_read_from_their_sources(spark):
    rows = [(i, t) for i, (_, t) in enumerate(cases())]
    words = {i: WORD.findall(t or "") for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n, far = 0, 0
    for x in substring.deduplicate(df).collect():
        gone, own = set(), words[x.doc_id]
        for f in x.factors:
            assert f.words >= 35 and (f.source, f.source_first) != (x.doc_id, f.first)
            assert own[f.first : f.first + f.words] == words[f.source][f.source_first : f.source_first + f.words]
            gone |= set(range(f.first, f.first + f.words))
            n, far = n + 1, max(far, f.words)
        assert all(a.first + a.words - 34 <= b.first for a, b in zip(x.factors, x.factors[1:]))
        assert x.kept == " ".join(w for i, w in enumerate(own) if i not in gone) and x.n_removed == len(gone)
    assert n > 50 and far >= 150  # factors go on over the ends of blocks


def test_parse():
    m = lambda first, n, source, at: {"first": first, "n": n, "source": source, "source_first": at}
    assert substring.parse([]) == []
    # one diagonal joins, the farthest wins, the window over a factor's end is looked up again
    found = [m(0, 20, 1, 100), m(20, 10, 1, 120), m(3, 5, 2, 0), m(30, 4, 3, 7), m(50, 1, None, 9)]
    assert substring.parse(found) == [(0, 64, 1, 100), (30, 38, 3, 7), (50, 35, None, 9)]


def test_hot_keys(spark, monkeypatch):
    from memlake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    test_matches_brute_force(spark)


def test_clashing_columns_and_repeated_rows(spark):
    t = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, t, 7, 8, 9, 10), (1, t, 7, 8, 9, 10), (None, "a " * 300, 1, 2, 3, 4)], "doc_id long, text string, _id int, _of int, _key int, _matches int")
    got = sorted(substring.deduplicate(df).collect(), key=lambda x: x.n_words)
    assert [(x.n_removed, x._id, x._of, x._key, x._matches) for x in got] == [(50, 7, 8, 9, 10), (50, 7, 8, 9, 10), (300, 1, 2, 3, 4)]


def test_empty(spark):
    assert run(spark, []) == []


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(50))), "x"), (2, "0 " + " ".join(map(str, range(50))), None)], "doc_id long, text string, n_words string")
    got = substring.deduplicate(df, "text").orderBy("doc_id").collect()
    assert [(x.text, x.n_words, x.n_removed) for x in got] == [("", 50, 50), ("0", 51, 50)]
