import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlake.functions import scalars, vector
from memlake.functions.jsonfilter import Filter, compile_filter
from memlake.operators import knn, quant
from memlake.operators.ivf import PRESETS, IvfIndex
from memlake.plans import queries as Q
from memlake.types import InvalidInput, Metric


def frame(spark, vectors, metadata=None):
    rows = [(f"{i:04d}", [float(x) for x in v], (metadata or {}).get(i, "{}")) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id string, vector array<float>, metadata string")


def units(n, d, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def found(df):
    return [r["id"] for r in df.collect()]


def test_exact_search(spark):
    df = frame(spark, [(0.5, 0.5, 0), (0.9, 0.1, 0), (0.1, 0.9, 0), (1, 0, 0)])
    assert found(knn.search(df, [1, 0, 0], 10, "dot")) == ["0003", "0001", "0000", "0002"]
    got = knn.search(frame(spark, [(1, 0, 0), (0, 1, 0), (2, 0, 0)]), [1, 0, 0], 2, "l2").collect()
    assert [(r["id"], r["score"]) for r in got] == [("0000", 0.0), ("0002", 1.0)]
    assert found(knn.search(df, [1, 0, 0], 0)) == []
    assert found(knn.search(df.limit(0), [1, 0, 0], 3)) == []
    with pytest.raises(InvalidInput):
        knn.search(df, [1, 0, 0], -1)


def test_ties_and_odd_vectors(spark):
    df = frame(spark, [(1, 0)] * 4 + [(float("nan"), 0), (0, 0)])
    assert found(knn.search(df, [1, 0], 3)) == ["0000", "0001", "0002"]
    assert found(knn.search(df, [1, 0], 9)) == ["0000", "0001", "0002", "0003", "0005"]
    assert found(knn.search(df, [0, 0], 2)) == ["0000", "0001"]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_batch_equals_single(spark, metric, monkeypatch):
    v = units(120, 8)
    v[50] = v[10]
    df = frame(spark, v).repartition(3)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 120, 10)], "qid long, vector array<float>")
    monkeypatch.setattr(knn, "QUERY_BLOCK", 5)
    got = knn.batch_search(asked, df, 4, metric).toPandas()
    for q in (0, 10, 110):
        want = found(knn.search(df, v[q].tolist(), 4, metric))
        assert got[got.qid == q].sort_values("rank")["id"].tolist() == want
    monkeypatch.setattr(knn, "QUERY_BLOCK", 50)
    join = knn.search_join(asked, df, 4, metric).toPandas()
    key = ["qid", "rank"]
    assert got.sort_values(key)["id"].tolist() == join.sort_values(key)["id"].tolist()
    assert knn.batch_search(asked.limit(0), df, 4, metric).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_join_takes_queries_in_blocks(spark, metric, monkeypatch):
    v = units(90, 8, 2)
    df = frame(spark, v).repartition(3)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 90, 5)], "qid long, vector array<float>")
    whole = sorted(map(tuple, knn.search_join(asked, df, 4, metric).collect()))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 5)
    assert sorted(map(tuple, knn.search_join(asked, df, 4, metric).collect())) == whole and len(whole) == 72


def test_more_than_rows_asks_for_all_rows(spark, tmp_path, monkeypatch):
    sf, asked, search = embeddings(spark, tmp_path, units(30, 8)), [], knn.search
    monkeypatch.setattr(knn, "search", lambda rows, q, k, *a: asked.append(k) or search(rows, q, k, *a))
    assert Q.knn_more_than_rows(spark, sf).first()["n"] == 30 and asked == [31]


def test_filters_in_search(spark):
    df = frame(spark, units(30, 4), {i: f'{{"c": "{"abc"[i % 3]}", "p": {i % 5}}}' for i in range(30)})
    q = [1.0, 0, 0, 0]
    assert len(found(knn.search(df, q, 50, where={"c": "a"}))) == 10
    assert len(found(knn.search(df, q, 50, where={"c": {"$in": ["a", "b"]}, "p": {"$gte": 3}}))) == 8
    assert len(found(knn.search(df, q, 50, where=Filter().eq("c", "a").lt("p", 2).column()))) == 4


def accepts(spark, filters, texts, dialect="core"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, metadata string")
    rows = df.select("k", *[compile_filter(f, dialect=dialect).alias(f"f{i}") for i, f in enumerate(filters)]).orderBy("k").collect()
    return [[r["k"] for r in rows if r[f"f{i}"]] for i in range(len(filters))]


def test_filter_dialects(spark):
    texts = ['{"a": 1}', '{"a": "x"}', "{}", '{"a": null}', '{"a": {"$gt": 0, "b": 1}}', '{"a": "it\'s"}', '{"a": 18446744073709551615}']
    core = [{}, "no object", {"a": {"$in": 3}}, {"a": {"$ne": 1}}, {"a": {"$gt": "a"}}, {"a": "it's"}, {"a": 18446744073709551615}, {"a": {}}, {"a": 1, "b": 2}, {"a": {"$gte": 1, "$lte": 1}}]
    every = list(range(7))
    assert accepts(spark, core, texts) == [every, every, every, [1, 3, 4, 5, 6], [1, 5], [5], [6], [], [], [0]]
    wasm = [{"a": {"$ne": 1}}, {"a": {"$nin": [1]}}, {"a": {"$gt": "a"}}, {"a": {"$in": 3}}, {"a": {"$gt": 0, "b": 1}}]
    assert accepts(spark, wasm, texts, "wasm") == [[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6], [], [], [4]]
    assert accepts(spark, [{"a": "x"}], texts, "cli") == [[1]]
    for bad in ({"a": {"$gt": 1}}, {"a": [1]}, {"a": None}, []):
        with pytest.raises(InvalidInput):
            compile_filter(bad, dialect="cli")


def test_truth_table(spark):
    got = Q.filter_truth_table(spark, "").toPandas().set_index("k")
    assert {n: tuple(got.index[got[n]]) for n in Q.TRUTH_TRUE} == Q.TRUTH_TRUE


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>")
    r = df.select(vector.dot("a", "b"), vector.l2_squared("a", "b"), vector.norm(F.array(F.lit(3.0), F.lit(4.0))), vector.browser_score("cosine", F.col("a"), vector.literal([0, 0, 0]))).first()
    assert list(r) == [32.0, 27.0, 5.0, 0.0]
    assert Metric.parse("Euclidean") is Metric.L2
    with pytest.raises(InvalidInput):
        Metric.parse("manhattan")


def test_hashes(spark):
    import zlib

    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    for r in spark.createDataFrame([("a",), ("",), ("foobar" * 9,), ("日本é",)], "t string").select("t", scalars.fnv1a(F.col("t")).alias("h"), scalars.crc32(F.col("t")).alias("c")).collect():
        assert (r["h"], r["c"]) == (fnv(r["t"].encode()), zlib.crc32(r["t"].encode()))


def test_batch_keeps_its_best_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(knn, "SCORE_BYTES", 4000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        v = units(400, 8, 5)
        v[300:320] = v[7]  # more ties than places
        rows = [(f"{i:04d}", x.tolist()) for i, x in enumerate(v)] + [("nan", [float("nan")] * 8), ("none", None), ("part", [0.0, float("nan")] + [0.0] * 6), ("short", [1.0])]
        df = spark.createDataFrame(rows, "id string, vector array<double>").repartition(2)
        asked = spark.createDataFrame([(i, v[i].tolist()) for i in (7, 0, 300)], "qid long, vector array<double>")
        for metric in ("dot", "l2"):
            for block in (4096, 2):
                monkeypatch.setattr(knn, "QUERY_BLOCK", block)
                got = knn.batch_search(asked, df, 6, metric).toPandas()
                for q in (7, 0, 300):
                    s = ((v - v[q]) ** 2).sum(1) if metric == "l2" else -(v @ v[q])
                    want = [f"{i:04d}" for i in sorted(range(400), key=lambda i: (round(s[i], 12), i))[:6]]
                    assert got[got.qid == q].sort_values("rank")["id"].tolist() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scalars(spark):
    df = spark.createDataFrame([(59,), (60,), (3700,), (90000,)], "s long")
    assert [r[0] for r in df.select(scalars.format_ttl(F.col("s"))).collect()] == ["59s", "1m", "1h", "1d"]
    one = spark.range(1)
    assert one.select(vector.parse_vector(F.lit("1, x,2"))).first()[0] == [1.0, None, 2.0]
    assert one.select(scalars.truncate(F.lit("abcdef"), 3), scalars.short_id(F.lit("0123456789"))).first()[:] == ("abc...", "01234567")


def test_quantizers(spark):
    v = units(300, 16)
    df = frame(spark, v)
    sq = quant.ScalarQuantizer.fit(df)
    back = df.select("id", sq.dequantize(sq.quantize(vector.doubles("vector"))).alias("v")).orderBy("id").collect()
    assert np.abs(np.array([r["v"] for r in back]) - v).max() <= max(sq.scale) + 1e-6
    flat = frame(spark, [(1, 5), (3, 5)])
    assert quant.ScalarQuantizer.fit(flat).scale == pytest.approx([2 / 255, 1.0])
    q = v[0].tolist()
    adc = df.select("id", sq.asymmetric_dot(q, sq.quantize(vector.doubles("vector"))).alias("score"))
    assert adc.orderBy(F.desc("score")).first()["id"] == "0000"
    pq = quant.ProductQuantizer.train(df, parts=8, centroids=32, rounds=5)
    coded = pq.encode(df).cache()
    exact = set(found(knn.search(df, q, 20)))
    near = {r["id"] for r in coded.select("id", pq.score(q, F.col("codes")).alias("s")).orderBy(F.desc("s")).limit(20).collect()}
    assert len(exact & near) >= 10
    codes = np.array([r["codes"] for r in coded.orderBy("id").collect()])
    far = pq.table(v[0], False)[np.arange(8), codes].sum(1)
    assert np.allclose(far, np.square(pq.decode(codes) - v[0]).sum(1))
    both = coded.select(pq.score(q, F.col("codes"), False).alias("a"), pq.asymmetric_distance(q, F.col("codes"), False).alias("b")).toPandas()
    assert np.allclose(both.a, both.b)
    books = {(r["part"], r["code"]): r["book"] for r in pq.books_frame(spark).collect()}
    assert len(books) == 8 * 32
    parts = v.reshape(len(v), 8, 2)
    for j in range(8):
        b = np.array([books[j, c] for c in range(32)])
        assert (np.square(parts[:, j, None] - b[None]).sum(2).argmin(1) == codes[:, j]).all()
    assert [quant.subspaces(d) for d in (96, 64, 48, 24, 7)] == [48, 32, 48, 8, 7]
    with pytest.raises(InvalidInput):
        quant.ProductQuantizer.train(df.limit(0))


def test_recall_and_budget(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "qid int, id string")
    assert knn.recall(a, a.limit(0)).first()["recall"] == 0.0
    assert knn.recall(a.limit(0), a).first()["recall"] == 1.0
    assert knn.recall(a, a.where("qid = 1")).first()["recall"] == pytest.approx(2 / 3)
    rows = spark.createDataFrame(pd.DataFrame({"k": [1, 2, 3, 4], "cost": [5, 7, 2, 1]}))
    assert [r["k"] for r in knn.budget(rows, 8, ["k"], "cost").collect()] == [1, 3, 4]


def test_budget_over_all_rows(spark, tmp_path, monkeypatch):
    def greedy(rows, left):
        out = []
        for r in rows:
            if r[-1] is not None and r[-1] <= left:
                left -= r[-1]
                out.append(r)
        return out

    rng = np.random.default_rng(4)
    talk = [(int(i), int(j), "x" * int(rng.integers(0, 900) if i < 30 else rng.integers(0, 40))) for i in range(60) for j in range(5)]
    spark.createDataFrame(talk, "conv_id long, turn long, text string").repartition(6).write.parquet(str(tmp_path / "conversations.parquet"))
    want = greedy([(a, b, len(x)) for a, b, x in talk], 5000)
    assert any(r[0] >= 30 for r in want)
    df = Q.context_budget(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == want
    monkeypatch.setattr(knn, "BUDGET_CHUNK", 3)
    rows = sorted([(int(rng.integers(0, 20)), int(rng.integers(0, 30))) for _ in range(200)])
    df = spark.createDataFrame([*rows, (None, 7), (3, None)], "k long, cost long").repartition(5)
    for limit in (0, 40, 333, 5000):
        assert [tuple(r) for r in knn.budget(df, limit, ["k"], "cost").collect()] == greedy([(None, 7), *rows], limit)
    with pytest.raises(InvalidInput):
        knn.budget(spark.createDataFrame([(1, -1)], "k long, cost long"), 5, ["k"], "cost")


def test_inverted_lists(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = units(20, 32, 5)
    v = centres[rng.integers(0, 20, 1000)] + rng.normal(scale=0.08, size=(1000, 32))
    v = (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)
    df = frame(spark, v)
    path = str(tmp_path / "ivf")
    index = IvfIndex.build(df, path, "cosine", "high_recall")
    asked = spark.createDataFrame([(f"q{i}", v[i].tolist()) for i in range(0, 1000, 20)], "qid string, vector array<float>")
    exact = knn.batch_search(asked, df, 10)
    assert knn.recall(exact, index.batch_search(asked, 10)).first()["recall"] >= 0.9
    assert len(index) == 1000 and found(index.search(v[7].tolist(), 1)) == ["0007"]
    index.delete(spark.createDataFrame([("0007",)], "id string"))
    assert "0007" not in found(index.search(v[7].tolist(), 10)) and index.deleted_count() == 1
    # a deleted id can come back with another vector
    again = df.where("id = '0007'").withColumn("vector", F.array(*[F.lit(float(x)).cast("float") for x in -v[7]]))
    assert index.insert(again.unionByName(df.where("id < '0003'"))) == 1
    assert found(index.search((-v[7]).tolist(), 1)) == ["0007"] and len(index) == 1000
    loaded = IvfIndex.load_or_build(df.limit(1), path)
    assert found(loaded.search(v[9].tolist(), 1)) == ["0009"]
    assert PRESETS["default"].with_probes(3).probes == 3


def embeddings(spark, folder, v):
    rows = [(i, [float(y) for y in x], i % 10) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1", "random"])
def test_recall_of_the_registered_ivf_query(spark, tmp_path, size):
    # random vectors have no clusters
    sf = embeddings(spark, tmp_path, units(6000, 64, 8)) if size == "random" else f"/root/testdata/{size}"
    exact = knn.batch_search(Q._queries(spark, sf), Q.vectors(spark, sf), 10)
    assert knn.recall(exact, Q.ivf_batch_topk(spark, sf)).first()["recall"] >= 0.9


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1", "random"])
def test_recall_of_the_registered_pq_query(spark, tmp_path, monkeypatch, size):
    sf = embeddings(spark, tmp_path, units(6000, 64, 8)) if size == "random" else f"/root/testdata/{size}"
    rows = [(r["id"], np.array(r["vector"], float)) for r in Q.vectors(spark, sf).collect()]
    train, asked = quant.ProductQuantizer.train, [v.tolist() for _, v in rows[:: len(rows) // 5]]
    made = train(Q.vectors(spark, sf))
    assert made.books.shape[1] == 256
    # one training for all queries, with what the query asks for
    called = []
    monkeypatch.setattr(quant.ProductQuantizer, "train", lambda *a, **b: called.append(b) or made)
    for q in asked:
        monkeypatch.setattr(Q, "first_vector", lambda *_, q=q: q)
        exact = {i for i, _ in sorted(((i, float(v @ q)) for i, v in rows), key=lambda x: (-x[1], x[0]))[:10]}
        got = Q.pq_topk(spark, sf).collect()
        assert len(got) == 10 and len(exact & {r["id"] for r in got}) >= 9
    assert not any(called)


@pytest.mark.parametrize(("near", "scale"), [(5, 0.01), (900, 0.01), (900, 0.001)])
def test_registered_pq_query_equals_its_sql_among_near_copies(spark, tmp_path, near, scale):
    v = units(2000, 64, 9)
    # the smaller the differences, the less of them is left in the codes
    v[1:near] = v[0] + np.random.default_rng(9).normal(scale=scale, size=(near - 1, 64))
    # copies of a row among the ten, more than there is room for
    v[near : near + 12] = v[1 + np.argsort(-v[1:near] @ v[0])[min(5, near - 2)]]
    sf = embeddings(spark, tmp_path, v)
    # exact search, by the same SQL
    assert Q.SQL["pq_topk"] == Q.SQL["knn_dot"]
    assert Q.pq_topk(spark, sf).collect() == Q.QUERIES["knn_dot"](spark, sf).collect()


def test_codes_miss_no_row(spark):
    v = units(600, 16, 2)
    v[40:60] *= 1e15
    v[60:80] *= 1e-15
    v[80:90] = 0
    v[90:130] = v[7]
    v[130, 5], v[131, 0], v[132, 3] = np.nan, np.nan, np.inf
    df = frame(spark, v)
    for parts, centroids in ((8, 64), (1, 1)):
        pq = quant.ProductQuantizer.train(df.where("id < '0130'"), parts=parts, centroids=centroids, rounds=2)
        coded = pq.encode(df.repartition(5), error="error").cache()
        for q in (v[7], v[45], v[300] * 1e6, v[85]):
            for k in (1, 30, 700):
                assert pq.search(coded, q.tolist(), k).collect() == knn.search(df, q.tolist(), k, "dot").select("id", "score").collect()
    assert set(pq.encode(coded).columns) == set(coded.columns) and pq.encode(df).columns[-1] == "codes"
    assert pq.search(coded.limit(0), v[7].tolist(), 3).collect() == []
    with pytest.raises(InvalidInput):
        pq.search(coded, v[7].tolist(), 0)


def test_probes_follow_the_data(spark, tmp_path):
    v = units(3000, 32, 6)
    df = frame(spark, v)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 3000, 60)], "qid long, vector array<float>")
    config = PRESETS["high_recall"].__class__(probes=4, rounds=3, sample=1000, recall=0.95)
    for metric in ("cosine", "l2"):
        index = IvfIndex.build(df, str(tmp_path / metric), metric, config)
        assert 4 < index.config.probes <= len(index.centroids)
        assert knn.recall(knn.batch_search(asked, df, 10, metric), index.batch_search(asked, 10)).first()["recall"] >= 0.9
        assert IvfIndex.load(spark, str(tmp_path / metric)).config.probes == index.config.probes
    assert IvfIndex.build(df, str(tmp_path / "quick"), "cosine", "fast").config.probes == 4


def test_every_oracle_names_a_query():
    assert set(Q.SQL) <= set(Q.QUERIES) and len(Q.QUERIES) > 50
