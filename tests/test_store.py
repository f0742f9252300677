import json

import pytest
from pyspark.sql import functions as F

from memlake.operators.ivf import AnnConfig, IvfIndex
from memlake.sources import ndjson
from memlake.sources.store import WRITE_IMMEDIATE, Database
from memlake.types import CollectionExists, CollectionNotFound, Corruption, Deserialization, DimensionMismatch, DimensionsTooLarge, InvalidDimensions, InvalidFormat, InvalidInput, TransactionConflict


class Clock:
    def __init__(self, t=1000.0):
        self.t = t

    def __call__(self):
        return self.t


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"), Clock())


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_registry(db):
    c = db.collection("a", 3, "COSINE")
    assert db.collection("a", 3) is c
    with pytest.raises(DimensionMismatch):
        db.collection("a", 4)
    with pytest.raises(CollectionExists):
        db.collection("a", 3, "euclidean")
    with pytest.raises(CollectionNotFound):
        db.get_collection("b")
    for bad in ("../x", "", "a/b"):
        with pytest.raises(InvalidInput):
            db.drop_collection(bad)
    with pytest.raises(InvalidDimensions):
        db.collection("z", 0)
    with pytest.raises(DimensionsTooLarge):
        db.collection("z", 100_000)
    db.collection("B", 2, "dot")
    assert db.collections() == ["B", "a"]
    assert db.drop_collection("a") and not db.drop_collection("a")
    assert db.collections() == ["B"]


def test_write_read_delete(db):
    c = db.collection("c", 2, "l2", WRITE_IMMEDIATE)
    c.add([1, 0], {"k": 1}, "x")
    c.add([0, 1], {"k": 2}, "日本 /é")
    assert len(c) == 2 and c.pending_count() == 0
    c.upsert("x", [2, 0], {"k": 3})
    assert json.loads(c.get("x").first()["metadata"]) == {"k": 3} and c.get("x").first()["score"] == 0.0
    assert c.get_with_vector("x").first()["vector"] == [2.0, 0.0]
    assert [(r["id"], r["score"]) for r in c.search([2, 0], 5).collect()] == [("x", 0.0), ("日本 /é", 5.0)]
    assert c.delete("x") and not c.delete("x")
    assert ids(c.rows()) == ["日本 /é"]
    assert c.search([1, 0], 0).count() == 0


def test_pending_rows_are_visible(db):
    c = db.collection("p", 2)
    c.add([1, 0], None, "a")
    c.add([0, 1], None, "b")
    assert c.pending_count() == 2 and len(c) == 2 and c.commits() == []
    c.upsert("a", [0, 1])
    assert len(c) == 2
    assert [r["id"] for r in c.search([0, 5], 2).collect()] == ["a", "b"]
    other = Database(db.spark, db.root, db.clock).get_collection("p")
    assert len(other) == 0
    assert c.delete("b") and len(c) == 1
    c.sync()
    assert len(other) == 1


def test_lifetimes_and_compaction(db):
    c = db.collection("t", 2)
    c.add_batch([[1, 0]] * 4, [None] * 4, ["a", "b", "c", "d"], [0, 3, None, 100])
    assert ids(c.rows()) == ["b", "c", "d"]
    db.clock.t += 3
    assert ids(c.rows()) == ["c", "d"]
    assert c.delete("a")  # expired, but there
    before = c.commits()[-1]
    got = c.compact()
    assert (got["expired_removed"], got["tombstones_removed"], got["bytes_freed"]) == (1, 1, 8)
    assert ids(c.rows()) == ["c", "d"] and c.snapshot().count() == 2
    assert c.snapshot(before).count() == 5
    assert c.vacuum() == 2 and ids(c.rows()) == ["c", "d"]


def test_batches_are_whole_or_nothing(db):
    c = db.collection("b", 2)
    with pytest.raises(DimensionMismatch):
        c.add_batch([[1, 0], [1, 0, 0]])
    with pytest.raises(InvalidInput):
        c.add_batch([[1, 0]], ids=["a", "b"])
    assert c.is_empty()
    assert c.add_batch([[1, 0], [0, 1]], ids=["a", "a"]) == ["a", "a"]
    assert c.get_with_vector("a").first()["vector"] == [0.0, 1.0]
    assert c.add_batch([]) == []


def test_normalised_zero_and_nan(db):
    c = db.collection("n", 2)
    c.add_batch([[3, 4], [0, 0], [float("nan"), 1]], ids=["u", "z", "n"])
    assert c.get_with_vector("u").first()["vector"] == pytest.approx([0.6, 0.8])
    assert c.get_with_vector("z").first()["vector"] == [0.0, 0.0]
    assert c.get("n").count() == 0 and len(c) == 3
    assert [r["id"] for r in c.search([1, 1], 5).collect()] == ["u", "z"]


def test_lost_writers_are_rolled_back(db, spark):
    c = db.collection("r", 2)
    c.add_sync([1, 0], None, "a")
    c.snapshot().write.parquet(f"{db.root}/r/log/seq=000000000002")
    assert len(c) == 1
    assert db.recover() == {"promoted": 0, "rolled_back": 1}
    c.add_sync([1, 0], None, "b")
    assert len(c) == 2
    assert db.validate().first()["ok"]


def test_frames(db, spark):
    c = db.collection("f", 2)
    c.upsert_frame(spark.createDataFrame([("a", [3.0, 4.0], '{"x": 1}'), ("b", [0.0, 2.0], None)], "id string, vector array<double>, metadata string"))
    assert c.get_with_vector("a").first()["vector"] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="dimensions"):
        c.upsert_frame(spark.createDataFrame([("c", [1.0])], "id string, vector array<double>"))
    db.recover()
    c.delete_frame(spark.createDataFrame([("a",)], "id string"))
    assert ids(c.rows()) == ["b"]
    s = c.stats().first()
    assert (s["count"], s["vector_storage_bytes"], s["metric"]) == (1, 8, "cosine")
    assert db.listing().first()["count"] == 1


def test_model(db):
    import random

    r, c, want = random.Random(1), db.collection("m", 2, "dot"), {}
    for step in range(4):
        new = [f"{step}_{i}" for i in range(10)]
        c.add_batch([[i, step] for i in range(10)], ids=new)
        want |= {n: [float(i), float(step)] for i, n in enumerate(new)}
        for n in r.sample(sorted(want), 2):
            c.delete(n)
            del want[n]
        n = r.choice(sorted(want))
        c.upsert(n, [9, 9])
        want[n] = [9.0, 9.0]
    assert {r["id"]: r["vector"] for r in c.rows().collect()} == want


def test_export_import(db, spark, tmp_path):
    c = db.collection("e", 2, "dot")
    c.add_batch([[1, 2], [3, 4], [5, 6]], [{"n": {"v": 1.0}, "s": "é\n"}, {}, None], ["a", "b", "gone"], [3600, None, 0])
    db.clock.t += 600
    assert ndjson.export(c, str(tmp_path / "x")) == 2
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "x" / "records")).collect()]
    assert {x["id"]: x.get("ttl") for x in lines} == {"a": 3000, "b": None}
    d = db.collection("d", 2, "l2")
    got = ndjson.import_file(d, str(tmp_path / "x"))
    assert (got["imported"], got["failed"]) == (2, 0)
    assert json.loads(d.get("a").first()["metadata"]) == {"n": {"v": 1.0}, "s": "é\n"}
    assert d.live().where("id = 'a'").first()["expires_at"] == 1600 + 3000

    def load(*rows, head=None):
        p = tmp_path / "f.ndjson"
        p.write_text("\n".join([json.dumps({"version": 1, "collection": "q", "dimensions": 2, "metric": "dot", "record_count": 1, "exported_at": 1} | (head or {})), *rows]))
        return ndjson.import_file(d, str(p))

    got = load('{"id":"k","vector":[1,0],"metadata":{"a":1}}', "", '{"id":"w","vector":[1,0,0],"metadata":{}}')
    assert (got["imported"], got["failed"]) == (1, 1)
    with pytest.raises(InvalidFormat):
        load(head={"version": 2})
    with pytest.raises(InvalidDimensions):
        load(head={"dimensions": 3})
    with pytest.raises(Deserialization):
        load("{not json")
    assert d.rows().where(F.col("id") == "k").count() == 1


def test_compacted_base_is_read_without_a_shuffle(db, spark):
    c = db.collection("k", 2, "dot")
    c.upsert_frame(spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(20)], "id string, vector array<double>"))
    c.compact()
    plan = c.search([1, 0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert ids(c.search([1, 0], 2)) == ["18", "19"]
    c.upsert("19", [0, 0])
    c.delete("18")
    c.flush()
    assert ids(c.search([1, 0], 2)) == ["16", "17"] and len(c) == 19


def test_writers_of_one_commit_dont_mix(db, spark, monkeypatch):
    one = db.collection("w", 2, "dot")
    two = Database(spark, db.root, db.clock).get_collection("w")
    create = one.files.create

    def late(name, value):
        two.add_sync([0, 1], None, "b")  # the other writer takes the number first
        create(name, value)

    monkeypatch.setattr(one.files, "create", late)
    with pytest.raises(TransactionConflict):
        one.upsert_frame(spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>"))
    monkeypatch.undo()
    assert ids(one.rows()) == ["b"] and len(one.files.names("w/log")) == 1


def test_index_follows_the_collection(db, spark):
    c = db.collection("i", 2, "dot", index=AnnConfig(cells=3, probes=3))
    put = lambda n, f: c.upsert_frame(spark.createDataFrame([(f"{i:02d}", [f(i), 1.0], '{"odd": %d}' % (i % 2)) for i in n], "id string, vector array<double>, metadata string"))
    assert c.search([1, 0], 3).count() == 0
    put(range(50), float)
    assert ids(c.search([1, 0], 2)) == ["48", "49"] and c.stats().first()["index_node_count"] == 50
    first = c.files.read("i/index/current.json")
    put(range(50, 60), float)
    put([49], lambda i: 0.0)
    c.delete("59")
    assert ids(c.search([1, 0], 2)) == ["57", "58"]
    now = c.files.read("i/index/current.json")
    assert now["folder"] == first["folder"] and now["seq"] > first["seq"] and len(c.ensure_index()) == 59
    assert ids(c.search([1, 0], 2, {"odd": 1})) == ["55", "57"]
    c.add_batch([[99, 1]], ids=["gone"], ttls=[5])
    assert ids(c.search([1, 0], 1)) == ["gone"]
    db.clock.t += 9
    assert ids(c.search([1, 0], 1)) == ["58"]  # the index still has it, the collection hasn't
    c.add([100, 1], {"odd": 1}, "staged")
    assert ids(c.search([1, 0], 2)) == ["58", "staged"] and ids(c.search([1, 0], 1, {"odd": 0})) == ["58"]
    c.flush()
    c.compact()
    assert ids(c.search([1, 0], 2)) == ["58", "staged"]
    path = f"{db.root}/i/index/{c.files.read('i/index/current.json')['folder']}"
    spark.createDataFrame([("{}", 0)], "manifest string, crc32 long").write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(Corruption):
        IvfIndex.load(spark, path)
    assert ids(c.search([1, 0], 2)) == ["58", "staged"]  # built anew
    assert c.visit(lambda parts: (p[["id"]] for p in parts), "id string").count() == len(c)
    assert c.delete_active("staged") and not c.delete_active("gone")
