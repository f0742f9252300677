import pytest
from pyspark.sql import functions as F

from memlake import cli
from memlake.apps.cache import SemanticCache
from memlake.apps.codesearch import CodeIndex
from memlake.apps.embed import CallableEmbedder, HashingEmbedder, get_embedder
from memlake.apps.memory import Memory, Tools
from memlake.apps.service import Service
from memlake.sources.store import Database
from memlake.streaming import live


class Clock:
    def __init__(self, t=1_700_000_000.0):
        self.t = t

    def __call__(self):
        return self.t


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"), Clock())


def test_embedders(spark):
    e = get_embedder(None, 64)
    assert isinstance(e, HashingEmbedder) and e.dimension == 64
    assert e.embed_single("a b") == e.embed_single("A  b") and sum(x * x for x in e.embed_single("a b")) == pytest.approx(1)
    assert get_embedder(e) is e and isinstance(get_embedder(lambda t: [[0.0]] * len(t), 1), CallableEmbedder)
    for bad, error in (("nope", ValueError), (len, ValueError), (3, TypeError)):
        with pytest.raises(error):
            get_embedder(bad)
    got = spark.createDataFrame([("a",), (None,)], "t string").select(e.column(F.col("t")).alias("v")).collect()
    assert len(got[0]["v"]) == 64 and got[1]["v"] is None


def test_memory(db):
    m = Memory(db, HashingEmbedder(64))
    m.remember("the sky is blue", "user")
    i = m.remember("the sky is grey today", "working", metadata={"source": "x"})
    got = m.recall("sky is grey today", 5, 0.2).collect()
    assert [r["tier"] for r in got] == ["working", "user"] and got[0]["metadata"] == '{"source":"x"}'
    db.clock.t += 301
    assert [r["tier"] for r in m.recall("the sky is grey", 5, 0.1).collect()] == ["user"]
    assert len(m.recall("the sky is grey", 5, 0.1, include_expired=True).collect()) == 2
    assert {r["tier"]: r["count"] for r in m.stats().collect()} == {"working": 1, "session": 0, "project": 0, "user": 1, "total": 2}
    assert m.cleanup_expired() == 1 and not m.forget_by_id(i)
    assert m.forget("the sky is blue", 0.9, dry_run=True) == 1 and m.forget("the sky is blue", 0.9) == 1
    with pytest.raises(ValueError):
        m.remember("x", "nowhere")
    tools = Tools(m)
    assert tools.call("memory_remember", {"content": "tea is hot", "tier": "project"}).startswith("Remembered")
    assert "tea is hot" in tools.call("memory_recall", {"query": "tea is hot"})
    for name, a in (("memory_recall", {"query": "x", "k": 0}), ("memory_recall", {"query": "x", "threshold": 2}), ("memory_forget", {}), ("other", {})):
        assert tools.call(name, a).startswith("Error:")
    assert "tea is hot" in m.context("tea is hot", 10)
    m.clear(["project"])
    assert m.rows(["project"]).count() == 0


def test_cache(db):
    c = SemanticCache(db, HashingEmbedder(64))
    c.set("what is spark", "an engine", duration_ms=800)
    assert c.get("What is Spark") == "an engine" and c.get("weather tomorrow") is None
    assert c.stats.hits == 1 and c.stats.saved_ms == 800
    calls = []

    @c.cached()
    def ask(text):
        calls.append(text)
        return text.upper()

    assert ask("a new question here") == ask("a new question here") == "A NEW QUESTION HERE"
    assert len(calls) == 1 and c.stats.misses == 1 and c.stats.hit_rate == pytest.approx(2 / 3)
    assert c.invalidate("what is spark") and not c.invalidate("what is spark")
    assert c.invalidate_similar("a new question here") == 1
    c.clear()
    assert c.get("what is spark") is None


def test_code_index(db, tmp_path):
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "a.py").write_text("def add(first, second):\n    return first + second\n")
    (src / "b.rs").write_text("fn main() { println!(\"hello big world\"); }\n")
    (src / "tiny.py").write_text("x")
    (src / "node_modules" / "c.js").write_text("function hidden() { return 'not indexed'; }")
    index = CodeIndex(db, embedder=HashingEmbedder(64))
    got = index.index(str(src))
    assert (got["files"], got["chunks"], got["skipped"]) == (3, 2, 1)
    best = index.search("add first second", 3).first()
    assert best["file"].endswith("a.py") and best["start_line"] == 1


def test_service(db):
    s = Service(db)
    assert s.handle("POST", "/collections", {"name": "a", "dimensions": 2})[0] == 201
    assert s.handle("POST", "/collections", {"name": "a", "dimensions": 2, "metric": "l2"})[0] == 409
    assert s.handle("PUT", "/collections/a/records/x", {"vector": [1, 0]})[0] == 200
    assert s.handle("GET", "/collections/a/records/y")[0] == 404
    assert s.handle("POST", "/collections/a/search", {"vector": [1, 0]})[1]["data"][0]["id"] == "x"
    assert s.handle("POST", "/collections/a/search", {"vector": [1]})[0] == 400
    assert s.handle("DELETE", "/collections/a/records/x")[0] == 200
    assert s.handle("GET", "/collections")[1]["data"][0]["count"] == 0
    assert s.handle("DELETE", "/collections/a")[0] == 200 and s.handle("GET", "/collections/a")[0] == 404


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "db")
    c = Database(spark, root).collection("a", 2)
    c.add_batch([[1, 0], [0, 1]], [{"k": 1}, {"k": 2}], ["x", "y"])
    run = lambda *a: (cli.run(spark, [root, *a]), capsys.readouterr().out)
    assert run("search", "a", "1,0", "--k", "1")[1].count('"x"') == 1
    assert '"y"' in run("search", "a", "1,0", "--filter", '{"k": 2}')[1]
    assert run("search", "a", "1,0", "--filter", '{"k": [2]}')[0] == 1
    assert run("get", "a", "nope")[0] == 1 and run("stats", "b")[0] == 1
    assert '"exported": 2' in run("export", "a", str(tmp_path / "x"))[1]
    assert '"imported": 2' in run("import", "b", str(tmp_path / "x"), "--dimensions", "2")[1]
    assert '"name": "b"' in run("collections")[1] and "true" in run("validate")[1]


def test_streams(spark, db, tmp_path):
    source = tmp_path / "in"
    df = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2)], "id string, vector array<float>, t int")
    df.write.parquet(str(source))
    c = db.collection("s", 2)
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(source))
    live.ingest(stream(), c, str(tmp_path / "cp")).awaitTermination(60)
    assert len(c) == 2
    df.select("id", "vector", (F.col("t") + 5).alias("t")).write.mode("append").parquet(str(source))
    q = live.latest(stream(), "id", "t", ["vector"]).writeStream.format("memory").queryName("last").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("last").count() == 2


def test_cache_keys():
    key = SemanticCache.call_key
    assert key("f", ("x", 1), {}) == "x"
    assert key("f", (5, "x"), {}) != key("f", (6, "x"), {}) == "f:(6, 'x'):{}"
    assert key("f", (), {"a": "x"}) == "f:():{'a': 'x'}" and key("f", (1, 2), {}, lambda a, b: f"{a + b}") == "3"


def test_everything_can_be_forgotten(db):
    m = Memory(db, HashingEmbedder(16))
    m.remember_frame(db.spark.createDataFrame([("same words",)] * 130, "content string"), "user")
    assert m.forget("same words", 0.9, dry_run=True) == 100 and m.forget("same words", 0.9, most=None) == 130
    c = SemanticCache(db, HashingEmbedder(16))
    v = HashingEmbedder(16).embed_single("same words")
    c.collection.upsert_frame(db.spark.createDataFrame([(str(i), v) for i in range(130)], "id string, vector array<double>"))
    assert c.invalidate_similar("same words", most=None) == 130


def test_memory_metadata_keeps_its_kinds(db):
    m = Memory(db, HashingEmbedder(16))
    m.remember("a b c", metadata={"n": 5, "x": {"y": [1, "2"]}, "s": "5", "b": True})
    import json

    assert json.loads(m.recall("a b c").first()["metadata"]) == {"n": 5, "x": {"y": [1, "2"]}, "s": "5", "b": True}


def test_tool_protocol(db):
    import io
    import json

    tools = Tools(Memory(db, HashingEmbedder(16)))
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "memory_remember", "arguments": {"content": "tea"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "memory_recall", "arguments": {"query": "tea"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "memory_recall", "arguments": {}}},
        {"jsonrpc": "2.0", "id": 6, "method": "nothing"},
    ]
    out = io.StringIO()
    tools.serve([*map(json.dumps, asked), "", "{"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, 2, 3, 4, 5, 6, None]
    assert [t["name"] for t in got[1]["result"]["tools"]] == ["memory_remember", "memory_recall", "memory_forget", "memory_stats"]
    assert "[project]" in got[3]["result"]["content"][0]["text"] and got[4]["result"]["isError"]
    assert got[5]["error"]["code"] == -32601 and got[6]["error"]["code"] == -32700


def test_http_server(db):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from memlake.apps.service import server

    web = server(db)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{web.server_address[1]}"

    def call(method, path, body=None):
        try:
            with urlopen(Request(at + path, json.dumps(body).encode() if body is not None else None, method=method)) as r:
                return r.status, json.loads(r.read())
        except HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("POST", "/collections", {"name": "a", "dimensions": 2})[0] == 201
        assert call("POST", "/collections/a/upsert", {"id": "x y", "vector": [1, 0], "metadata": {"k": 1}})[0] == 200
        assert call("POST", "/collections/a/add_batch", {"vectors": [[0, 1], [1, 1]], "ids": ["b", "c"]})[1]["data"]["ids"] == ["b", "c"]
        assert call("GET", "/collections/a/records/x%20y")[1]["data"]["vector"] == [1.0, 0.0]
        assert call("GET", "/collections/a/stats")[1]["data"]["count"] == 3
        assert [r["id"] for r in call("POST", "/collections/a/search", {"vector": [1, 0], "k": 2})[1]["data"]] == ["x y", "c"]
        assert call("GET", "/nothing")[0] == 404 and call("DELETE", "/collections/a")[0] == 200
    finally:
        web.shutdown()


def test_languages_and_skipped_folders(spark, db, tmp_path):
    from memlake.apps import codesearch

    assert codesearch.endings(["Shell", ".xyz", "nothing"]) == [".bash", ".sh", ".xyz", ".zsh"]
    assert ".md" not in codesearch.endings() and ".mjs" in codesearch.endings()
    src = tmp_path / "code"
    for name, text in {"a.mjs": "export const value = 'a long line';", "vendor/b.py": "hidden = 'in a skipped folder'", "x.egg-info/c.py": "hidden = 'in another one of them'", "d.css": "body { margin: 0; padding: 0 }", "e.zsh": "echo 'a line that is long enough'"}.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    (src / "bad.py").write_bytes(b"x = '\xff\xfe and a broken text'\n")
    index, seen = CodeIndex(db, embedder=HashingEmbedder(16)), []
    got = index.index(str(src), progress=lambda *a: seen.append(a))
    assert (got["files"], got["errors"]) == (1, 1) and [x[1:] for x in seen] == [(1, 1)]
    assert index.index(str(src), ["css", "shell"])["files"] == 2
    assert {r["language"]: r["files"] for r in index.stats().collect()} == {"javascript": 1, "css": 1, "shell": 1}


def test_shell(spark, tmp_path, capsys):
    cli.shell(spark, str(tmp_path / "db"), ["collections", "get nope x", "no-such-command", "info", "quit", "info"])
    assert capsys.readouterr().out.count('"root"') == 1
