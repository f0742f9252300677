"""The engine's queries over the test tables, each with its DuckDB oracle where SQL has one.

``query(name, sql)`` registers a function (spark, sf_dir) -> DataFrame under its name.
Vectors are compared in double precision and rounded to six places on either side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vector as V
from ..functions.jsonfilter import compile_filter
from ..operators import knn, quant

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A fixed "now" within the range of ``events.ts``: 2024-01-20T00:00:00Z.
NOW = 1705708800

Q0 = "(SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"
UNIT_Q0 = f"(SELECT list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM {Q0})"
E = "(SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def sql_l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    meta = F.to_json(F.struct(F.col("label"), F.col("vec_id").alias("n"), F.concat(F.lit("g"), (F.col("vec_id") % 3).cast("string")).alias("group")))
    return e.select(F.col("vec_id").cast("string").alias("id"), "vec_id", F.col("embedding").alias("vector"), "label", meta.alias("metadata"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in t(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def first_unit(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first vector at length 1; collections of the metric dot keep vectors as they are, so that scores agree with SQL's."""
    v = first_vector(spark, sf_dir)
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


def rounded(df: DataFrame, c: str = "score") -> DataFrame:
    return df.withColumn(c, F.round(c, 6))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").withColumn("created_at", F.unix_timestamp(F.col("ts").cast("timestamp")))


EV = "(SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events)"
EVENT_TTL = {"click": 86400, "error": 3600, "purchase": 2592000, "signup": 604800, "view": 43200}
SQL_TTL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_TTL.items()) + " END"


def event_ttl() -> Column:
    return F.create_map(*[x for k, v in EVENT_TTL.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("event_type")]


# --- exact search -----------------------------------------------------------------------------


def _knn_sql(score: str, direction: str, where: str = "true", k: int = 10, q: str = Q0, tail: str = "") -> str:
    return f"SELECT e.id, round({score}, 6) AS score FROM {E} e, {q} q WHERE {where} {tail} ORDER BY {score} {direction}, e.id LIMIT {k}"


def _knn(metric: str, where=None, k: int = 10):
    return lambda spark, sf: rounded(knn.search(vectors(spark, sf), first_vector(spark, sf), k, metric, where).select("id", "score"))


query("knn_cosine", _knn_sql(sql_dot("e.v", "q.v"), "DESC", q=UNIT_Q0))(_knn("cosine"))
query("knn_dot", _knn_sql(sql_dot("e.v", "q.v"), "DESC"))(_knn("dot"))
query("knn_l2", _knn_sql(sql_l2("e.v", "q.v"), "ASC"))(_knn("l2"))

for _name, _where, _cond in (
    ("eq", {"label": 3}, "e.label = 3"),
    ("ne", {"label": {"$ne": 3}}, "e.label <> 3"),
    ("gt", {"n": {"$gt": 100}}, "e.vec_id > 100"),
    ("gte", {"n": {"$gte": 100.0}}, "e.vec_id >= 100"),
    ("lt", {"n": {"$lt": 100}}, "e.vec_id < 100"),
    ("lte", {"n": {"$lte": 100}}, "e.vec_id <= 100"),
    ("in", {"label": {"$in": [1, 4, 7]}}, "e.label IN (1, 4, 7)"),
    ("nin", {"label": {"$nin": [1, 4, 7]}}, "e.label NOT IN (1, 4, 7)"),
    ("and", {"group": "g1", "n": {"$gte": 50, "$lt": 400}, "label": {"$ne": 2}}, "e.vec_id % 3 = 1 AND e.vec_id >= 50 AND e.vec_id < 400 AND e.label <> 2"),
    ("empty", {}, "true"),
):
    query(f"knn_filtered_{_name}", _knn_sql(sql_dot("e.v", "q.v"), "DESC", _cond, q=UNIT_Q0))(_knn("cosine", _where))

SQL_UNIT = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
_BATCH = f"""
SELECT qid, id, round(s, 6) AS score, rank FROM (
  SELECT q.vec_id AS qid, e.id, {{score}} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {{score}} {{way}}, e.id) AS rank
  FROM (SELECT vec_id, {{unit}} AS v FROM {E} WHERE vec_id % 25 = 0) q, {E} e)
WHERE rank <= 10
"""


def _queries(spark, sf):
    return vectors(spark, sf).where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), "vector")


@query("knn_batch_topk", _BATCH.format(score=sql_dot("q.v", "e.v"), way="DESC", unit=SQL_UNIT))
def knn_batch_topk(spark, sf):
    return rounded(knn.batch_search(_queries(spark, sf), vectors(spark, sf), 10))


@query("knn_batch_l2", _BATCH.format(score=sql_l2("q.v", "e.v"), way="ASC", unit="v"))
def knn_batch_l2(spark, sf):
    return rounded(knn.batch_search(_queries(spark, sf), vectors(spark, sf), 10, "l2"))


@query("knn_batch_join", _BATCH.format(score=sql_dot("q.v", "e.v"), way="DESC", unit=SQL_UNIT))
def knn_batch_join(spark, sf):
    return rounded(knn.search_join(_queries(spark, sf), vectors(spark, sf), 10))


@query("knn_threshold", f"SELECT * FROM ({_knn_sql(sql_dot('e.v', 'q.v'), 'DESC', q=UNIT_Q0, k=100)}) WHERE score >= 0.2")
def knn_threshold(spark, sf):
    found = knn.search(vectors(spark, sf), first_vector(spark, sf), 100).select("id", "score")
    return rounded(found).where("score >= 0.2")


@query("knn_browser_l2", f"SELECT e.id, round(-sqrt({sql_l2('e.v', 'q.v')}), 6) + 0.0 AS score FROM {E} e, {Q0} q ORDER BY -sqrt({sql_l2('e.v', 'q.v')}) DESC, e.id LIMIT 10")
def knn_browser_l2(spark, sf):
    return rounded(knn.search(vectors(spark, sf), first_vector(spark, sf), 10, "l2", dialect="wasm").select("id", "score")).withColumn("score", F.col("score") + 0.0)


@query("knn_more_than_rows", f"SELECT count(*) AS n FROM {E}")
def knn_more_than_rows(spark, sf):
    rows = vectors(spark, sf)
    return knn.search(rows, first_vector(spark, sf), rows.count() + 1).agg(F.count("*").alias("n"))


@query("pending_merge_topk", _knn_sql(sql_dot("e.v", "q.v"), "DESC", q=UNIT_Q0))
def pending_merge_topk(spark, sf):
    """A tenth of the rows is staged, the others are committed; a search sees both."""
    c = database(spark).collection("c", 64, "dot", (1 << 30, 0.0))
    rows = vectors(spark, sf)
    c.upsert_frame(rows.where("vec_id % 10 <> 0"))
    for r in rows.where("vec_id % 10 = 0").select("id", "vector", "metadata").toLocalIterator():
        c.add(r["vector"], r["metadata"], r["id"])
    return rounded(c.search(first_unit(spark, sf), 10).select("id", "score"))


# --- vector arithmetic ------------------------------------------------------------------------


@query("l2_norm", f"SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM {E}")
def l2_norm(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(V.norm(V.doubles("vector")), 6).alias("norm"))


@query("normalize", f"SELECT vec_id, round(list_sum(list_transform({SQL_UNIT}, lambda x: x * 3)), 6) AS s, round(({SQL_UNIT})[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x * 7) AS v FROM {E})")
def normalize(spark, sf):
    u = V.normalize(F.transform(V.doubles("vector"), lambda x: x * 7))
    return vectors(spark, sf).select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * 3), 6).alias("s"), F.round(u[0], 6).alias("first"))


@query("normalize_zero_vector", "SELECT * FROM (VALUES (1, 0.0, 0.0), (2, 0.6, 0.8), (3, 0.0, 0.0)) AS t(k, x, y)".replace("0.6, 0.8", "CAST(0.6 AS DOUBLE), CAST(0.8 AS DOUBLE)").replace("(1, 0.0, 0.0)", "(1, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE))").replace("(3, 0.0, 0.0)", "(3, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE))"))
def normalize_zero_vector(spark, sf):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1e-9, 0.0])], "k int, v array<double>")
    u = V.normalize(F.col("v"))
    return df.select("k", F.round(u[0], 6).alias("x"), F.round(u[1], 6).alias("y"))


@query("is_normalized", f"SELECT vec_id, abs(sqrt(list_sum(list_transform(v, lambda x: x * x))) - 1) < 0.001 AS unit, abs(2 * sqrt(list_sum(list_transform(v, lambda x: x * x))) - 1) < 0.001 AS twice FROM {E}")
def is_normalized(spark, sf):
    v = V.doubles("vector")
    return vectors(spark, sf).select("vec_id", V.is_normalized(v, 1e-3).alias("unit"), V.is_normalized(F.transform(v, lambda x: x * 2), 1e-3).alias("twice"))


@query("parse_query_vector", "SELECT CAST(i AS BIGINT) AS i, x FROM (VALUES (0, CAST(0.5 AS FLOAT)), (1, CAST(-1 AS FLOAT)), (2, CAST(2 AS FLOAT))) AS t(i, x)")
def parse_query_vector(spark, sf):
    df = spark.createDataFrame([("0.5, -1 ,2e0",)], "q string")
    return df.select(F.posexplode(V.parse_vector(F.col("q"))).alias("i", "x")).select(F.col("i").cast("long").alias("i"), "x")


# --- filters ----------------------------------------------------------------------------------


@query("json_filter_range", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 10 AND CAST(json_extract(props, '$.k') AS DOUBLE) < 30")
def json_filter_range(spark, sf):
    return t(spark, sf, "events").where(compile_filter({"k": {"$gte": 10, "$lt": 30}}, "props")).select("event_id")


TRUTH = [
    (1, '{"a": 42}'), (2, '{"a": 42.0}'), (3, '{"a": "42"}'), (4, '{"a": true}'), (5, '{"a": null}'), (6, "{}"),
    (7, '{"a": [1, 2]}'), (8, '{"a": {"b": 1}}'), (9, '{"a": "zebra"}'), (10, '{"a": -5}'), (11, "not json"), (12, None), (13, '{"a.b": 42}'),
]
TRUTH_FILTERS = {
    "eq_int": {"a": 42}, "eq_float": {"a": 42.0}, "eq_text": {"a": "42"}, "eq_bool": {"a": True}, "eq_null": {"a": None},
    "ne_int": {"a": {"$ne": 42}}, "gt": {"a": {"$gt": 10}}, "lt_text": {"a": {"$lt": "5"}}, "in_": {"a": {"$in": [42, "zebra"]}},
    "nin": {"a": {"$nin": [42, "zebra"]}}, "in_empty": {"a": {"$in": []}}, "nested": {"a": {"b": 1}}, "dotted": {"a.b": 42}, "unknown": {"a": {"$foo": 1}},
}
# what each filter accepts of the rows above
TRUTH_TRUE = {
    "eq_int": (1,), "eq_float": (2,), "eq_text": (3,), "eq_bool": (4,), "eq_null": (5,), "ne_int": (2, 3, 4, 5, 7, 8, 9, 10), "gt": (1, 2),
    "lt_text": (3,), "in_": (1, 9), "nin": (2, 3, 4, 5, 7, 8, 10), "in_empty": (), "nested": (8,), "dotted": (13,), "unknown": tuple(range(1, 14)),
}


@query("filter_truth_table", "SELECT k" + "".join(f", k IN ({', '.join(map(str, x)) or '-1'}) AS {n}" for n, x in TRUTH_TRUE.items()) + " FROM (SELECT CAST(unnest(range(1, 14)) AS INTEGER) AS k)")
def filter_truth_table(spark, sf):
    df = spark.createDataFrame(TRUTH, "k int, metadata string")
    return df.select("k", *[compile_filter(f).alias(n) for n, f in TRUTH_FILTERS.items()])


# --- mutation and visibility ------------------------------------------------------------------


@query("upsert_lww", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_lww(spark, sf):
    from ..streaming import live

    return live.latest(t(spark, sf, "events"), "user_id", "ts", ["event_id", "event_type"])


def event_log(spark, sf):
    """A collection of all events with their lifetimes, as of NOW."""
    c = database(spark).collection("events", 2, "dot")
    left = F.col("created_at") + event_ttl() - F.lit(NOW)
    c.upsert_frame(events(spark, sf).select(F.col("event_id").cast("string").alias("id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"), left.alias("ttl")))
    return c


@query("delete_antijoin", f"SELECT CAST(event_id AS VARCHAR) AS id FROM {EV} WHERE NOT (event_type = 'error' AND event_id % 40 = 0) AND {NOW} < created_at + {SQL_TTL}")
def delete_antijoin(spark, sf):
    c = event_log(spark, sf)
    c.delete_frame(t(spark, sf, "events").where("event_type = 'error' AND event_id % 40 = 0").select(F.col("event_id").alias("id")))
    return c.rows().select("id")


@query("ttl_active", f"SELECT event_id FROM {EV} WHERE {NOW} < created_at + {SQL_TTL}")
def ttl_active(spark, sf):
    return events(spark, sf).where(S.active(S.expires_at(F.col("created_at"), event_ttl()), F.lit(NOW))).select("event_id")


@query("ttl_remaining", f"SELECT event_id, greatest(0, created_at + {SQL_TTL} - {NOW}) AS remaining FROM {EV}")
def ttl_remaining(spark, sf):
    return events(spark, sf).select("event_id", S.ttl_remaining(S.expires_at(F.col("created_at"), event_ttl()), F.lit(NOW).cast("long")).alias("remaining"))


def tiers_of(spark, sf, expires_at: Column):
    """A memory with a tier for each remainder of the events' ids."""
    from ..apps.embed import CallableEmbedder
    from ..apps.memory import Memory

    m = Memory(database(spark), CallableEmbedder(lambda x: [[1.0, 0.0]] * len(x), 2))
    e = events(spark, sf)
    for k, tier in enumerate(S.TIER_TTL):
        meta = F.to_json(F.struct(F.col("event_type").alias("content"), F.lit(tier).alias("tier"), F.col("created_at"), expires_at.alias("expires_at")))
        m.tiers[tier].upsert_frame(e.where(F.col("event_id") % 4 == k).select(F.col("event_id").cast("string").alias("id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"), meta.alias("metadata")))
    return m


SQL_TIER = "['working','session','project','user'][event_id % 4 + 1]"


@query("cleanup_expired", f"SELECT tier, count(*) FILTER (WHERE {NOW} > created_at + {SQL_TTL}) AS removed, count(*) FILTER (WHERE NOT {NOW} > created_at + {SQL_TTL}) AS n FROM (SELECT *, {SQL_TIER} AS tier FROM {EV}) GROUP BY 1")
def cleanup_expired(spark, sf):
    m = tiers_of(spark, sf, F.col("created_at") + event_ttl())
    removed = spark.createDataFrame([(x, m.cleanup_expired([x])) for x in S.TIER_TTL], "tier string, removed long")
    return removed.join(m.stats(), "tier").select("tier", "removed", F.col("count").alias("n"))


@query("compact_stats", f"SELECT count(*) FILTER (WHERE NOT d AND {NOW} >= created_at + {SQL_TTL}) AS expired_removed, count(*) FILTER (WHERE d) AS tombstones_removed, 8 * count(*) FILTER (WHERE NOT d AND {NOW} >= created_at + {SQL_TTL}) AS bytes_freed, count(*) FILTER (WHERE NOT d AND {NOW} < created_at + {SQL_TTL}) AS n FROM (SELECT *, event_id % 9 = 0 AS d FROM {EV})")
def compact_stats(spark, sf):
    c = event_log(spark, sf)
    c.delete_frame(t(spark, sf, "events").where("event_id % 9 = 0").select(F.col("event_id").alias("id")))
    done = c.compact()
    return spark.createDataFrame([(done["expired_removed"], done["tombstones_removed"], done["bytes_freed"], len(c))], "expired_removed long, tombstones_removed long, bytes_freed long, n long")


@query("collection_stats", "SELECT 'c' AS name, count(*) AS count, CAST(64 AS INTEGER) AS dimensions, 'dot' AS metric, CAST(sum(len(embedding) * 4) AS BIGINT) AS vector_storage_bytes, CAST(0 AS INTEGER) AS pending_writes FROM embeddings")
def collection_stats(spark, sf):
    c = database(spark).collection("c", 64, "dot")
    c.upsert_frame(vectors(spark, sf))
    return c.stats().select("name", "count", "dimensions", "metric", "vector_storage_bytes", "pending_writes")


@query("list_collections", "SELECT 'label_' || label AS name, count(*) AS count, CAST(64 AS INTEGER) AS dimensions, 'l2' AS metric FROM embeddings GROUP BY label")
def list_collections(spark, sf):
    db, rows = database(spark), vectors(spark, sf)
    for r in rows.select("label").distinct().collect():  # a row for each collection
        db.collection(f"label_{r['label']}", 64, "l2").upsert_frame(rows.where(F.col("label") == r["label"]))
    return db.listing()


@query("tier_stats", f"SELECT coalesce(tier, 'total') AS tier, count(*) AS count FROM (SELECT {SQL_TIER} AS tier FROM events) GROUP BY ROLLUP (tier)")
def tier_stats(spark, sf):
    return tiers_of(spark, sf, F.lit(NOW)).stats()


@query("point_get", f"SELECT id, CAST(0 AS DOUBLE) AS score, label FROM {E} WHERE id = '42'")
def point_get(spark, sf):
    c = database(spark).collection("c", 64, "dot")
    c.upsert_frame(vectors(spark, sf))
    return c.get("42").select("id", "score", F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@query("get_with_vector", f"SELECT id, i, round(x, 6) AS x FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM {E} WHERE id = '42')")
def get_with_vector(spark, sf):
    c = database(spark).collection("c", 64, "dot")
    c.upsert_frame(vectors(spark, sf))
    return c.get_with_vector("42").select("id", F.posexplode(V.doubles("vector")).alias("i", "x")).select("id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


# --- quantisation -----------------------------------------------------------------------------

FIT = f"""f AS (SELECT i, low, high, CASE WHEN high - low < 1.1920929e-07 THEN 1.0 ELSE (high - low) / 255 END AS scale FROM (
  SELECT i, min(x) AS low, max(x) AS high FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM {E}) GROUP BY i)),
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM {E}),
c AS (SELECT vec_id, u.i, x, low, scale, CAST(floor(greatest(0.0, least(255.0, (x - low) * (1.0 / scale)))) AS INTEGER) AS code FROM u JOIN f USING (i))"""


@query("sq8_fit", f"WITH {FIT} SELECT i, round(low, 6) AS low, round(high, 6) AS high, round(scale, 9) AS scale FROM f")
def sq8_fit(spark, sf):
    return quant.fit_scalar(vectors(spark, sf)).select(F.col("i").cast("long").alias("i"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("scale", 9).alias("scale"))


@query("sq8_codes", f"WITH {FIT} SELECT vec_id, i, code FROM c")
def sq8_codes(spark, sf):
    rows = vectors(spark, sf)
    codes = quant.ScalarQuantizer.fit(rows).quantize(V.doubles("vector"))
    return rows.select("vec_id", F.posexplode(codes).alias("i", "code")).select("vec_id", F.col("i").cast("long").alias("i"), "code")


@query("sq8_dequant_error", f"WITH {FIT} SELECT vec_id, round(max(abs(x - (code * scale + low))), 6) AS error FROM c GROUP BY vec_id")
def sq8_dequant_error(spark, sf):
    rows = vectors(spark, sf)
    q = quant.ScalarQuantizer.fit(rows)
    back = q.dequantize(q.quantize(V.doubles("vector")))
    return rows.select("vec_id", F.round(F.array_max(F.zip_with(V.doubles("vector"), back, lambda a, b: F.abs(a - b))), 6).alias("error"))


@query("sq8_adc_topk", f"WITH {FIT}, q AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM {Q0}), s AS (SELECT c.vec_id, sum(q.x * (c.code * c.scale + c.low)) AS s FROM c JOIN q USING (i) GROUP BY 1) SELECT vec_id, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 10")
def sq8_adc_topk(spark, sf):
    rows = vectors(spark, sf)
    q = quant.ScalarQuantizer.fit(rows)
    scored = rows.select("vec_id", q.asymmetric_dot(first_vector(spark, sf), q.quantize(V.doubles("vector"))).alias("score"))
    return rounded(scored.orderBy(F.desc("score"), "vec_id").limit(10))


@query("sq8_int_dot", f"WITH {FIT}, z AS (SELECT i, code FROM c WHERE vec_id = 0) SELECT c.vec_id, sum(c.code * z.code)::BIGINT AS dot, sum((c.code - z.code) * (c.code - z.code))::BIGINT AS l2 FROM c JOIN z USING (i) GROUP BY 1")
def sq8_int_dot(spark, sf):
    rows = vectors(spark, sf)
    coded = rows.select("vec_id", quant.ScalarQuantizer.fit(rows).quantize(V.doubles("vector")).alias("c"))
    z = F.broadcast(coded.where("vec_id = 0").select(F.col("c").alias("z")))  # one row
    return coded.crossJoin(z).select("vec_id", quant.integer_dot(F.col("c"), F.col("z")).alias("dot"), quant.integer_l2(F.col("c"), F.col("z")).alias("l2"))


@query("i8_codes", f"SELECT vec_id, i, CAST(trunc(greatest(-127.0, least(127.0, x * 127))) AS INTEGER) AS code FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM {E})")
def i8_codes(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(quant.signed_codes(V.doubles("vector"))).alias("i", "code")).select("vec_id", F.col("i").cast("long").alias("i"), "code")


@query("i8_topk", f"WITH k AS (SELECT vec_id, list_transform(v, lambda x: CAST(trunc(greatest(-127.0, least(127.0, x * 127))) AS BIGINT)) AS c FROM {E}) SELECT k.vec_id, CAST({sql_dot('k.c', 'z.c')} AS BIGINT) AS score FROM k, (SELECT c FROM k WHERE vec_id = 0) z ORDER BY 2 DESC, 1 LIMIT 10")
def i8_topk(spark, sf):
    coded = vectors(spark, sf).select("vec_id", quant.signed_codes(V.doubles("vector")).alias("c"))
    z = F.broadcast(coded.where("vec_id = 0").select(F.col("c").alias("z")))  # one row
    return coded.crossJoin(z).select("vec_id", quant.integer_dot(F.col("c"), F.col("z")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


_SQ8_RECALL = f"""
WITH {FIT}, d AS (SELECT vec_id, list(code * scale + low ORDER BY i) AS v FROM c GROUP BY 1),
q AS (SELECT vec_id AS qid, v FROM {E} WHERE vec_id % 50 = 0),
x AS (SELECT qid, vec_id FROM (SELECT qid, e.vec_id, row_number() OVER (PARTITION BY qid ORDER BY {sql_dot('q.v', 'e.v')} DESC, e.vec_id) AS r FROM q, {E} e) WHERE r <= 10),
a AS (SELECT qid, vec_id FROM (SELECT qid, d.vec_id, row_number() OVER (PARTITION BY qid ORDER BY {sql_dot('q.v', 'd.v')} DESC, d.vec_id) AS r FROM q, d) WHERE r <= 10)
SELECT round(count(a.vec_id) / count(*)::DOUBLE, 6) AS recall FROM x LEFT JOIN a USING (qid, vec_id)
"""


@query("recall_metric", _SQ8_RECALL)
def recall_metric(spark, sf):
    rows = vectors(spark, sf)
    q = quant.ScalarQuantizer.fit(rows)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "vector")
    whole = rows.select(F.col("vec_id").alias("id"), "vector")
    coded = rows.select(F.col("vec_id").alias("id"), q.dequantize(q.quantize(V.doubles("vector"))).alias("vector"))
    return rounded(knn.recall(knn.search_join(asked, whole, 10, "dot"), knn.search_join(asked, coded, 10, "dot")), "recall")


@query("pq_topk", _knn_sql(sql_dot("e.v", "q.v"), "DESC"))
def pq_topk(spark, sf):
    rows, q = vectors(spark, sf), first_vector(spark, sf)
    pq = quant.ProductQuantizer.train(rows)
    # codes rule rows out, vectors rank the others
    return rounded(pq.search(pq.encode(rows.where(V.searchable(F.col("vector"))).select("id", "vector"), error="error"), q, 10))


# --- applications -----------------------------------------------------------------------------

_TIERS = list(S.TIER_TTL)
_TIERED = f"""
WITH m AS (SELECT e.id, ['working','session','project','user'][label % 4 + 1] AS tier, label % 4 AS o, {NOW} + vec_id % 7 - 3 AS expires_at, {sql_dot('e.v', 'q.v')} AS s FROM {E} e, {UNIT_Q0} q),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY s DESC, id) AS k FROM m)
SELECT tier, id, round(s, 6) AS score FROM r WHERE k <= 5 AND s >= 0.1 AND NOT {NOW} > expires_at ORDER BY s DESC, o, id LIMIT 5
"""


@query("tiered_recall", _TIERED)
def tiered_recall(spark, sf):
    tiers = F.array(*[F.lit(x) for x in _TIERS])
    rows = vectors(spark, sf).select("id", "vector", F.get(tiers, F.col("label") % 4).alias("tier"), (F.lit(NOW) + F.col("vec_id") % 7 - 3).alias("expires_at"))
    return rounded(knn.tiered_search(rows, first_vector(spark, sf), 5, 0.1, _TIERS, NOW).select("tier", "id", "score"))


@query("cache_key", "SELECT doc_id, substr(sha256(text), 1, 16) AS key FROM documents")
def cache_key(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.cache_key(F.col("text")).alias("key"))


@query("cache_lookup", f"SELECT id AS response FROM ({_knn_sql(sql_dot('e.v', 'q.v'), 'DESC', where='e.vec_id <> 0', k=1, q=UNIT_Q0)}) WHERE score >= 0.3")
def cache_lookup(spark, sf):
    from ..apps.cache import SemanticCache
    from ..apps.embed import CallableEmbedder

    asked = first_vector(spark, sf)
    cache = SemanticCache(database(spark), CallableEmbedder(lambda x: [asked] * len(x), 64), threshold=0.3)
    meta = F.to_json(F.struct(F.col("id").alias("query"), F.col("id").alias("response"), F.lit(1.0).alias("duration_ms")))
    cache.collection.upsert_frame(vectors(spark, sf).where("vec_id <> 0").withColumn("metadata", meta))
    got = cache.get("the first vector")
    return spark.createDataFrame([(got,)] if got is not None else [], "response string")


@query("cache_stats", "SELECT count(*) AS total_queries, round(avg(CASE WHEN event_type IN ('view', 'click') THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(sum(CASE WHEN event_type IN ('view', 'click') THEN value ELSE 0 END), 2) AS saved_ms FROM events")
def cache_stats(spark, sf):
    from ..apps.cache import statistics

    got = statistics(t(spark, sf, "events"), F.col("event_type").isin("view", "click"), "value")
    return got.select("total_queries", F.round("hit_rate", 6).alias("hit_rate"), F.round("saved_ms", 2).alias("saved_ms"))


_CHUNKS = """
SELECT doc_id, start_line, content FROM (
  SELECT doc_id, s + 1 AS start_line, array_to_string(l[s + 1 : s + 5], chr(10)) AS content FROM (
    SELECT doc_id, l, unnest(range(0, len(l), 4)) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
WHERE length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) > 20
"""


def chunked(spark, sf):
    from ..apps.codesearch import chunk_lines

    return chunk_lines(t(spark, sf, "documents").select("doc_id", "text"), "text", size=5, overlap=1)


@query("code_chunks", _CHUNKS)
def code_chunks(spark, sf):
    return chunked(spark, sf).select("doc_id", "start_line", "content")


@query("chunk_search_dedupe", f"SELECT doc_id, line, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) AS r FROM (SELECT doc_id, start_line AS line, length(content) AS score FROM ({_CHUNKS}))) WHERE r = 1")
def chunk_search_dedupe(spark, sf):
    from ..apps.codesearch import best_of

    scored = chunked(spark, sf).select("doc_id", F.col("start_line").alias("line"), F.length("content").cast("long").alias("score"))
    return best_of(scored, ["doc_id"], "score", "line")


_BUDGET = """
WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS cost, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations),
w AS (SELECT 0::BIGINT AS n, 5000::BIGINT AS rest, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, NULL::BIGINT AS cost, false AS taken
  UNION ALL SELECT o.n, CASE WHEN o.cost <= w.rest THEN w.rest - o.cost ELSE w.rest END, o.conv_id, o.turn, o.cost, o.cost <= w.rest FROM w JOIN o ON o.n = w.n + 1)
SELECT conv_id, turn, cost FROM w WHERE taken
"""


@query("context_budget", _BUDGET)
def context_budget(spark, sf):
    rows = t(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("cost"))
    return knn.budget(rows, 5000, ["conv_id", "turn"], "cost")


@query("format_ttl", f"SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS ttl FROM (SELECT event_id, greatest(0, created_at + {SQL_TTL} - {NOW}) AS s FROM {EV})")
def format_ttl(spark, sf):
    left = S.ttl_remaining(S.expires_at(F.col("created_at"), event_ttl()), F.lit(NOW).cast("long"))
    return events(spark, sf).select("event_id", S.format_ttl(left).alias("ttl"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short FROM documents")
def truncate_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.truncate(F.col("text"), 80).alias("short"))


@query("score_format", f"SELECT e.id, printf('%.3f', {sql_dot('e.v', 'q.v')}) AS shown, CASE WHEN {sql_dot('e.v', 'q.v')} >= 0.7 THEN 'high' WHEN {sql_dot('e.v', 'q.v')} >= 0.5 THEN 'medium' ELSE 'low' END AS bucket FROM {E} e, {Q0} q")
def score_format(spark, sf):
    s = V.dot(V.doubles("vector"), V.literal(first_vector(spark, sf)))
    return vectors(spark, sf).select("id", S.format_score(s).alias("shown"), S.score_bucket(s).alias("bucket"))


@query("tier_default_ttl", "SELECT event_id, CASE ['working','session','project','user'][event_id % 4 + 1] WHEN 'working' THEN 300 WHEN 'session' THEN 3600 WHEN 'project' THEN 2592000 ELSE 31536000 END::BIGINT AS ttl FROM events")
def tier_default_ttl(spark, sf):
    tiers = F.array(*[F.lit(x) for x in _TIERS])
    return t(spark, sf, "events").select("event_id", S.tier_ttl(F.get(tiers, (F.col("event_id") % 4).cast("int"))).alias("ttl"))


@query("latency_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def latency_stats(spark, sf):
    from ..apps.cache import latencies

    return rounded(latencies(t(spark, sf, "events"), "event_type", "value"), "mean")


@query("code_language", "SELECT doc_id, ['python', 'javascript', 'shell', 'cpp', 'kotlin', 'html', 'css', 'yaml', NULL, NULL][doc_id % 10 + 1] AS language FROM documents")
def code_language(spark, sf):
    from ..apps.codesearch import language

    ends = F.array(*[F.lit(x) for x in (".py", ".MJS", ".zsh", ".cxx", ".kts", ".htm", ".sass", ".yml", ".none", "")])
    path = F.concat(F.lit("/a.b/f"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % 10).cast("int")))
    return t(spark, sf, "documents").select("doc_id", language(path).alias("language"))


# --- stores and indexes -----------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root or tempfile.gettempdir() + '/memlake'}/{uuid.uuid4().hex}"


def database(spark: SparkSession):
    """A new database whose clock stands at NOW."""
    from ..sources.store import Database

    return Database(spark, scratch(spark), lambda: NOW)


@query("ivf_batch_topk")
def ivf_batch_topk(spark, sf):
    from ..operators.ivf import IvfIndex

    index = IvfIndex.build(vectors(spark, sf), scratch(spark), "cosine", "high_recall")
    return rounded(index.batch_search(_queries(spark, sf), 10))


@query("ivf_all_cells", _BATCH.format(score=sql_dot("q.v", "e.v"), way="DESC", unit=SQL_UNIT))
def ivf_all_cells(spark, sf):
    """With all of its cells probed an index is exact."""
    from ..operators.ivf import AnnConfig, IvfIndex

    rows = vectors(spark, sf)
    index = IvfIndex.build(rows.where("vec_id % 3 <> 0"), scratch(spark), "cosine", AnnConfig(cells=12, probes=12))
    index.insert(rows)
    return rounded(index.batch_search(_queries(spark, sf), 10))


_CHANGED = f"(SELECT id, CASE WHEN vec_id % 5 = 0 THEN list_reverse(v) ELSE v END AS v FROM {E} WHERE vec_id % 7 <> 0)"


@query("collection_search", f"SELECT e.id, round({sql_dot('e.v', 'q.v')}, 6) AS score FROM {_CHANGED} e, {UNIT_Q0} q ORDER BY {sql_dot('e.v', 'q.v')} DESC, e.id LIMIT 20")
def collection_search(spark, sf):
    """A collection that is compacted, then changed: its base is read as it is, without the changed ids."""
    c = database(spark).collection("c", 64, "dot")
    _changed(c, vectors(spark, sf))
    return rounded(c.search(first_unit(spark, sf), 20).select("id", "score"))


@query("collection_search_indexed", f"SELECT e.id, round({sql_dot('e.v', 'q.v')}, 6) AS score FROM {_CHANGED} e, {UNIT_Q0} q ORDER BY {sql_dot('e.v', 'q.v')} DESC, e.id LIMIT 20")
def collection_search_indexed(spark, sf):
    """The same through an index that is built before the changes and brought up to date by the search."""
    from ..operators.ivf import AnnConfig

    c = database(spark).collection("c", 64, "dot", index=AnnConfig(cells=8, probes=8))
    _changed(c, vectors(spark, sf), lambda: c.search(first_unit(spark, sf), 1))
    return rounded(c.search(first_unit(spark, sf), 20).select("id", "score"))


def _changed(c, rows, between=lambda: None) -> None:
    c.upsert_frame(rows)
    c.compact()
    between()
    c.upsert_frame(rows.where("vec_id % 5 = 0").withColumn("vector", F.reverse("vector")))
    c.delete_frame(rows.where("vec_id % 7 = 0"))


_HALF = "round(list_sum(list_transform(v, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 4)"


@query("collection_lifecycle", f"SELECT id, CAST(label AS BIGINT) AS label, version FROM (SELECT id, label, vec_id, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END AS version FROM {E}) WHERE vec_id % 7 <> 0")
def collection_lifecycle(spark, sf):
    from ..sources.store import Database

    c = Database(spark, scratch(spark), lambda: NOW).collection("c", 64, "dot")
    rows = vectors(spark, sf)
    meta = lambda v: F.to_json(F.struct(F.col("label"), F.lit(v).alias("version")))
    c.upsert_frame(rows.withColumn("metadata", meta(1)))
    c.upsert_frame(rows.where("vec_id % 5 = 0").withColumn("metadata", meta(2)))
    c.delete_frame(rows.where("vec_id % 7 = 0"))
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    return c.rows().select("id", get("label").cast("long").alias("label"), get("version").cast("int").alias("version"))


@query("ndjson_roundtrip", f"SELECT id, {_HALF} AS total, label FROM {E}")
def ndjson_roundtrip(spark, sf):
    from ..sources import ndjson
    from ..sources.store import Database

    db = Database(spark, scratch(spark), lambda: NOW)
    one, two = db.collection("one", 64, "dot"), db.collection("two", 64, "dot")
    one.upsert_frame(vectors(spark, sf))
    ndjson.export(one, f"{db.root}/export")
    ndjson.import_file(two, f"{db.root}/export")
    total = F.round(F.aggregate(V.doubles("vector"), F.lit(0.0), lambda s, x: s + x), 4)
    return two.rows().select("id", total.alias("total"), F.get_json_object("metadata", "$.label").cast("int").alias("label"))
