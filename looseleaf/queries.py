"""Registered queries over the driver's tables, one or more per operator, and the SQL that states the same."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import json_udf
from .functions import variants as V
from .functions.jsonpath import JsonPath, Limits
from .functions.paths import CatalogPath, VariantPath
from .operators import bitmaps as B
from .operators import diagnostics, indexes
from .operators import schema as S
from .operators.predicates import FALSE, TRUE, nodes, normalise, path, value_range
from .operators.query import DOCUMENT, Projection, Query, row_json
from .plans.planner import Engine, type_notes
from .sources.store import DocumentStore, Options, WriteBatch
from .streaming.ingest import drain, ingest_lines

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON texts with their line items inside, and some fields of varying presence and type."""
    V.configure(spark)
    k = F.col("o_orderkey")
    # The lines of an order meet once, ahead of the aggregate; the join needs no shuffle besides this one and that of the orders.
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("disc"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"),
        ))).alias("items")
    )
    # Building JSON is what costs here: spread the rows for it, however few files and splits they came from.
    joined = table(spark, sf_dir, "orders").repartition(k).join(lines, k == F.col("l_orderkey"), "left")
    score = (k % 50).cast("string")
    body = F.to_json(F.struct(
        k.alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("priority"), "items",
        F.when(k % 3 != 1, F.when(k % 6 != 2, F.concat(F.lit("n"), (k % 10).cast("string")))).alias("note"),
        F.array(F.concat(F.lit("t"), (k % 5).cast("string")), F.concat(F.lit("t"), (k % 3).cast("string"))).alias("tags"),
        F.struct(F.lit("Order").alias("@type"), F.struct(F.lit("Leaf").alias("@type"), F.concat(F.lit("leaf-"), (k % 7).cast("string")).alias("name")).alias("inner")).alias("meta"),
        (k % 2 == 0).alias("even"),
    ))
    extra = F.concat(F.when(k % 6 == 2, ',"note":null').otherwise(""), F.lit(',"score":'), F.when(k % 7 < 5, score).otherwise(F.concat(F.lit('"'), score, F.lit('"'))))
    text = F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.col("extra"), F.lit("}"))
    bodies = V.once(joined.withColumn("extra", extra), "body", body)
    return bodies.select(F.lpad(k.cast("string"), 10, "0").alias("key"), text.alias("text"))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.once(order_texts(spark, sf_dir), "doc", V.fast_json(F.col("text"))).select("key", "doc")


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    V.configure(spark)
    return table(spark, sf_dir, "events").select("event_id", V.fast_json(F.col("props")).alias("doc"))


#: The order documents' fields, relationally.
BASE = """WITH d AS (
  SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS key, o_orderkey AS k, o_custkey AS custkey, o_orderstatus AS status, o_totalprice AS total,
    strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS priority,
    CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 6 <> 2 THEN 'n' || (o_orderkey % 10) END AS note, o_orderkey % 6 = 2 AND o_orderkey % 3 <> 1 AS note_null,
    't' || (o_orderkey % 5) AS tag1, 't' || (o_orderkey % 3) AS tag2, o_orderkey % 50 AS score, o_orderkey % 7 < 5 AS score_num FROM orders),
i AS (SELECT lpad(l_orderkey::VARCHAR, 10, '0') AS key, l_linenumber AS line, l_partkey AS part, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_returnflag AS flag, l_linestatus AS state
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
"""


def add(name: str, sql: str | None = None):
    """Registers a query, with its SQL over BASE (or on its own, if it begins with WITH)."""

    def keep(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql if sql.lstrip().upper().startswith("WITH") else BASE + sql
        return run

    return keep


def keys_where(name: str, predicate, condition: str) -> None:
    add(name, f"SELECT key FROM d WHERE {condition}")(lambda s, d: Query.where(predicate).on(order_docs(s, d), ordered=False))


def has(test: str) -> str:
    return f"EXISTS (SELECT 1 FROM i WHERE i.key = d.key AND {test})"


RETURNED, OPEN = "flag = 'R'", " AND state <> 'F'"


def p(text: str):
    return path(text)


# --- predicates ------------------------------------------------------------------------------------------------------

keys_where("f01_constants", (TRUE & ~FALSE) & (FALSE | TRUE), "TRUE")
keys_where("f02_and_or", (p("$.items[*].flag").eq("R") & p("$.items[*].qty").gt(45)) | p("$.status").eq("P"), f"({has(RETURNED)} AND {has('qty > 45')}) OR status = 'P'")
keys_where("f03_eq_text", p("$.priority").eq("1-URGENT"), "priority = '1-URGENT'")
keys_where("f03_eq_number", p("$.score").eq(7), "score_num AND score = 7")
keys_where("f03_eq_text_of_digits", p("$.score").eq("7"), "NOT score_num AND score = 7")
keys_where("f03_eq_boolean", p("$.even").eq(True), "k % 2 = 0")
keys_where("f03_eq_element", p("$.items[*].flag").eq("R"), has("flag = 'R'"))
keys_where("f04_range_number", p("$.total").ge(Decimal("100000.5")) & p("$.items[*].disc").lt(0.02), f"total >= 100000.5 AND {has('disc < 0.02')}")
keys_where("f04_range_text", p("$.date").lt("1995-06-01") & p("$.date").gt("1993-02-28"), "date < '1995-06-01' AND date > '1993-02-28'")
keys_where("f05_in", p("$.score").one_of(1, 2, "3", None) | p("$.note").one_of("n1", None), "(score_num AND score IN (1, 2)) OR (NOT score_num AND score = 3) OR note = 'n1' OR note_null")
keys_where("f06_between_by_two_values", p("$.items[*].qty").between(20, 21), f"{has('qty >= 20')} AND {has('qty <= 21')}")
keys_where("f07_exists", p("$.note").exists(), "note IS NOT NULL OR note_null")
keys_where("f07_exists_container", p("$.items").exists() | p("$.meta").exists(), "FALSE")
keys_where("f08_is_null", p("$.note").is_null(), "note_null")
keys_where("f09_not", ~(p("$.note").eq("n3") | p("$.missing").exists()), "NOT coalesce(note = 'n3', FALSE)")
keys_where("f10_elem_match", p("$.items[*]").elem_match(p("$.flag").eq("R") & p("$.qty").gt(45)), has("flag = 'R' AND qty > 45"))
keys_where("f10_elem_match_not", ~p("$.items[*]").elem_match(p("$.flag").eq("R") & ~p("$.state").eq("F")), f"NOT {has(RETURNED + OPEN)}")
keys_where("f10_elem_match_scalar", p("$.tags[*]").elem_match(p("$").eq("t2")), "tag1 = 't2' OR tag2 = 't2'")
keys_where("f11_descendant", p("$..name").eq("leaf-3"), "k % 7 = 3")
keys_where("f11_descendant_match", p("$..").elem_match(p('$["@type"]').eq("Leaf") & p("$.name").eq("leaf-4")), "k % 7 = 4")
keys_where("f12_folded", p("$.even").eq(True) & ~path("$.even").lt(True) & ~path("$.note").gt("zz"), "k % 2 = 0")
keys_where("f13_not_equal", ~p("$.status").eq("F"), "status <> 'F'")
add("f14_paths", "SELECT * FROM (VALUES (0, '$.a'), (1, '$.b[*].c'), (2, '$.items[*]')) t(pos, path)")(
    lambda s, d: s.createDataFrame([(i, str(x)) for i, x in enumerate((p("$.a").eq(1) & ~(p("$.b[*].c").exists() | p("$.a").is_null()) & p("$.items[*]").elem_match(p("$.z").eq(1))).paths())], "pos int, path string")
)
add("f15_one_value_range", f"SELECT key FROM d WHERE {has('qty >= 20 AND qty < 21')}")(
    lambda s, d: order_docs(s, d).filter(value_range("$.items[*].qty", 20, 21, high_open=True).column("doc")).select("key")
)

# --- projection ------------------------------------------------------------------------------------------------------

add("p1_keys", "SELECT key FROM d WHERE status = 'P'")(lambda s, d: Query.where(p("$.status").eq("P")).on(order_docs(s, d), ordered=False))
add("p2_document", "SELECT key, k AS orderkey, status FROM d WHERE status = 'P'")(
    lambda s, d: Query.where(p("$.status").eq("P")).project(DOCUMENT).on(order_docs(s, d), ordered=False)
    .select("key", F.expr("variant_get(doc, '$.orderkey', 'long')").alias("orderkey"), F.expr("variant_get(doc, '$.status', 'string')").alias("status"))
)


@add("p3_fields", "SELECT d.key, status, i.qty AS first_qty, CASE WHEN note IS NOT NULL THEN 'value' WHEN note_null THEN 'null' ELSE 'absent' END AS note FROM d LEFT JOIN (SELECT key, qty, row_number() OVER (PARTITION BY key ORDER BY line, part, qty, price) AS r FROM i) i ON i.key = d.key AND r = 1 WHERE score < 5")
def p3_fields(s, d):
    pick = Projection.of("$.status", "$.items[0].qty", "$.note")
    rows = Query.where(p("$.score").lt(5) | p("$.score").one_of("0", "1", "2", "3", "4")).project(pick).on(order_docs(s, d), ordered=False)
    note = F.col("`$.note`")
    state = F.when(note.isNull(), "absent").when(F.is_variant_null(note), "null").otherwise("value")  # P4: absent and JSON null stay apart
    return rows.select("key", V.string_value(F.col("`$.status`")).alias("status"), F.try_variant_get(F.col("`$.items[0].qty`"), "$", "double").alias("first_qty"), state.alias("note"))


add("p4_null_handling", "SELECT count(*) FILTER (note IS NOT NULL) AS present, count(*) FILTER (note_null) AS nulls, count(*) FILTER (note IS NULL AND NOT note_null) AS absent FROM d")(
    lambda s, d: order_docs(s, d).select(F.try_variant_get(F.col("doc"), "$.note", "variant").alias("n")).agg(
        F.count_if(F.col("n").isNotNull() & ~F.is_variant_null("n")).alias("present"), F.count_if(F.is_variant_null("n")).alias("nulls"), F.count_if(F.col("n").isNull()).alias("absent"))
)
add("p5_row_json", "SELECT key, '{\"$.status\":\"' || status || '\",\"$.note\":' || coalesce('\"' || note || '\"', 'null') || '}' AS json FROM d WHERE status = 'P'")(
    lambda s, d: Query.where(p("$.status").eq("P")).project(Projection.of("$.status", "$.note")).on(order_docs(s, d), ordered=False).select("key", row_json(Projection.of("$.status", "$.note")).alias("json"))
)
add("p7_key_range", "SELECT key FROM d WHERE key BETWEEN '0000000100' AND '0000000300'")(lambda s, d: Query.where(TRUE).range("0000000100", "0000000300").on(order_docs(s, d), ordered=False))
add("p8_limit", "SELECT key FROM d WHERE status = 'F' ORDER BY key LIMIT 25")(lambda s, d: Query.where(p("$.status").eq("F")).take(25).on(order_docs(s, d)))

# --- sources, text in and out ----------------------------------------------------------------------------------------

add("s1_parse", "WITH e AS (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events) SELECT * FROM e")(lambda s, d: event_docs(s, d).select("event_id", F.expr("try_variant_get(doc, '$.k', 'bigint')").alias("k")))
add("s1_strict", "SELECT * FROM (VALUES ('[1,2]', TRUE), ('1 2', FALSE), ('01', FALSE), ('', FALSE), ('{\"a\":1,\"a\":2}', TRUE), ('\"\\ud800\"', FALSE), ('NaN', FALSE)) t(text, ok)")(
    lambda s, d: V.configure(s).createDataFrame([(t,) for t in ("[1,2]", "1 2", "01", "", '{"a":1,"a":2}', '"\\ud800"', "NaN")], "text string").select("text", V.strict_json(F.col("text")).isNotNull().alias("ok"))
)
add("s2_json_text", "WITH e AS (SELECT event_id, '{\"k\":' || (props->>'$.k') || '}' AS json FROM events) SELECT * FROM e")(lambda s, d: event_docs(s, d).select("event_id", V.json_text(F.col("doc")).alias("json")))
add("s3_builder", "SELECT r_regionkey, '{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}' AS json FROM (SELECT * FROM region)")(
    lambda s, d: V.documents_from(table(V.configure(s), d, "region")).select("r_regionkey", F.to_json("doc").alias("json"))
)


def scratch(spark: SparkSession) -> str:
    """A folder for a store: in the shared folder of the session where it names one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        import uuid

        return f"{folder.rstrip('/')}/stores/{uuid.uuid4().hex}"
    return tempfile.mkdtemp(prefix="looseleaf-store-")


def customer_store(s: SparkSession, d: str) -> DocumentStore:
    """Customers as documents, then some put again, deleted by range and by prefix: four commits."""
    st = DocumentStore(s, scratch(s))
    c = table(s, d, "customer").select(F.format_string("c:%06d", "c_custkey").alias("key"), "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    docs = V.documents_from(c, "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    st.append(docs.select("key", "doc"))
    again = V.documents_from(c.filter("c_custkey % 10 = 3").withColumn("c_mktsegment", F.lit("CHANGED")), "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    st.append(again.select("key", "doc"))
    st.delete_range("c:000011", "c:000020")
    st.delete_prefix("c:00005")
    return st


LIVE = """WITH live AS (SELECT 'c:' || lpad(c_custkey::VARCHAR, 6, '0') AS key, c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'CHANGED' ELSE c_mktsegment END AS segment, c_nationkey AS nation
  FROM customer WHERE c_custkey NOT BETWEEN 11 AND 20 AND c_custkey NOT BETWEEN 50 AND 59)
"""


def opened(rows: DataFrame) -> DataFrame:
    doc = F.col("doc")
    return rows.select(F.decode("key", "utf-8").alias("key"), F.try_variant_get(doc, "$.c_custkey", "bigint").alias("c_custkey"), F.try_variant_get(doc, "$.c_mktsegment", "string").alias("segment"))


add("s4_s10_store_scan", LIVE + "SELECT key, c_custkey, segment FROM live")(lambda s, d: opened(customer_store(s, d).scan(ordered=False)))
add("s10_range_scan", LIVE + "SELECT key, c_custkey, segment FROM live WHERE key BETWEEN 'c:000021' AND 'c:000060'")(lambda s, d: opened(customer_store(s, d).scan("c:000021", "c:000060", ordered=False)))
add("s11_prefix_scan", LIVE + "SELECT key, c_custkey, segment FROM live WHERE key LIKE 'c:00002%'")(lambda s, d: opened(customer_store(s, d).scan_prefix("c:00002", ordered=False)))


@add("s9_point_get", LIVE + "SELECT * FROM (VALUES ('c:000003', 'CHANGED'), ('c:000012', NULL), ('c:000055', NULL)) t(key, segment)")
def s9_point_get(s, d):
    st = customer_store(s, d)
    rows = [(k, None if (t := st.get(k)) is None else json_udf.read_json(t)["c_mktsegment"]) for k in ("c:000003", "c:000012", "c:000055")]
    return s.createDataFrame(rows, "key string, segment string")


@add("s14_snapshot", LIVE + "SELECT (SELECT count(*) FROM customer) AS before_, (SELECT count(*) FROM live) + 1 AS after_")
def s14_snapshot(s, d):
    st = DocumentStore(s, scratch(s))
    docs = V.documents_from(table(s, d, "customer").withColumn("key", F.format_string("c:%06d", "c_custkey")), "c_custkey").select("key", "doc")
    st.append(docs)
    snap = st.snapshot()
    st.delete_range("c:000011", "c:000020")
    st.delete_prefix("c:00005")
    st.write(WriteBatch().put("zz", '{"c_custkey": -1}').delete("absent").put("zz", '{"c_custkey": -2}'))
    return s.createDataFrame([(st.scan(snapshot=snap, ordered=False).count(), st.scan(ordered=False).count())], "before_ long, after_ long")


@add("s16_compact", LIVE + "SELECT key, c_custkey, segment FROM live")
def s16_compact(s, d):
    st = customer_store(s, d)
    st.compact()
    return opened(st.scan(ordered=False))


@add("s17_checkpoint", LIVE + "SELECT key, c_custkey, segment FROM live")
def s17_checkpoint(s, d):
    return opened(customer_store(s, d).checkpoint(scratch(s) + "/copy").scan(ordered=False))


@add("s12_partial_scan", "WITH c AS (SELECT 'c:' || lpad(c_custkey::VARCHAR, 6, '0') AS key, c_custkey, 'CHANGED' AS segment FROM customer WHERE c_custkey % 10 = 3) SELECT * FROM c")
def s12_partial_scan(s, d):
    st = customer_store(s, d)
    return opened(st.scan_segments([st.manifest().segments[1].name]))


@add("s21_stats", LIVE + "SELECT 4 AS segments, 2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey % 10 = 3) - (SELECT count(*) FROM live) AS rows_")
def s21_stats(s, d):
    x = customer_store(s, d).stats()
    return s.createDataFrame([(x["segments"], x["rows"])], "segments int, rows_ long")


@add("s19_incremental_lines", "WITH e AS (SELECT count(*) AS documents FROM events) SELECT documents FROM e")
def s19_incremental_lines(s, d):
    root = scratch(s)
    table(s, d, "events").select(F.to_json(F.struct("event_id", "props")).alias("value")).write.text(f"{root}/in")
    st = DocumentStore(s, f"{root}/store")
    ingest_lines(s, f"{root}/in", st, f"{root}/checkpoint")
    ingest_lines(s, f"{root}/in", st, f"{root}/checkpoint")  # nothing new: nothing changes
    return st.scan(ordered=False).agg(F.count("*").alias("documents"))




@add("s19_repeated_lines", "WITH e AS (SELECT '{\"type\":\"' || event_type || '\"}' AS json, event_id FROM events) SELECT json, 2 * count(*) AS n FROM e GROUP BY json")
def s19_repeated_lines(s, d):
    """Lines that repeat within a file and across files of one name in two folders are documents of their own."""
    root = scratch(s)
    lines = table(s, d, "events").select(F.to_json(F.struct(F.col("event_type").alias("type"))).alias("value")).coalesce(1)
    for part in ("a", "b"):
        lines.write.text(f"{root}/in/part={part}")
    st = DocumentStore(s, f"{root}/store")
    ingest_lines(s, f"{root}/in", st, f"{root}/checkpoint")
    return st.scan(ordered=False).groupBy(F.to_json("doc").alias("json")).agg(F.count("*").alias("n"))


@add("s4_pending_writes", LIVE + "SELECT key, c_custkey, segment FROM live WHERE key <> 'c:000001' UNION ALL SELECT 'c:000012', 12, 'BACK'")
def s4_pending_writes(s, d):
    """Puts and deletes that weren't flushed yet are part of a scan."""
    st = customer_store(s, d)
    st.put("c:000012", '{"c_custkey":12,"c_mktsegment":"BACK"}')
    st.delete("c:000001")
    found = opened(st.scan(ordered=False))
    assert st.stats()["pending"] == 2
    return found


@add("s15_flush", LIVE + "SELECT key, c_custkey, segment FROM live UNION ALL SELECT 'c:000012', 12, 'BACK'")
def s15_flush(s, d):
    """What was flushed is seen by another reader of the store."""
    st = customer_store(s, d)
    st.put("c:000012", '{"c_custkey":12,"c_mktsegment":"BACK"}')
    st.flush()
    return opened(DocumentStore(s, st.path).scan(ordered=False))


@add("s18_recovery", LIVE + "SELECT key, c_custkey, segment FROM live UNION ALL SELECT 'c:000012', 12, 'BACK'")
def s18_recovery(s, d):
    """A torn newest manifest is passed over, and writing goes on after it."""
    st = customer_store(s, d)
    st._fs.create(st._path("manifests", f"{st._next():012d}.json"), False).close()
    again = DocumentStore(s, st.path)
    again.put("c:000012", '{"c_custkey":12,"c_mktsegment":"BACK"}')
    again.flush()
    return opened(DocumentStore(s, st.path).scan(ordered=False))


@add("s16_maintain", LIVE + "SELECT key, c_custkey, segment FROM live UNION ALL SELECT 'zz', -1, 'NEW'")
def s16_maintain(s, d):
    """Level-0 segments merge with the level-1 segments they overlap; the one elsewhere stays."""
    st = customer_store(s, d)
    st.options = Options(level0_segments=1)
    first = st.maintain()
    st.write(WriteBatch().put("zz", '{"c_custkey":-1,"c_mktsegment":"NEW"}'))
    st.write(WriteBatch().put("zy", "{}"))
    st.write(WriteBatch().delete("zy"))
    assert first.segments[0] in st.maintain().segments
    return opened(st.scan(ordered=False))


add("s20_roaring", "WITH c AS (SELECT c_custkey AS n FROM customer WHERE c_custkey % 3 = 0) SELECT n FROM c")(
    lambda s, d: B.of(s, B.decode_roaring(B.encode_roaring(r.n for r in table(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("n")).toLocalIterator())))
)
add("a6_drain", "WITH c AS (SELECT count(*) AS shipped, 0::BIGINT AS left_ FROM customer WHERE c_custkey NOT BETWEEN 11 AND 20 AND c_custkey NOT BETWEEN 50 AND 59) SELECT * FROM c")(lambda s, d: _drained(s, d))


def _drained(s, d):
    st, shipped = customer_store(s, d), []
    drain(st, lambda rows: shipped.append(rows.count()), rows=1_000_000)
    return s.createDataFrame([(sum(shipped), st.scan(ordered=False).count())], "shipped long, left_ long")


# --- joins that stand in for the engine's own mechanisms ----------------------------------------------------------------

add("n3_intersection", "SELECT key FROM d WHERE status = 'F' AND priority = '1-URGENT'")(
    lambda s, d: (x := order_docs(s, d)) and Query.where(p("$.status").eq("F")).on(x, ordered=False).join(Query.where(p("$.priority").eq("1-URGENT")).on(x, ordered=False), "key", "left_semi")
)
add("n4_not_exists", "SELECT key FROM d WHERE note IS NULL AND NOT note_null")(
    lambda s, d: (x := order_docs(s, d)) and x.select("key").join(Query.where(p("$.note").exists()).on(x, ordered=False), "key", "left_anti")
)

# --- schema model ----------------------------------------------------------------------------------------------------

STATS = BASE + """, paths AS (
  SELECT '$' AS path, count(*) AS observations, 0 AS nulls FROM d UNION ALL SELECT '$.status', count(*), 0 FROM d UNION ALL
  SELECT '$.note', count(*), count(*) FILTER (note_null) FROM d WHERE note IS NOT NULL OR note_null UNION ALL
  SELECT '$.tags', count(*), 0 FROM d UNION ALL SELECT '$.tags[*]', 2 * count(*), 0 FROM d UNION ALL
  SELECT '$.meta.inner.name', count(*), 0 FROM d UNION ALL SELECT '$.items', count(DISTINCT key), 0 FROM i UNION ALL
  SELECT '$.items[*]', count(*), 0 FROM i UNION ALL SELECT '$.items[*].flag', count(*), 0 FROM i UNION ALL SELECT '$.score', count(*), 0 FROM d)
"""
_SEEN = ["$", "$.status", "$.note", "$.tags", "$.tags[*]", "$.meta.inner.name", "$.items", "$.items[*]", "$.items[*].flag", "$.score"]


def stats(s, d):
    return S.path_statistics(order_docs(s, d)).filter(F.col("path").isin(_SEEN))


add("g1_document_count", "SELECT count(*) AS documents FROM d")(lambda s, d: order_docs(s, d).filter("doc is not null").agg(F.count("*").alias("documents")))
add("g2_g3_observations", STATS + "SELECT path, observations::BIGINT AS observations, nulls::BIGINT AS nulls FROM paths")(lambda s, d: stats(s, d).select("path", "observations", "nulls"))
add("g4_type_histogram", "SELECT * FROM (SELECT 'INTEGER' AS kind, count(*) FILTER (score_num) AS n FROM d UNION ALL SELECT 'STRING', count(*) FILTER (NOT score_num) FROM d)")(
    lambda s, d: stats(s, d).filter("path = '$.score'").select(F.explode("histogram").alias("h")).select("h.kind", F.col("h.count").alias("n"))
)
add("g5_dominant_type", "SELECT 'INTEGER' AS dominant, round(count(*) FILTER (score_num) / count(*), 6) AS stability FROM d")(
    lambda s, d: stats(s, d).filter("path = '$.score'").select("dominant", F.round("stability", 6).alias("stability"))
)
add("g7_distinct", "SELECT * FROM (SELECT '$.status' AS path, count(DISTINCT status) AS n FROM d UNION ALL SELECT '$.note', count(DISTINCT note) FROM d UNION ALL SELECT '$.tags[*]', 5 UNION ALL SELECT '$.items[*].flag', count(DISTINCT flag) FROM i UNION ALL SELECT '$.score', 50 + 50 FROM (SELECT 1))")(
    lambda s, d: stats(s, d).filter(F.col("path").isin("$.status", "$.note", "$.tags[*]", "$.items[*].flag", "$.score")).select("path", F.col("distinct").alias("n"))
)
add("g8_number_bounds", "SELECT min(qty) AS low, max(qty) AS high FROM i")(
    lambda s, d: S.path_statistics(order_docs(s, d)).filter("path = '$.items[*].qty'").select(F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
)


def wide_docs(s, d):
    """Orders with epoch milliseconds, 25-digit integers, and, for some, 1e300."""
    k = F.col("o_orderkey")
    big = F.concat(F.lit("1234567890123456789"), F.lpad(k.cast("string"), 6, "0"))
    millis = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    text = F.concat(F.lit('{"ts":'), (millis + k).cast("string"), F.lit(',"big":'), big, F.when(k % 7 == 0, ',"huge":1e300,"tiny":-2.5e-30').otherwise(""), F.lit("}"))
    return V.configure(s) and table(s, d, "orders").select(V.fast_json(text).alias("doc"))


add("g8_wide_number_bounds", "WITH o AS (SELECT o_orderkey AS k, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400000 + o_orderkey AS ts, '1234567890123456789' || lpad(o_orderkey::VARCHAR, 6, '0') AS big FROM orders) SELECT '$.ts' AS path, min(ts)::VARCHAR AS low, max(ts)::VARCHAR AS high, count(*) AS n FROM o UNION ALL SELECT '$.big', min(big), max(big), count(*) FROM o UNION ALL SELECT '$.huge', '1E+300', '1E+300', count(*) FROM o WHERE k % 7 = 0 UNION ALL SELECT '$.tiny', '-0.0000000000000000000000000000025', '-0.0000000000000000000000000000025', count(*) FROM o WHERE k % 7 = 0")(
    lambda s, d: S.path_statistics(wide_docs(s, d)).filter("path <> '$'").select("path", "low", "high", F.col("observations").alias("n"))
)
add("g14_wide_schema", "WITH o AS (SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400000 + o_orderkey AS ts FROM orders) SELECT min(ts) AS low, max(ts) AS high FROM o")(
    lambda s, d: (m := S.infer_schema(wide_docs(s, d)).get("$.ts")) and s.createDataFrame([(int(m.low), int(m.high))], "low long, high long")
)
add("g9_text_bounds", "SELECT min(date) AS first, max(date) AS last FROM d")(lambda s, d: S.path_statistics(order_docs(s, d)).filter("path = '$.date'").select("first", "last"))
add("g10_signature", "SELECT count(DISTINCT qty) AS n FROM i")(
    lambda s, d: order_docs(s, d).select(F.explode(nodes(F.col("doc"), CatalogPath.parse("$.items[*].qty"))).alias("v")).select(V.signature(F.col("v")).alias("sig")).agg(F.count_distinct("sig").alias("n"))
)
_MOST = "SELECT path, (SELECT count(*) FROM i) AS n FROM (VALUES {}) t(path)"
# Element paths are observed most, ties by path: the budget keeps the first of them.
add("g11_path_budget", _MOST.format("('$.items[*]'), ('$.items[*].disc'), ('$.items[*].flag'), ('$.items[*].line'), ('$.items[*].part')"))(
    lambda s, d: S.path_statistics(order_docs(s, d), budgets=S.Budgets(paths=5)).select("path", F.col("observations").alias("n"))
)
add("g12_walk_budgets", "SELECT count(*) FILTER (n > 3) AS cuts FROM (SELECT count(*) AS n FROM i GROUP BY key)")(
    lambda s, d: S.path_statistics(order_docs(s, d).select(F.expr("try_variant_get(doc, '$.items', 'variant')").alias("doc")), budgets=S.Budgets(children=3)).filter("path = '$'").select("cuts")
)
add("g13_merge", STATS + "SELECT path, observations::BIGINT AS observations, nulls::BIGINT AS nulls FROM paths")(
    lambda s, d: (x := order_docs(s, d)) and S.merge_sketches(S.partial_sketch(x.filter("key < '0000000500'")).unionAll(S.partial_sketch(x.filter("key >= '0000000500'")))).filter(F.col("path").isin(_SEEN)).select("path", "observations", "nulls")
)
add("g14_infer_schema", "SELECT '$.note' AS path, round((SELECT count(*) FROM d WHERE note IS NOT NULL OR note_null) / (SELECT count(*) FROM d), 6) AS presence, round((SELECT count(*) FROM d WHERE note_null) / (SELECT count(*) FROM d WHERE note IS NOT NULL OR note_null), 6) AS null_fraction")(
    lambda s, d: (m := S.infer_schema(order_docs(s, d)).get("$.note")) and s.createDataFrame([(str(m.path), round(m.presence, 6), round(m.null_fraction, 6))], "path string, presence double, null_fraction double")
)
add("g15_index_candidates")(lambda s, d: s.createDataFrame([(i, str(c.path), c.index, c.score) for i, c in enumerate(S.index_candidates(S.infer_schema(order_docs(s, d))))], "rank int, path string, index string, score double"))
add("g16_shredding_advice")(lambda s, d: s.createDataFrame([(i, str(c.path), c.parquet_type, c.residual, c.byte_share) for i, c in enumerate(S.shredding_advice(S.infer_schema(order_docs(s, d))))], "rank int, path string, type string, residual boolean, byte_share double"))
add("g6_bytes")(lambda s, d: stats(s, d).select("path", "total_bytes", "average_bytes"))

# --- order, limit, top-k ---------------------------------------------------------------------------------------------

add("o1_key_order", "SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key FROM (SELECT key FROM d WHERE status = 'P' ORDER BY key LIMIT 50)")(
    lambda s, d: Query.where(p("$.status").eq("P")).take(50).on(order_docs(s, d)).agg(F.array_sort(F.collect_list("key")).alias("ks")).select(F.posexplode("ks").alias("pos", "key")).select(F.col("pos").cast("long"), "key")
)
add("o4_most_observed", _MOST.format("('$.items[*]'), ('$.items[*].disc'), ('$.items[*].flag')"))(
    lambda s, d: S.path_statistics(order_docs(s, d), budgets=S.Budgets(paths=3)).select("path", F.col("observations").alias("n"))
)

# --- set algebra -----------------------------------------------------------------------------------------------------


def sets(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("n"))
    return c.filter("n % 2 = 0"), c.filter("n % 3 = 0")


N = "WITH c AS (SELECT c_custkey AS n FROM customer) SELECT n FROM c WHERE "
add("b1_and", N + "n % 2 = 0 AND n % 3 = 0")(lambda s, d: B.intersection(*sets(s, d)))
add("b2_or", N + "n % 2 = 0 OR n % 3 = 0")(lambda s, d: B.union(*sets(s, d)))
add("b3_and_not", N + "n % 2 = 0 AND n % 3 <> 0")(lambda s, d: B.and_not(*sets(s, d)))
add("b4_xor", N + "(n % 2 = 0) <> (n % 3 = 0)")(lambda s, d: B.xor(*sets(s, d)))
add("b5_rank_select", "WITH a AS (SELECT c_custkey AS n FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS n FROM customer WHERE c_custkey % 3 = 0) SELECT (SELECT count(*) FROM a) AS size, (SELECT min(n) FROM a) AS first, (SELECT max(n) FROM a) AS last, (SELECT count(*) FROM a WHERE n <= 51) AS rank, (SELECT n FROM a ORDER BY n LIMIT 1 OFFSET 10) AS tenth, (SELECT count(*) FROM a JOIN b USING (n)) AS both, TRUE AS has")(
    lambda s, d: (ab := sets(s, d)) and s.createDataFrame(
        [(B.cardinality(ab[0]), B.first(ab[0]), B.last(ab[0]), B.rank(ab[0], 51), B.select(ab[0], 10), B.and_cardinality(*ab), B.contains(ab[0], 4) and B.intersects(*ab))],
        "size long, first long, last long, rank long, tenth long, both long, has boolean")
)
add("b6_ranges", "WITH c AS (SELECT range AS n FROM range(1, 101) WHERE range % 2 = 0 OR range BETWEEN 40 AND 60), e AS (SELECT n FROM c WHERE n NOT BETWEEN 50 AND 70) SELECT n FROM e")(
    lambda s, d: B.remove_range(B.add_range(B.of_range(s, 1, 100).filter("n % 2 = 0"), 40, 60), 50, 70)
)
add("b7_cursor", "WITH c AS (SELECT c_custkey AS n, row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM c")(lambda s, d: B.with_rank(sets(s, d)[1]))

# --- indexes ---------------------------------------------------------------------------------------------------------


def order_store(s, d, *definitions) -> tuple[DocumentStore, indexes.IndexRegistry, list[int]]:
    """Order documents in two segments, indexes made after the first and filled in for the second."""
    st = DocumentStore(s, scratch(s))
    docs = order_docs(s, d)
    st.append(docs.filter("key < '0000000700'"))
    reg = indexes.IndexRegistry(st)
    made = [reg.create(x) for x in definitions]
    st.append(docs.filter("key >= '0000000700'"))
    for k in made[:1]:
        reg.backfill(k)
    return st, reg, made


def indexed(name: str, predicate, condition: str, *definitions) -> None:
    def run(s, d):
        st, reg, _ = order_store(s, d, *definitions)
        return Engine(st, reg).run(Query.where(predicate), ordered=False).select(F.decode("key", "utf-8").alias("key"))

    add(name, f"SELECT key FROM d WHERE {condition}")(run)


indexed("x1_inverted", p("$.priority").eq("1-URGENT") & p("$.status").eq("F"), "priority = '1-URGENT' AND status = 'F'", indexes.inverted("$.priority"), indexes.inverted("$.status"))
indexed("x2_column", p("$.total").gt(200000) & p("$.items[*].qty").ge(50), f"total > 200000 AND {has('qty >= 50')}", indexes.column("$.total"), indexes.column("$.items[*].qty"))
indexed("x4_composite", p("$.items[*]").elem_match(p("$.flag").eq("R") & p("$.qty").eq(7)), has("flag = 'R' AND qty = 7"), indexes.composite("$.items[*]", "$.flag", "$.qty"))
indexed("x10_absent", ~p("$.note").exists() & p("$.status").eq("O"), "note IS NULL AND NOT note_null AND status = 'O'", indexes.inverted("$.note"))


@add("x10_lookup", "SELECT key FROM d WHERE priority IN ('1-URGENT', '2-HIGH')")
def x10_lookup(s, d):
    _, reg, (k,) = order_store(s, d, indexes.inverted("$.priority"))
    return reg.lookup(k, "IN", ("1-URGENT", "2-HIGH")).select(F.decode("key", "utf-8").alias("key"))


@add("x11_column_evaluate", "SELECT key FROM d WHERE date < '1995-03-01'")
def x11_column_evaluate(s, d):
    _, reg, (k,) = order_store(s, d, indexes.column("$.date"))
    return reg.evaluate(k, p("$.date").lt("1995-03-01")).select(F.decode("key", "utf-8").alias("key"))


@add("x5_x9_lifecycle", "SELECT * FROM (VALUES ('created', 1), ('again', 1), ('covered', 1), ('uncovered', 1), ('after_backfill', 0), ('background', 2), ('left_after_drop', 1)) t(what, n)")
def x5_x9_lifecycle(s, d):
    st = DocumentStore(s, scratch(s))
    docs = order_docs(s, d)
    st.append(docs.filter("key < '0000000700'"))
    reg = indexes.IndexRegistry(st)
    k = reg.create(indexes.inverted("$.status"))
    rows = [("created", k), ("again", reg.create(indexes.inverted("$.status")))]
    st.append(docs.filter("key >= '0000000700'"))
    have, lack = reg.coverage(k)
    rows += [("covered", len(have)), ("uncovered", len(lack))]
    reg.backfill(k)
    rows.append(("after_backfill", len(reg.coverage(k)[1])))
    k2, build = reg.create_in_background(indexes.column("$.total"))
    build.wait()
    rows.append(("background", build.done if build.state == "COMPLETED" else -1))
    reg.drop(k)
    rows.append(("left_after_drop", len(reg.indexes())))
    return s.createDataFrame(rows, "what string, n int")


# --- scalar functions ------------------------------------------------------------------------------------------------

add("l1_select", "SELECT d.key, i.price FROM d LEFT JOIN (SELECT key, price, row_number() OVER (PARTITION BY key ORDER BY line, part, qty, price) AS r FROM i) i ON i.key = d.key AND r = 2")(
    lambda s, d: order_docs(s, d).select("key", F.try_variant_get(F.col("doc"), VariantPath.parse("$.items[1].price").spark(), "double").alias("price"))
)
add("l2_fields", "SELECT key, '@type,inner' AS names FROM d")(
    lambda s, d: order_docs(s, d).select("key", F.array_join(F.transform(V.fields(F.expr("try_variant_get(doc, '$.meta', 'variant')")), lambda x: x["name"]), ",").alias("names"))
)
add("l3_elements", "SELECT key, tag1 || ',' || tag2 AS tags, 2 AS n FROM d")(
    lambda s, d: order_docs(s, d).select("key", F.array_join(F.transform(V.elements(F.expr("try_variant_get(doc, '$.tags', 'variant')")), V.string_value), ",").alias("tags"), V.child_count(F.expr("try_variant_get(doc, '$.tags', 'variant')")).alias("n"))
)
add("l4_typed_readers", "SELECT key, CASE WHEN score_num THEN score END AS as_long, CASE WHEN NOT score_num THEN score::VARCHAR END AS as_text FROM d")(
    lambda s, d: order_docs(s, d).select("key", F.try_variant_get(F.col("doc"), "$.score", "variant").alias("v")).select("key", V.long_value(F.col("v")).alias("as_long"), V.string_value(F.col("v")).alias("as_text"))
)
add("l5_kind", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN note IS NOT NULL THEN 'STRING' WHEN note_null THEN 'NULL' END AS kind FROM d) GROUP BY kind")(
    lambda s, d: order_docs(s, d).select(V.kind(F.try_variant_get(F.col("doc"), "$.note", "variant")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
)
add("l8_nodes", "SELECT key, line::BIGINT AS line FROM i")(
    lambda s, d: order_docs(s, d).select("key", F.explode(nodes(F.col("doc"), CatalogPath.parse("$.items[*].line"))).alias("v")).select("key", V.long_value(F.col("v")).alias("line"))
)

# --- JSONPath --------------------------------------------------------------------------------------------------------


def nodes_of(name: str, text: str, sql: str, cast: str = "double") -> None:
    def run(s, d):
        found = JsonPath.compile(text).column("doc")
        if cast == "string":  # the answer is texts: an array of 15 has the length 15, too, but isn't one
            found = F.filter(found, lambda v: V.type_text(v) == "STRING")
        return order_docs(s, d).select("key", F.posexplode(found).alias("pos", "v")).select("key", "pos", F.try_variant_get("v", "$", cast).alias("value"))

    add(name, sql)(run)


PLACE = "(row_number() OVER (PARTITION BY key ORDER BY line, part, qty, price) - 1)::INT"
nodes_of("r01_name", "$.status", "SELECT key, 0::INT AS pos, status AS value FROM d", "string")
nodes_of("r02_wildcard", "$.items[*].qty", f"SELECT key, {PLACE} AS pos, qty AS value FROM i")
nodes_of("r02_wildcard_object", "$.meta.inner.*", "SELECT key, pos, value FROM (SELECT key, 0::INT AS pos, 'Leaf' AS value FROM d UNION ALL SELECT key, 1::INT, 'leaf-' || (k % 7) FROM d)", "string")
nodes_of("r03_index", "$.items[-1].qty", "SELECT key, 0::INT AS pos, qty AS value FROM (SELECT key, qty, row_number() OVER (PARTITION BY key ORDER BY line DESC, part DESC, qty DESC, price DESC) AS r FROM i) WHERE r = 1")
nodes_of("r04_slice", "$.items[1:3].qty", f"SELECT key, pos - 1 AS pos, value FROM (SELECT key, {PLACE} AS pos, qty AS value FROM i) WHERE pos BETWEEN 1 AND 2")
nodes_of("r04_slice_back", "$.items[::-1].qty", "SELECT key, (row_number() OVER (PARTITION BY key ORDER BY line DESC, part DESC, qty DESC, price DESC) - 1)::INT AS pos, qty AS value FROM i")
nodes_of("r05_descendant", "$..name", "SELECT key, 0::INT AS pos, 'leaf-' || (k % 7) AS value FROM d", "string")
nodes_of("r06_several_selectors", "$['status','priority','status']", "SELECT key, pos, value FROM (SELECT key, 0::INT AS pos, status AS value FROM d UNION ALL SELECT key, 1::INT, priority FROM d UNION ALL SELECT key, 2::INT, status FROM d)", "string")
nodes_of("r07_filter", "$.items[?@.qty > 45].price", f"SELECT key, {PLACE} AS pos, price AS value FROM i WHERE qty > 45")
nodes_of("r08_logic", "$.items[?(@.qty > 45 || @.flag == 'R') && !(@.state == 'F')].qty", f"SELECT key, {PLACE} AS pos, qty AS value FROM i WHERE (qty > 45 OR flag = 'R') AND state <> 'F'")
nodes_of("r09_existence", "$[?@.inner].inner.name", "SELECT key, 0::INT AS pos, 'leaf-' || (k % 7) AS value FROM d", "string")
nodes_of("r10_comparison", "$.items[?@.disc <= 0.03 && @.part != $.custkey].qty", f"SELECT key, {PLACE} AS pos, qty AS value FROM (SELECT i.*, custkey FROM i JOIN d USING (key)) i WHERE disc <= 0.03 AND part <> custkey")
nodes_of("r11_length", "$[?length(@) == 15 && length(@.x) != 3]", "SELECT key, 0::INT AS pos, priority AS value FROM d WHERE length(priority) = 15", "string")
nodes_of("r12_count", "$[?count(@.items[*]) >= 0 && count(@[*]) == 2].inner.name", "SELECT key, 0::INT AS pos, 'leaf-' || (k % 7) AS value FROM d", "string")
nodes_of("r13_value", "$[?value(@..name) == 'leaf-2'].inner.name", "SELECT key, 0::INT AS pos, 'leaf-2' AS value FROM d WHERE k % 7 = 2", "string")
nodes_of("r14_regexp", "$[?match(@, '[0-9]-[A-Z]{3,6}') || search(@, '^199[2-3]')]", "SELECT key, (row_number() OVER (PARTITION BY key ORDER BY o) - 1)::INT AS pos, value FROM (SELECT key, 0 AS o, date AS value FROM d WHERE regexp_matches(date, '^199[2-3]') UNION ALL SELECT key, 1, priority FROM d WHERE regexp_full_match(priority, '[0-9]-[A-Z]{3,6}'))", "string")
add("r15_well_typed", "SELECT * FROM (VALUES ('$[?length(@.a)]', FALSE), ('$[?count(1) == 1]', FALSE), ('$[?@.a == 1]', TRUE), ('$[?match(@.a, ''x'') == true]', FALSE), ('$..', FALSE), ('$[?@[*] == 1]', FALSE)) t(path, ok)")(
    lambda s, d: s.createDataFrame([(t, _compiles(t)) for t in ("$[?length(@.a)]", "$[?count(1) == 1]", "$[?@.a == 1]", "$[?match(@.a, 'x') == true]", "$..", "$[?@[*] == 1]")], "path string, ok boolean")
)
add("r17_locations", f"SELECT key, '$[''items''][' || {PLACE} || '][''qty'']' AS location FROM i")(
    lambda s, d: order_docs(s, d).select("key", F.explode(JsonPath.compile("$.items[*].qty").nodes_column("doc", Limits())).alias("n")).select("key", "n.location")
)


def _compiles(text: str) -> bool:
    try:
        JsonPath.compile(text)
        return True
    except ValueError:
        return False


# --- explaining and diagnostics --------------------------------------------------------------------------------------


@add("d1_explain", "SELECT '$.priority' AS path, count(*) FILTER (priority = '1-URGENT') AS candidates, 2 AS indexed, 0 AS scanned FROM d")
def d1_explain(s, d):
    st, reg, _ = order_store(s, d, indexes.inverted("$.priority"))
    plan = Engine(st, reg).plan(Query.where(p("$.priority").eq("1-URGENT")), measure=True)
    return s.createDataFrame([(x.definition.path, x.candidates, len(plan.indexed), len(plan.scanned)) for x in plan.sources], "path string, candidates long, indexed int, scanned int")


add("d2_type_notes", "SELECT '$.score: ' || count(*) FILTER (NOT score_num) || ' of ' || count(*) || ' values are not integer' AS note FROM d")(
    lambda s, d: s.createDataFrame([(n,) for n in type_notes(normalise(p("$.score").gt(3)), S.infer_schema(order_docs(s, d)))], "note string")
)


@add("d3_query_stats", "SELECT count(*) FILTER (priority = '1-URGENT' AND status = 'F') AS rows_returned, count(*) FILTER (priority = '1-URGENT') AS candidate_keys, 2 AS indexed FROM d")
def d3_query_stats(s, d):
    st, reg, _ = order_store(s, d, indexes.inverted("$.priority"))
    x = Engine(st, reg).stats(Query.where(p("$.priority").eq("1-URGENT") & p("$.status").eq("F")))
    return s.createDataFrame([(x["rows_returned"], x["candidate_keys"], x["segments_indexed"])], "rows_returned long, candidate_keys long, indexed int")


add("d4_selectivity", "SELECT round(1.0 / count(DISTINCT status), 6) AS eq, round(1.0 / 3, 6) AS range_, round(avg((note IS NOT NULL OR note_null)::INT), 6) AS present, round(avg(note_null::INT), 6) AS nulls FROM d")(
    lambda s, d: (m := S.infer_schema(order_docs(s, d))) and s.createDataFrame(
        [tuple(round(S.selectivity(m, k, x), 6) for k, x in (("EQ", "$.status"), ("RANGE", "$.status"), ("EXISTS", "$.note"), ("IS_NULL", "$.note")))], "eq double, range_ double, present double, nulls double")
)
add("a1_correlation_cost", f"SELECT count(*) AS documents, (SELECT count(*) FROM i) AS elements, count(*) FILTER ({has(RETURNED + ' AND qty > 45')}) AS correlated, count(*) FILTER ({has(RETURNED)} AND {has('qty > 45')}) AS uncorrelated FROM d")(
    lambda s, d: (c := diagnostics.correlation_cost(order_docs(s, d), "$.items[*]", p("$.flag").eq("R") & p("$.qty").gt(45), p("$.items[*].flag").eq("R") & p("$.items[*].qty").gt(45))) and
    s.createDataFrame([(c.documents, c.elements, c.correlated, c.uncorrelated)], "documents long, elements long, correlated long, uncorrelated long")
)
add("a2_corpus_shape", "SELECT * FROM (SELECT '$' AS path, count(*) AS objects, 0::BIGINT AS arrays, NULL AS type FROM d UNION ALL SELECT '$.meta', count(*), 0, 'Order' FROM d UNION ALL SELECT '$.meta.inner', count(*), 0, 'Leaf' FROM d UNION ALL SELECT '$.tags', 0, count(*), NULL FROM d UNION ALL SELECT '$.items', 0, count(DISTINCT key), NULL FROM i UNION ALL SELECT '$.items[*]', count(*), 0, NULL FROM i)")(
    lambda s, d: diagnostics.corpus_shape(order_docs(s, d)).select("path", "objects", "arrays", F.try_element_at("types", F.lit(1))["value"].alias("type"))
)
add("a3_explode_cost")(lambda s, d: (x := diagnostics.explode_cost(order_docs(s, d), "$.items[*]")) and s.createDataFrame([(x["documents"], x["elements"], x["bytes"], x["whole"])], "documents long, elements long, bytes long, whole long"))
add("a4_text_bound_cost")(lambda s, d: diagnostics.text_bound_cost(table(s, d, "customer"), "c_name"))


@add("m1_keys", "SELECT key FROM d WHERE status = 'P'")
def m1_keys(s, d):
    return s.createDataFrame([(k,) for k in Query.where(p("$.status").eq("P")).keys(order_docs(s, d))], "key string")


def correlated_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: orders with one returned line of more than 45 pieces, with status, total and number of lines."""
    docs = Query.where(p("$.items[*]").elem_match(p("$.flag").eq("R") & p("$.qty").gt(45))).project(Projection.of("$.status", "$.total", "$.items")).on(order_docs(spark, sf_dir))
    return docs.select("key", V.string_value(F.col("`$.status`")).alias("status"), F.try_variant_get(F.col("`$.total`"), "$", "double").alias("total"), V.child_count(F.col("`$.items`")).alias("lines"))


add("q_correlated_returns", f"SELECT key, status, total, (SELECT count(*) FROM i WHERE i.key = d.key)::INT AS lines FROM d WHERE {has(RETURNED + ' AND qty > 45')}")(correlated_returns)
