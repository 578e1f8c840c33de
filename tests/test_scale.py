"""Work that must not grow with the number of times that a value is mentioned."""

from pyspark.sql import functions as F

from looseleaf import queries as engine
from looseleaf.functions import variants as V
from looseleaf.operators.predicates import path
from looseleaf.operators.query import Query

SF = "/root/testdata/sf0.001"


def test_documents_are_built_once(spark):
    found = Query.where(path("$.score").eq(7) | path("$.note").exists()).on(engine.order_docs(spark, SF), ordered=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1 and plan.count("parseJson") == 1


def test_containers_are_told_without_their_schema(spark):
    texts = ["[]", "{}", '[{"a":1},{"a":"x"}]', '{"a":[1]}', "null", "1", '"x"', "true"]
    docs = V.configure(spark).createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", V.fast_json(F.col("t")).alias("v"))
    got = {r.t: (r.k, r.s) for r in docs.select("t", V.type_text(F.col("v")).alias("k"), V.is_scalar(F.col("v")).alias("s")).collect()}
    assert [got[t][0] for t in texts] == ["ARRAY", "OBJECT", "ARRAY", "OBJECT", "VOID", "BIGINT", "STRING", "BOOLEAN"]
    assert [got[t][1] for t in texts] == [False] * 4 + [True] * 4 and not got[None][1]


def test_schema_reads_documents_once(spark):
    from looseleaf.operators import schema as S

    seen = spark.sparkContext.accumulator(0)

    def text(i):
        seen.add(1)
        return None if i == 3 else f'{{"a":[{i},{i}.50,"x",null],"b":{{"c":1e300}}}}'

    docs = V.configure(spark).range(4).select(V.fast_json(F.udf(text, "string")("id")).alias("doc"))
    m = S.infer_schema(docs)
    assert seen.value == 4 and m.documents == 3
    a = m.get("$.a[*]")
    assert (a.observations, a.nulls, a.kinds, a.distinct, str(a.low), str(a.high)) == (12, 3, {"DECIMAL": 3, "INTEGER": 3, "NULL": 3, "STRING": 3}, 7, "0", "2.5")


def test_tally_counts_what_the_walk_reports(spark):
    from collections import Counter

    from looseleaf.functions import variant_bytes as B

    texts = ['{"a":[1,{"a":null,"b":[[]]}],"c":1.5,"d":1e300,"e":{},"t":"%s","f":[%s]}' % ("y" * 400, ",".join("1" * 300)), '[1,2,[3,["x"]]]', "5", "null", '{"a":{"a":{"a":[1,"z"]}}}', '{"a":[1,{"a":null,"b":[[]]}]}']
    docs = [(r.v.value, r.v.metadata) for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("parse_json(t) v").collect()]
    for depth, children in ((32, 65_536), (2, 3), (0, 9), (3, 1)):
        want, got = Counter(), Counter()
        for value, metadata in docs:
            for p, kind, x, size, cut in B.walk(value, metadata, depth, children):
                want.update({(p, kind, repr(x)): 1, (p, kind): size, (p, "cut"): int(cut)})
        for p, at in B.tally(docs, depth, children).everywhere():
            for kind, (n, size, cuts) in at.containers.items():
                got.update({(p, kind, "None"): n, (p, kind): size, (p, "cut"): cuts})
            for raw, n in at.scalars.items():
                kind, x, size = B.scalar(raw, 0)
                got.update({(p, kind, repr(x)): n, (p, kind): n * size})
        assert +got == +want, (depth, children)


def test_descendant_predicates_send_back_answers_only(spark):
    docs = V.configure(spark).createDataFrame([(1, '{"a":{"@type":"Leaf","name":"x","n":[1.50,null]}}'), (2, '{"b":[{"@type":"Leaf","name":"y"}],"name":"x"}'), (3, "[]"), (4, None)], "key int, t string")
    docs = docs.select("key", V.fast_json(F.col("t")).alias("doc"))
    cases = {
        path("$..").elem_match(path("$..n[*]").gt(1)): [1], path("$..").elem_match(path("$..name").eq("y") | path("$.none").exists()): [2],
        path("$..").elem_match(path('$["@type"]').eq("Leaf") & path("$.name").eq("x")): [1], path("$..name").eq("x"): [1, 2], ~path("$..name").exists(): [3, 4],
        path("$..n[*]").one_of(1.5, 7): [1], path("$..n[*]").is_null(): [1], path("$.b[*]").elem_match(path("$..name").eq("y")): [2],
    }
    for predicate, want in cases.items():
        found = Query.where(predicate).on(docs, ordered=False)
        assert sorted(r.key for r in found.collect()) == want, predicate
        assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString(), predicate


def test_wildcards_stay_in_the_jvm(spark):
    from looseleaf.functions.jsonpath import JsonPath

    texts = ['{"a":[1,{"b":2,"a":[3]},"x",[]],"é":{"z":1,"a":null},"\U0001f600":1,"￿":2}', "[]", "7", '{"a":{"a":[true]}}']
    docs = V.configure(spark).createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(V.fast_json(F.col("t")).alias("doc"))
    for text in ("$.*", "$[*]", "$.a[*]", "$.*.*", "$.a.*.a[0]"):
        p = JsonPath.compile(text)
        assert p.native, text
        a, b = docs.select(F.transform(p.column("doc"), lambda v: F.to_json(v))), docs.select(F.transform(p.nodes_column("doc"), lambda n: n["value"]))
        assert [r[0] or [] for r in a.collect()] == [r[0] or [] for r in b.collect()], text


def test_length_query_answers_with_texts_only(spark, tmp_path):
    """An order of 15 lines: `length` of its array is 15 as well, which the query's SQL doesn't ask for."""
    import duckdb

    for name, keep in (("orders", "o_orderkey < 8"), ("lineitem", "l_orderkey < 7")):
        df = spark.read.parquet(f"{SF}/{name}.parquet").filter(keep)
        if name == "lineitem":
            fifteen = df.limit(1).withColumn("l_orderkey", F.lit(7).cast("long")).withColumn("l_linenumber", F.explode(F.sequence(F.lit(1), F.lit(15))))
            df = df.unionByName(fifteen)
        else:
            df = df.withColumn("o_orderpriority", F.when(F.col("o_orderkey") == 7, "4-NOT SPECIFIED").otherwise(F.col("o_orderpriority")))
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(tuple(r) for r in engine.QUERIES["r11_length"](spark, str(tmp_path)).select("key", "pos", "value").collect())
    duck = duckdb.connect()
    for name in ("orders", "lineitem"):
        duck.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(duck.sql(f"select key, pos, value from ({engine.SQL['r11_length']})").fetchall()) and ("0000000007", 0, "4-NOT SPECIFIED") in got


def test_index_terms_take_a_value_once(spark):
    from looseleaf.operators import indexes

    text = '{"i":[{"a":1.50,"b":"x"},{"a":1.5,"b":"x"},{"a":null,"b":"x"},{"b":"x"},{"a":2,"b":"%s"}],"t":["%s","u",null,3]}' % ("y" * 600, "z" * 600)
    rows = V.configure(spark).createDataFrame([(b"k", 1, text)], "key binary, seq long, t string").select("key", "seq", V.fast_json(F.col("t")).alias("doc"))
    pairs = indexes.side_table(rows, indexes.composite("$.i[*]", "$.a", "$.b"))
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("schemaOfVariant") <= 2
    assert sorted((r.tag, r.term) for r in pairs.collect()) == [(9, "1\x1e1.5\x1f2\x1ex"), (9, "1\x1e2\x1f2\x1e" + "y" * 600)]
    terms = indexes.side_table(rows, indexes.inverted("$.t[*]"))
    assert sorted((r.tag, r.term) for r in terms.collect()) == [(-1, ""), (1, "3"), (2, "u")]
