import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from looseleaf.functions import variants as V
from looseleaf.functions.json_udf import read_json
from looseleaf.operators.predicates import FALSE, TRUE, And, ElemMatch, In, IsNull, Not, compile_predicate, matches, normalise, path, value_range
from looseleaf.operators.query import DOCUMENT, Projection, Query, row_json, with_prefix

DOCS = {
    "split": '{"items":[{"sku":"A","qty":1},{"sku":"B","qty":5}]}', "together": '{"items":[{"sku":"A","qty":5},{"sku":"B","qty":1}]}',
    "scalar": '{"items":"not-an-array"}', "absent": '{"other":1}', "text5": '{"items":[{"sku":"A","qty":"5"}],"n":null}',
    "big": '{"n":123456789012345678901234567890.5,"tags":["a","b",["c"]],"f":1e-3,"b":true,"neg":-12.50}',
    "deep": '{"n":1e2,"x":{"@type":"Q","y":[{"@type":"R","z":0.1}]}}', "empty": "{}", "list": "[1,2]", "number": "9223372036854775807",
}


@pytest.fixture(scope="module")
def docs(spark):
    V.configure(spark)
    return spark.createDataFrame(list(DOCS.items()), "key string, text string").select("key", V.strict_json(F.col("text")).alias("doc")).persist()


def check(docs, predicates):
    rows = docs.select("key", *[compile_predicate(p, "doc").alias(f"p{i}") for i, p in enumerate(predicates)]).collect()
    for r in rows:
        value = read_json(DOCS[r.key])
        for i, p in enumerate(predicates):
            assert r[f"p{i}"] == matches(p, value) == matches(normalise(p), value), (r.key, p)
    return [{r.key for r in rows if r[f"p{i}"]} for i in range(len(predicates))]


def test_correlation(docs):
    both = path("$.sku").eq("A") & path("$.qty").eq(5)
    apart = path("$.items[*].sku").eq("A") & path("$.items[*].qty").eq(5)
    one = path("$.items[*]").elem_match(both)
    got = check(docs, [one, apart, ~one])
    assert got[0] == {"together"} and got[1] == {"split", "together"} and got[2] == set(DOCS) - {"together"}


def test_exact_numbers_and_brackets(docs):
    n, neg = path("$.n"), path("$.neg")
    got = check(docs, [
        n.eq(Decimal("123456789012345678901234567890.5")), n.gt(Decimal("123456789012345678901234567890.4")), n.eq(100), n.lt(Decimal("100.0000000000000000000001")), n.exists(), n.is_null(),
        path("$.f").eq(0.001), path("$.f").lt(Decimal("0.00100000000000000000001")), path("$.b").eq(True), path("$.b").gt(False), neg.between(-13, -12.5), neg.lt(-12.49), neg.ge(0), neg.le(Decimal("-12.50")),
        path("$").eq(2**63 - 1), path("$").gt(Decimal(2**63 - 1) - Decimal("0.5")), path("$").lt(2**63), path("$[*]").eq(2), path("$.items").exists(), path("$.items[*].qty").eq("5"),
    ])
    assert got[0] == got[1] == {"big"} and got[2] == {"deep"} and got[5] == {"text5"} and got[9] == set() and got[18] == {"scalar"} and got[19] == {"text5"}


def test_descent(docs):
    got = check(docs, [path("$..z").eq(0.1), path('$..["@type"]').eq("R"), path("$..").elem_match(path('$["@type"]').eq("R") & path("$.z").eq(Decimal("0.1"))), path("$.x").elem_match(path("$..z").exists()), ~path("$..").elem_match(path("$..z").exists())])
    assert got[0] == got[1] == got[2] == got[3] == {"deep"}


def test_random_predicates(docs):
    rng = random.Random(5)
    paths = ["$.n", "$.items[*].qty", "$.items[*].sku", "$.tags[*]", "$.b", "$.missing", "$.x.y[*].z", "$"]
    values = ["", "A", "a", 0, 1, 5, 100, 0.1, Decimal("-12.5"), True, None]

    def some(depth):
        k = rng.randrange(9 if depth else 6)
        q = path(rng.choice(paths))
        v = rng.choice(values)
        if k < 2:
            return q.eq(v)
        if k == 2:
            return rng.choice([q.lt, q.le, q.gt, q.ge])(v)
        if k == 3:
            return q.one_of(*rng.sample(values, rng.randrange(4)))
        if k == 4:
            return q.exists()
        if k == 5:
            return q.is_null()
        if k == 6:
            return ~some(depth - 1)
        if k == 7:
            return rng.choice([lambda a, b: a & b, lambda a, b: a | b])(some(depth - 1), some(depth - 1))
        return path(rng.choice(["$.items[*]", "$.tags[*]", "$.x"])).elem_match(some(depth - 1))

    check(docs, [some(3) for _ in range(60)])


def test_normal_forms():
    a, b = path("$.a").eq(1), path("$.b").lt(2)
    assert normalise(~(a & b)) == normalise(~a | ~b) and normalise(a & (a & TRUE)) == a and normalise(a & FALSE) == FALSE and normalise(a | TRUE) == TRUE
    assert normalise(~~a) == a and isinstance(normalise(~b), Not)  # a comparison is never flipped
    assert normalise(path("$.a").one_of()) == FALSE and normalise(path("$.a").one_of(1, 1.0)) == a and isinstance(normalise(path("$.a").eq(None)), IsNull)
    assert normalise(path("$.a").lt(True)) == FALSE and normalise(path("$.a").gt(None)) == FALSE
    assert isinstance(path("$.a").one_of(1, "1"), In) and isinstance(path("$.a").between(1, 2), And) and isinstance(path("$.a[*]").elem_match(a), ElemMatch)
    assert [str(x) for x in (a & ~b & path("$.c[*]").elem_match(path("$.d").exists()) & a).paths()] == ["$.a", "$.b", "$.c[*]"]
    for bad in (float("nan"), float("inf"), b"x", object()):
        with pytest.raises(ValueError):
            path("$.a").eq(bad)


def test_one_value_range_differs_from_between(docs):
    q = path("$.items[*].qty").between(2, 4)
    one = docs.filter(value_range("$.items[*].qty", 2, 4).column("doc")).count()
    assert check(docs, [q])[0] == {"split", "together"} and one == 0
    with pytest.raises(ValueError):
        value_range("$.a", 1, "x").column("doc")


def test_queries(docs):
    rows = Query.where(path("$.items").exists() | path("$.n").exists()).project(Projection.of("$.n", '$["x"].y[0]')).range("b", "t").take(2).on(docs).collect()
    assert [r.key for r in rows] == ["big", "deep"] and rows[0]['$["x"].y[0]'] is None
    assert Query.where(TRUE).take(0).on(docs).count() == 0 and Query.where(TRUE).range("z", "a").on(docs).count() == 0
    assert [r.key for r in with_prefix(docs, "te").collect()] == ["text5"] and with_prefix(docs, "").count() == len(DOCS)
    for bad in ("$[*]", "$..a"):
        with pytest.raises(ValueError):
            Projection.of(bad)
    with pytest.raises(ValueError):
        Query().take(-1)
    pick = Projection.of("$.n", '$["@type"]')
    got = Query.where(path("$.n").exists()).project(pick).on(docs).select("key", row_json(pick).alias("j")).collect()
    assert {r.key: r.j for r in got}["text5"] == '{"$.n":null,"$[\\"@type\\"]":null}'
    assert Query.where(path("$.other").eq(1)).project(DOCUMENT).on(docs).select(row_json(DOCUMENT)).first()[0] == '{"other":1}'


def test_kinds_and_readers(spark):
    df = V.configure(spark).createDataFrame([(t,) for t in ("1", "1.0", "1e2", "1.5", '"a"', "null", "true", "[1]", '{"a":1}', "1e-30")], "t string").select("t", V.fast_json(F.col("t")).alias("v"))
    got = {r.t: r for r in df.select("t", V.kind(F.col("v")).alias("k"), V.long_value(F.col("v")).alias("n"), V.string_value(F.col("v")).alias("s"), V.child_count(F.col("v")).alias("c"), V.signature(F.col("v")).alias("sig")).collect()}
    assert [got[t].k for t in ("1", "1.0", "1e2", "1.5", '"a"', "null", "true", "[1]", '{"a":1}', "1e-30")] == ["INTEGER", "INTEGER", "INTEGER", "DECIMAL", "STRING", "NULL", "BOOLEAN", "ARRAY", "OBJECT", "DOUBLE"]
    assert got["1.0"].n == 1 and got['"a"'].n is None and got["1"].s is None and got["[1]"].c == 1
    assert got["1"].sig == got["1.0"].sig and got["null"].sig is None and got["[1]"].sig is None
