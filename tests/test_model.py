import json
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from looseleaf.functions import variant_bytes
from looseleaf.functions import variants as V
from looseleaf.operators import bitmaps as B
from looseleaf.operators import schema as S
from looseleaf.operators.diagnostics import predicted_rate

ROWS = [{"a": i, "s": "x" * (i % 3), "m": i if i % 4 else str(i), "l": [i % 2, None], "o": {"d": i / 4}} for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    V.configure(spark)
    return spark.createDataFrame([(json.dumps(r),) for r in ROWS] + [(None,)], "t string").repartition(3).select(V.fast_json(F.col("t")).alias("doc"))


def test_statistics(docs):
    got = {r.path: r for r in S.path_statistics(docs).collect()}
    assert set(got) == {"$", "$.a", "$.s", "$.m", "$.l", "$.l[*]", "$.o", "$.o.d"}
    assert got["$.l[*]"].observations == 80 and got["$.l[*]"].nulls == 40 and got["$.a"].distinct == 40 and got["$.s"].distinct == 3
    assert got["$.a"].low == "0" and got["$.a"].high == "39" and got["$.s"]["first"] == "" and got["$.s"]["last"] == "xx" and got["$.o.d"].high == "9.75"
    assert {h.kind: h["count"] for h in got["$.m"].histogram} == dict(Counter("INTEGER" if i % 4 else "STRING" for i in range(40)))
    assert got["$.m"].dominant == "INTEGER" and got["$.m"].stability == 0.75
    assert got["$"].total_bytes >= got["$.a"].total_bytes + got["$.o"].total_bytes


def test_schema_and_advice(docs):
    m = S.infer_schema(docs)
    assert m.documents == 40 and m.get("$.l[*]").presence == 2.0 and m.get("$.l[*]").null_fraction == 0.5 and m.get("$.none") is None
    assert "$.l[*]" in [str(p) for p in m.required(1.0)] and "40 documents" in m.render()
    best = S.index_candidates(m)
    assert [c.score for c in best] == sorted((c.score for c in best), reverse=True) and "$.m" not in [str(c.path) for c in best]
    advice = {str(x.path): x for x in S.shredding_advice(m)}
    assert advice["$.m"].residual and not advice["$.a"].residual and "$.l[*]" not in advice
    assert S.selectivity(m, "EQ", "$.s") == pytest.approx(1 / 3) and S.selectivity(m, "EXISTS", "$.none", negated=True) == 1.0
    small = S.infer_schema(docs, budgets=S.Budgets(paths=3))
    assert len(small.paths) == 3 and small.overflow == 5


def test_text_bounds_widen():
    assert S.widened("abc", 64, True) == ("abc", True)
    low, high = S.widened("b" * 70, 64, False), S.widened("b" * 70, 64, True)
    assert low == ("b" * 64, False) and high == (b"b" * 63 + b"c", False)


def test_walk_and_sizes(spark):
    v = V.configure(spark).sql("""select parse_json('{"a":[1,2],"b":"x"}') v""").first().v
    nodes = list(variant_bytes.walk(v.value, v.metadata))
    assert [n[0] for n in nodes] == [(), ("a",), ("a", None), ("a", None), ("b",)] and nodes[0][3] == len(v.value) == variant_bytes.byte_size(v.value)
    big = spark.sql("""select parse_json(concat('{"k":"', repeat('y', 400), '","d":-12.50,"e":1e300,"i":300}')) v""").first().v
    got = {n[0]: (n[1], n[2]) for n in variant_bytes.walk(big.value, big.metadata)}
    assert got[("k",)] == ("STRING", "y" * 400) and got[("d",)][0] == "DECIMAL" and got[("e",)] == ("DOUBLE", 1e300) and got[("i",)] == ("INTEGER", 300)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(65_000, 70_000), st.integers(0, 2**32 - 1)), max_size=80), st.booleans())
def test_roaring_round_trip(numbers, run):
    members = sorted(set(numbers) | (set(range(100_000, 109_000)) if run else set(range(0, 20_000, 3))))
    data = B.encode_roaring(members)
    assert B.decode_roaring(data) == members
    with pytest.raises(ValueError):
        B.decode_roaring(data[:-1])
    with pytest.raises(ValueError):
        B.decode_roaring(data + b"\0")


def test_sets(spark):
    a, b = B.of(spark, [0, 1, 5, 70_000, 32_767, 32_768]), B.of(spark, [1, 70_000, 9, 32_768])
    members = lambda x: sorted(r.n for r in x.collect())
    assert members(B.intersection(a, b)) == [1, 32_768, 70_000] and members(B.and_not(a, b)) == [0, 5, 32_767] and members(B.xor(a, b)) == [0, 5, 9, 32_767]
    assert B.and_cardinality(a, b) == 3 and B.rank(a, 5) == 3 and B.select(a, 5) == 70_000 and B.select(a, 6) is None and list(B.cursor(a, 6)) == [32_767, 32_768, 70_000]
    assert B.first(B.of(spark, [])) is None and not B.intersects(a, B.of(spark, [])) and B.contains(a, 0)
    assert [tuple(r) for r in B.with_rank(a).orderBy("n").collect()] == [(0, 0), (1, 1), (5, 2), (32_767, 3), (32_768, 4), (70_000, 5)]


def test_predicted_rate():
    assert predicted_rate(1, 0.3, 0.4) == pytest.approx(0.0) and 0 < predicted_rate(4, 0.1, 0.1) < 1


def test_numbers_of_any_width(spark):
    numbers = [Decimal(x) for x in ("-1e300", "-12345678901234567890123456", "-1.57", "-1.5", "-2e-30", "0", "3e-30", "1", "1.05", "1.5", "15", "1700000000000", "99999999999999999999", "1234567890123456789012345", "1e300")]
    assert [S.rank_of(x) for x in numbers] == sorted(S.rank_of(x) for x in numbers)
    assert [Decimal(S.spelled_number(x)) for x in numbers] == numbers and S.rank_of(Decimal("1.50")) == S.rank_of(Decimal("1.5"))
    docs = spark.createDataFrame([('{"t":1700000000000,"b":1234567890123456789012345,"h":1e300}',), ('{"t":1700000000001,"b":7,"h":-1e300}',)], "t string").select(V.fast_json(F.col("t")).alias("doc"))
    m = S.infer_schema(docs)
    assert (m.get("$.t").low, m.get("$.t").high) == (1700000000000, 1700000000001) and m.get("$.b").high == 1234567890123456789012345
    assert (m.get("$.h").low, m.get("$.h").high) == (Decimal("-1e300"), Decimal("1e300"))
