import json

import pytest

from looseleaf.functions import iregexp
from looseleaf.functions.json_udf import JsonError, read_json, write_json
from looseleaf.functions.jsonpath import JsonPath, LimitExceeded, Limits
from looseleaf.functions.paths import PathError

DOC = read_json('{"a":[1,2,3,{"b":5}],"s":"ab","o":{"x":1.0,"y":[1,2]},"n":null,"t":[{"k":"aa","v":1},{"k":"b","v":100},{"v":1e2}]}')


def found(text):
    return [json.loads(write_json(v)) for v in JsonPath.compile(text).values(DOC)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("$.a[0]", [1]), ("$.a[-1].b", [5]), ("$.a[9]", []), ("$.a[0:2]", [1, 2]), ("$.a[::-2]", [{"b": 5}, 2]), ("$.a[0:3:0]", []),
        ("$['s','s']", ["ab", "ab"]), ("$..b", [5]), ("$.o.*", [1.0, [1, 2]]), ("$.t[?@.v == 100].v", [100, 1e2]), ("$.t[?@.k].v", [1, 100]),
        ("$.t[?!@.k].v", [1e2]), ("$.t[?@.k < 'b' || @.v == 1e2].v", [1, 100, 1e2]), ("$.t[?@.x == @.z].v", [1, 100, 1e2]), ("$.t[?@.k != 'aa'].v", [100, 1e2]),
        ("$[?length(@) == 2]", [{"x": 1.0, "y": [1, 2]}, "ab"]), ("$[?count(@.*) == 4]", [[1, 2, 3, {"b": 5}]]), ("$.t[?value(@..v) == 1].k", ["aa"]),
        ("$.t[?match(@.k, 'a+')].v", [1]), ("$.t[?search(@.k, '[ab]')].v", [1, 100]), ("$.t[?match(@.k, '(')].v", []), ("$[?@.x == $.a[0]].x", [1.0]),
        ("$.n", [None]), ("$.t[?@.k == 'aa' && @.v <= 1].v", [1]), ("$[?@ == null]", [None]), ("$[?@.y == $.o.y].x", [1.0]),
    ],
)
def test_values(text, want):
    assert found(text) == want


@pytest.mark.parametrize(
    "text",
    ["", "a", "$.", "$ ", "$..", "$[01]", "$[-0]", "$['a'", "$.a.", "$[?@.a]b", "$[?length(@.a)]", "$[?count(1)>0]", "$[?@[*]==1]", "$[?!@.a==1]", "$[?'a']", "$[?foo(@)]", "$[?length (@)==1]", "$. a", "$[?@.a==$[ 0]]", "$.@type", "$[9007199254740992]"],
)
def test_what_isnt_a_path(text):
    with pytest.raises(PathError):
        JsonPath.compile(text)


def test_locations_and_limits():
    assert [a for a, _ in JsonPath.compile("$.a[?@ > 1]").nodes(DOC)] == ["$['a'][1]", "$['a'][2]"]
    with pytest.raises(LimitExceeded):
        JsonPath.compile("$..*").values(DOC, Limits(produced=3))
    with pytest.raises(LimitExceeded):
        JsonPath.compile("$..b").values(DOC, Limits(visited=3))


def test_regexps():
    for pattern, text, whole, part in [("a.c", "abc", True, True), ("b", "abc", False, True), ("[^a-c]x{2,3}", "dxx", True, True), (r"\p{Lu}\P{L}", "A1", True, True), ("^a$", "a", True, True), ("(ab|c)*", "abcab", True, True), ("a.b", "a\nb", False, False)]:
        assert (iregexp.match(text, pattern), iregexp.search(text, pattern)) == (whole, part), pattern
    for bad in (r"\d", "(?=a)", r"(a)\1", "a{2,1}", "[b-a]", "a**", r"\$", "[]", "("):
        assert iregexp.compiled(bad) is None, bad
    assert not iregexp.match("a" * 3000 + "b", "(a*)*")
    assert iregexp.compiled("(" + "a{99}" * 10 + "){99}") is None


def test_strict_json():
    for bad in ("1 2", "01", "", "NaN", "[1,]", '"\\ud800"', "﻿1", '{"a":1', "[" * 1500 + "]" * 1500):
        with pytest.raises(JsonError):
            read_json(bad)
    assert write_json(read_json('{"b":1.50,"a":[true,null,"é"]}')) == '{"a":[true,null,"é"],"b":1.50}'
    with pytest.raises(JsonError):
        read_json('{"a":1,"a":2}', reject_duplicates=True)


def test_native_and_batched_agree(spark):
    from pyspark.sql import functions as F

    from looseleaf.functions import variants as V

    df = spark.createDataFrame([(write_json(DOC),), ("[]",), (None,)], "t string").select(V.fast_json(F.col("t")).alias("doc"))
    for text in ("$.a[0]", "$.a[-2]", "$.a[1:]", "$.a[-3:3]", "$.o['y'][0]", "$.t[0].k"):
        p = JsonPath.compile(text)
        assert p.native
        a = [r[0] for r in df.select(F.transform(p.column("doc"), lambda v: F.to_json(v))).collect()]
        b = [r[0] for r in df.select(F.transform(p.nodes_column("doc"), lambda n: n["value"])).collect()]
        assert [x or [] for x in a] == [x or [] for x in b], text
