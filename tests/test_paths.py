import pytest

from looseleaf.functions.paths import (
    ANY_DESCENDANT, ANY_ELEMENT, CatalogPath, Construct, Field, Index, NotRepresentable, PathError, VariantPath,
)


def test_locations_round_trip():
    for text in ("$", "$.a", "$.a[0].b", '$["a b"][12]', '$["q\\"x"]', "$.données"):
        assert str(VariantPath.parse(text)) == text
    assert VariantPath.parse("$.a[3]").steps == (Field("a"), Index(3))
    for bad in ("", "a", "$.", "$[", "$[-1]", "$['a']", "$.a b", "$[*]", '$["a]'):
        with pytest.raises(PathError):
            VariantPath.parse(bad)


def test_normalized_spelling_is_the_only_one():
    assert VariantPath.parse_normalized("$['a'][0]['it\\'s']").steps == (Field("a"), Index(0), Field("it's"))
    for bad in ("$.a", '$["a"]', "$[ 'a']", "$[00]", "$['\\u0041']", "$['a\\/b']"):
        with pytest.raises(PathError):
            VariantPath.parse_normalized(bad)
    assert VariantPath((Field("a\n\x01'"), Index(2))).normalized() == "$['a\\n\\u0001\\''][2]"


def test_singular_json_paths_or_none():
    assert VariantPath.parse_json_path("$.a['b'][ 1 ]").steps == (Field("a"), Field("b"), Index(1))
    for other in ("$..a", "$[*]", "$[-1]", "$[1:2]", "$.a,b", "", "$[?@.a]"):
        assert VariantPath.parse_json_path(other) is None


def test_shapes():
    assert CatalogPath.parse("$.items[*].sku").steps == (Field("items"), ANY_ELEMENT, Field("sku"))
    assert CatalogPath.parse("$..name").steps == (ANY_DESCENDANT, Field("name"))
    assert CatalogPath.parse("$..").steps == (ANY_DESCENDANT,)
    assert str(CatalogPath.parse('$..["@type"]')) == '$..["@type"]'
    for bad in ("$[0]", "$....a", "$['a']", "$.*"):
        with pytest.raises(PathError):
            CatalogPath.parse(bad)
    with pytest.raises(PathError):
        CatalogPath((ANY_DESCENDANT, ANY_DESCENDANT))


def test_shapes_from_json_paths():
    assert CatalogPath.parse_json_path("$.a[*]['b'].*[:]").steps == (Field("a"), ANY_ELEMENT, Field("b"), ANY_ELEMENT, ANY_ELEMENT)
    assert CatalogPath.parse_json_path("$..*").steps == (ANY_DESCENDANT, ANY_ELEMENT)
    for text, construct in (("$[0]", Construct.INDEX), ("$[?@.a]", Construct.FILTER), ("$[1:2]", Construct.SLICE), ("$['a','b']", Construct.MULTIPLE_SELECTORS)):
        with pytest.raises(NotRepresentable) as e:
            CatalogPath.parse_json_path(text)
        assert e.value.construct is construct
    with pytest.raises(PathError):
        CatalogPath.parse_json_path("$ .a")
    assert CatalogPath.parse("$.a[*]").to_json_path() == "$['a'][:]"
    with pytest.raises(ValueError):
        CatalogPath.parse("$..").to_json_path()


def test_order_of_shapes():
    paths = [CatalogPath.parse(t) for t in ("$..", "$[*]", "$.b", "$.a.c", "$.a", "$")]
    assert [str(p) for p in sorted(paths)] == ["$", "$.a", "$.a.c", "$.b", "$[*]", "$.."]
    assert CatalogPath.parse("$.a.b").starts_with(CatalogPath.parse("$.a"))
