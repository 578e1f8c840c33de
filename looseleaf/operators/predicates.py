"""The predicate language: existential per leaf, document-level negation, type-bracketed comparison, correlated elemMatch.

A leaf asks whether *some* scalar at its path passes; `and` and `or` combine leaf answers, so two leaves over a path
with many values may be met by different values; `elem_match` asks for one node that passes the whole operand. `not_` is
the complement over documents. A comparison only sees values of its literal's family. Predicates compile to non-null
boolean Columns; leaves with descendant steps, on their path or in an elemMatch operand, are a batched function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_udf
from ..functions import variants as V
from ..functions.paths import AnyDescendant, AnyElement, CatalogPath, Field, VariantPath, _spark_name

Literal = str | bool | int | float | Decimal | None


def literal(x: Literal) -> Literal:
    """A literal of the language: text, number (as an exact decimal), boolean or null; ValueError for anything else."""
    if x is None or isinstance(x, (bool, str)):
        return x
    return V.number(x)


class Predicate:
    def __and__(self, other: "Predicate") -> "Predicate":
        return all_of(self, other)

    def __or__(self, other: "Predicate") -> "Predicate":
        return any_of(self, other)

    def __invert__(self) -> "Predicate":
        return not_(self)

    def paths(self) -> list[CatalogPath]:
        """Distinct document paths in first-seen order; those inside an elemMatch operand aren't document paths."""
        seen: dict[CatalogPath, None] = {}

        def walk(p: Predicate) -> None:
            if isinstance(p, (And, Or)):
                for q in p.parts:
                    walk(q)
            elif isinstance(p, Not):
                walk(p.part)
            elif not isinstance(p, Constant):
                seen.setdefault(p.path)

        walk(self)
        return list(seen)


@dataclass(frozen=True)
class Constant(Predicate):
    value: bool


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


@dataclass(frozen=True)
class Compare(Predicate):
    path: CatalogPath
    op: str  # = < <= > >=
    value: Literal


@dataclass(frozen=True)
class In(Predicate):
    path: CatalogPath
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Exists(Predicate):
    path: CatalogPath


@dataclass(frozen=True)
class IsNull(Predicate):
    path: CatalogPath


@dataclass(frozen=True)
class ElemMatch(Predicate):
    path: CatalogPath
    operand: Predicate


TRUE, FALSE = Constant(True), Constant(False)


class PathExpression:
    """`path("$.a").eq(1)` and the other leaves of a path."""

    def __init__(self, path: str | CatalogPath):
        self.path = CatalogPath.of(path)

    def eq(self, value: Literal) -> Predicate:
        return Compare(self.path, "=", literal(value))

    def lt(self, value: Literal) -> Predicate:
        return Compare(self.path, "<", literal(value))

    def le(self, value: Literal) -> Predicate:
        return Compare(self.path, "<=", literal(value))

    def gt(self, value: Literal) -> Predicate:
        return Compare(self.path, ">", literal(value))

    def ge(self, value: Literal) -> Predicate:
        return Compare(self.path, ">=", literal(value))

    def one_of(self, *values: Literal) -> Predicate:
        return In(self.path, _distinct(values))

    def between(self, low: Literal, high: Literal) -> Predicate:
        """`ge(low)` and `le(high)`: over a path with many values, two values may meet one bound each."""
        return all_of(self.ge(low), self.le(high))

    def exists(self) -> Predicate:
        return Exists(self.path)

    def is_null(self) -> Predicate:
        return IsNull(self.path)

    def elem_match(self, operand: Predicate) -> Predicate:
        return ElemMatch(self.path, operand)


def _distinct(values) -> tuple[Literal, ...]:
    seen: dict[tuple, Literal] = {}
    for v in map(literal, values):
        seen.setdefault((type(v).__name__, v), v)
    return tuple(seen.values())


def path(text: str | CatalogPath) -> PathExpression:
    return PathExpression(text)


def all_of(*parts: Predicate) -> Predicate:
    return And(tuple(parts))


def any_of(*parts: Predicate) -> Predicate:
    return Or(tuple(parts))


def not_(part: Predicate) -> Predicate:
    return Not(part)


def normalise(p: Predicate) -> Predicate:
    """Negations at the leaves (comparisons are never flipped), nested and/or flattened, constants folded, repeats dropped.

    Ranges on booleans and null are false, `in` of nothing is false and of one value is equality, equality with null is
    `is_null`. An elemMatch is a unit: its operand is normalised, but negation stays outside it.
    """
    if isinstance(p, Not):
        q = p.part
        if isinstance(q, Not):
            return normalise(q.part)
        if isinstance(q, And):
            return normalise(Or(tuple(Not(x) for x in q.parts)))
        if isinstance(q, Or):
            return normalise(And(tuple(Not(x) for x in q.parts)))
        q = normalise(q)
        if isinstance(q, Constant):
            return Constant(not q.value)
        return normalise(Not(q)) if isinstance(q, (And, Or, Not)) else Not(q)
    if isinstance(p, (And, Or)):
        zero, unit = (FALSE, TRUE) if isinstance(p, And) else (TRUE, FALSE)
        parts: dict[Predicate, None] = {}
        for x in map(normalise, p.parts):
            for y in x.parts if type(x) is type(p) else (x,):
                parts.setdefault(y)
        if zero in parts:
            return zero
        left = [x for x in parts if x != unit]
        return unit if not left else left[0] if len(left) == 1 else type(p)(tuple(left))
    if isinstance(p, Compare):
        if p.value is None:
            return IsNull(p.path) if p.op == "=" else FALSE
        return FALSE if isinstance(p.value, bool) and p.op != "=" else p
    if isinstance(p, In):
        if not p.values:
            return FALSE
        return normalise(Compare(p.path, "=", p.values[0])) if len(p.values) == 1 else p
    if isinstance(p, ElemMatch):
        inner = normalise(p.operand)
        return FALSE if inner == FALSE else ElemMatch(p.path, inner)
    return p


# --- compilation -----------------------------------------------------------------------------------------------------

def nodes(doc: Column, path: CatalogPath) -> Column:
    """Array of everything `path` arrives at in `doc`, containers included; one entry per occurrence, none for a mismatch."""
    if path.descends:
        return json_udf.descend(doc, path)
    at = F.array(doc)
    run: list[str] = []

    def flush(now: Column) -> Column:
        if not run:
            return now
        spelled = "$" + "".join(run)
        run.clear()
        return F.filter(F.transform(now, lambda x: F.try_variant_get(x, spelled, "variant")), lambda x: x.isNotNull())

    first = True
    for step in path.steps:
        if isinstance(step, Field):
            run.append(_spark_name(step.name))
            continue
        spelled = "$" + "".join(run)
        if first and isinstance(step, AnyElement):  # straight from the document, so that a scan can push it down
            run.clear()
            at = F.coalesce(F.try_variant_get(doc, spelled, "array<variant>"), F.array().cast("array<variant>"))
        else:
            at = F.flatten(F.transform(flush(at), lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))))
        first = False
    return flush(at)


def single(doc: Column, path: CatalogPath) -> Column:
    """The one node at a path of fields only; null where absent."""
    return F.try_variant_get(doc, "$" + "".join(_spark_name(s.name) for s in path.steps), "variant") if path.steps else doc


def _some(doc: Column, path: CatalogPath, test) -> Column:
    if path.multiple:
        return F.coalesce(F.exists(nodes(doc, path), test), F.lit(False))
    return F.coalesce(test(single(doc, path)), F.lit(False))


def value_test(op: str, value: Literal):
    """Test of one value against one literal, bracketed by the literal's family."""
    if value is None:
        return V.is_json_null
    if isinstance(value, bool):
        return lambda v: V.compare_boolean(v, value)
    if isinstance(value, str):
        return lambda v: V.compare_text(v, op, value)
    return lambda v: V.compare_number(v, op, value)


def compile_predicate(p: Predicate, doc: Column | str) -> Column:
    """The predicate over a variant column as a boolean Column that is never null."""
    return _compile(normalise(p), F.col(doc) if isinstance(doc, str) else doc)


def _compile(p: Predicate, doc: Column) -> Column:
    if isinstance(p, Constant):
        return F.lit(p.value)
    if not isinstance(p, (And, Or, Not)) and _descends(p):
        # Only the answer comes back, not the nodes: below a descent a node's text stands in that of all its ancestors.
        return F.coalesce(json_udf.map_json(matcher(p), T.BooleanType())(F.to_json(doc)), F.lit(False))
    if isinstance(p, (And, Or)):
        out = _compile(p.parts[0], doc)
        for x in p.parts[1:]:
            out = out & _compile(x, doc) if isinstance(p, And) else out | _compile(x, doc)
        return out
    if isinstance(p, Not):
        return ~_compile(p.part, doc)
    if isinstance(p, Compare):
        return _some(doc, p.path, value_test(p.op, p.value))
    if isinstance(p, In):
        tests = [value_test("=", v) for v in p.values]

        def one(v: Column) -> Column:
            out = tests[0](v)
            for t in tests[1:]:
                out = out | t(v)
            return out

        return _some(doc, p.path, one)
    if isinstance(p, Exists):
        return _some(doc, p.path, V.is_scalar)
    if isinstance(p, IsNull):
        return _some(doc, p.path, V.is_json_null)
    if isinstance(p, ElemMatch):
        if not p.path.multiple:
            at = single(doc, p.path)
            return F.coalesce(at.isNotNull() & _compile(p.operand, at), F.lit(False))
        return F.coalesce(F.exists(nodes(doc, p.path), lambda e: _compile(p.operand, e)), F.lit(False))
    raise TypeError(type(p))


def _descends(p: Predicate) -> bool:
    if isinstance(p, (And, Or)):
        return any(map(_descends, p.parts))
    if isinstance(p, Not):
        return _descends(p.part)
    if isinstance(p, Constant):
        return False
    return p.path.descends or isinstance(p, ElemMatch) and _descends(p.operand)


# --- one value, one test: the column form ----------------------------------------------------------------------------

@dataclass(frozen=True)
class ColumnTest:
    """A two-sided test that one value must pass as a whole (unlike `between`)."""

    path: CatalogPath
    low: Literal = None
    high: Literal = None
    low_open: bool = False
    high_open: bool = False

    def column(self, doc: Column | str) -> Column:
        doc = F.col(doc) if isinstance(doc, str) else doc
        low, high = literal(self.low), literal(self.high)
        if low is None and high is None:
            raise ValueError("a range needs a bound")
        if low is not None and high is not None and isinstance(low, str) != isinstance(high, str):
            raise ValueError("both bounds are of one family")

        def test(v: Column) -> Column:
            out = F.lit(True)
            if low is not None:
                out = out & value_test(">" if self.low_open else ">=", low)(v)
            if high is not None:
                out = out & value_test("<" if self.high_open else "<=", high)(v)
            return out

        return _some(doc, self.path, test)


def value_range(p: str | CatalogPath, low: Literal = None, high: Literal = None, low_open: bool = False, high_open: bool = False) -> ColumnTest:
    return ColumnTest(CatalogPath.of(p), low, high, low_open, high_open)


# --- plain evaluation, for the fallback and as a second opinion in tests -----------------------------------------------

def matches(p: Predicate, value: object) -> bool:
    """The predicate over one parsed document (numbers as json_udf.Number)."""
    if isinstance(p, Constant):
        return p.value
    if isinstance(p, And):
        return all(matches(x, value) for x in p.parts)
    if isinstance(p, Or):
        return any(matches(x, value) for x in p.parts)
    if isinstance(p, Not):
        return not matches(p.part, value)
    found = json_udf.values_at(value, p.path)
    if isinstance(p, ElemMatch):
        return any(matches(p.operand, v) for v in found)
    scalars = [v for v in found if not isinstance(v, (dict, list))]
    if isinstance(p, Exists):
        return bool(scalars)
    if isinstance(p, IsNull):
        return any(v is None for v in scalars)
    wanted = p.values if isinstance(p, In) else (p.value,)
    op = "=" if isinstance(p, In) else p.op
    return any(_passes(v, op, w) for v in scalars for w in wanted)


def matcher(p: Predicate) -> Callable[[object], bool]:
    """matches() of a predicate as a function of the parsed document, its shape looked at once and not for every node."""
    if isinstance(p, Constant):
        return lambda v: p.value
    if isinstance(p, Not):
        inner = matcher(p.part)
        return lambda v: not inner(v)
    if isinstance(p, (And, Or)):
        tests, stop = [matcher(x) for x in p.parts], isinstance(p, Or)

        def several(v) -> bool:
            for test in tests:
                if test(v) is stop:
                    return stop
            return not stop

        return several
    reach = _reach(p.path)
    if isinstance(p, ElemMatch):
        one = matcher(p.operand)
    elif isinstance(p, Exists):
        one = lambda v: not isinstance(v, (dict, list))
    elif isinstance(p, IsNull):
        one = lambda v: v is None
    else:
        wanted, op = (p.values, "=") if isinstance(p, In) else ((p.value,), p.op)
        if op == "=" and len(wanted) == 1 and isinstance(wanted[0], str):
            text = wanted[0]
            one = lambda v: v == text and type(v) is str
        else:
            one = lambda v: not isinstance(v, (dict, list)) and any(_passes(v, op, w) for w in wanted)

    def some(v) -> bool:
        for x in reach(v):
            if one(x):
                return True
        return False

    return some


def _reach(at: CatalogPath) -> Callable[[object], object]:
    """The values at a path, in any order; a node may come again behind a second descent."""
    if len(at.steps) == 1 and isinstance(at.steps[0], Field):
        name = at.steps[0].name
        return lambda v: (v[name],) if isinstance(v, dict) and name in v else ()

    def reach(value):
        now = [value]
        for step in at.steps:
            if isinstance(step, Field):
                now = [v[step.name] for v in now if isinstance(v, dict) and step.name in v]
            elif isinstance(step, AnyElement):
                now = [x for v in now if isinstance(v, list) for x in v]
            else:
                for v in now:  # it grows meanwhile
                    if isinstance(v, dict):
                        now += v.values()
                    elif isinstance(v, list):
                        now += v
        return now

    return reach


def _passes(v: object, op: str, w: Literal) -> bool:
    if w is None:
        return op == "=" and v is None
    if isinstance(w, bool):
        return op == "=" and isinstance(v, bool) and v == w
    if isinstance(w, str):
        if isinstance(v, json_udf.Number) or not isinstance(v, str):
            return False
        a, b = v.encode("utf-8", "surrogatepass"), w.encode("utf-8", "surrogatepass")
    else:
        if not isinstance(v, json_udf.Number):
            return False
        a, b = Decimal(v), w
    return {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


__all__ = [
    "TRUE", "FALSE", "And", "Or", "Not", "Compare", "In", "Exists", "IsNull", "ElemMatch", "Predicate", "path", "all_of", "any_of", "not_",
    "normalise", "compile_predicate", "value_range", "matches", "nodes", "single", "AnyDescendant", "VariantPath",
]
