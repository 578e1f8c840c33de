"""RFC 9535 JSONPath over documents.

`JsonPath.compile` checks grammar and well-typedness. Paths of names, indices, wildcards and plain slices
become Catalyst expressions (`column`); everything else runs batched over JSON texts (`nodes_column`). Limits on the
nodes visited and produced raise; they never cut an answer short.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property, lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import iregexp
from .json_udf import MAX_DEPTH, JsonError, Number, map_json, names_in_order, read_json, write_json
from .paths import PathError, _Reader, _spark_name, normalized_name, rfc_name_first, rfc_name_rest

SAFE = 2**53 - 1
MAX_SELECTORS, MAX_NESTING = 1024, 64


class LimitExceeded(RuntimeError):
    """More nodes than the limits allow; nothing is cut short silently."""


@dataclass(frozen=True)
class Limits:
    visited: int = 10_000_000
    produced: int = 1_000_000
    depth: int = 100_000


# --- syntax tree -----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Wildcard:
    pass


@dataclass(frozen=True)
class At:
    index: int


@dataclass(frozen=True)
class Slice:
    start: int | None
    end: int | None
    step: int


@dataclass(frozen=True)
class Filter:
    test: object


@dataclass(frozen=True)
class Segment:
    selectors: tuple
    descends: bool


@dataclass(frozen=True)
class SubQuery:
    relative: bool
    segments: tuple[Segment, ...]

    @cached_property
    def singular(self) -> bool:
        return all(not s.descends and len(s.selectors) == 1 and isinstance(s.selectors[0], (Name, At)) for s in self.segments)


    @cached_property
    def steps(self) -> tuple[tuple[bool, tuple[tuple[object, bool], ...]], ...] | None:
        """(descends, ((name, index or None for a wildcard; whether a name), ...)) of each segment; None with slices or filters."""
        if all(isinstance(x, (Name, Wildcard, At)) for s in self.segments for x in s.selectors):
            return tuple((s.descends, tuple((x.name if isinstance(x, Name) else x.index if isinstance(x, At) else None, isinstance(x, Name)) for x in s.selectors)) for s in self.segments)
        return None


@dataclass(frozen=True)
class Constant:
    value: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Comparison:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    parts: tuple


@dataclass(frozen=True)
class Test:
    what: object  # SubQuery or a logical Call


#: Parameters and result of each function: V value, N nodes, L logical.
FUNCTIONS = {"length": ("V", "V"), "count": ("N", "V"), "value": ("N", "V"), "match": ("VV", "L"), "search": ("VV", "L")}


class _Parser(_Reader):
    def __init__(self, text: str):
        super().__init__(text)
        self.selectors = 0

    def blanks(self) -> None:
        while self.peek() and self.peek() in " \t\n\r":
            self.at += 1

    def query(self) -> tuple[Segment, ...]:
        self.need("$")
        segments = self.segments(0)
        if self.more():
            self.fail("nothing may follow the path")
        return segments

    def segments(self, depth: int) -> tuple[Segment, ...]:
        out = []
        while True:
            before = self.at
            self.blanks()
            if self.take(".."):
                if self.peek() == "[":
                    out.append(Segment(self.bracket(depth), True))
                else:
                    out.append(Segment((self.shorthand(),), True))
            elif self.take("."):
                out.append(Segment((self.shorthand(),), False))
            elif self.peek() == "[":
                out.append(Segment(self.bracket(depth), False))
            else:
                self.at = before
                return tuple(out)

    def counted(self, selector):
        self.selectors += 1
        if self.selectors > MAX_SELECTORS:
            self.fail("too many selectors")
        return selector

    def shorthand(self):
        if self.take("*"):
            return self.counted(Wildcard())
        start = self.at
        if not rfc_name_first(self.peek()):
            self.fail("expected a name")
        while rfc_name_rest(self.peek()):
            self.at += 1
        return self.counted(Name(self.text[start : self.at]))

    def bracket(self, depth: int) -> tuple:
        if depth > MAX_NESTING:
            self.fail("nested too deeply")
        self.need("[")
        out = []
        while True:
            self.blanks()
            out.append(self.counted(self.selector(depth)))
            self.blanks()
            if self.take("]"):
                return tuple(out)
            self.need(",")

    def selector(self, depth: int):
        c = self.peek()
        if c and c in "'\"":
            return Name(self.rfc_quoted())
        if self.take("*"):
            return Wildcard()
        if self.take("?"):
            self.blanks()
            return Filter(self.logical_or(depth + 1))
        start = self.integer() if c == "-" or c.isdigit() else None
        before = self.at
        self.blanks()
        if not self.take(":"):
            self.at = before
            if start is None:
                self.fail("expected a selector")
            return At(start)
        self.blanks()
        end = self.integer() if self.peek() == "-" or self.peek().isdigit() else None
        before = self.at
        self.blanks()
        step = 1
        if self.take(":"):
            before = self.at
            self.blanks()
            if self.peek() == "-" or self.peek().isdigit():
                step = self.integer()
                before = self.at
        self.at = before
        return Slice(start, end, step)

    def integer(self) -> int:
        m = re.compile(r"0|-?[1-9][0-9]*").match(self.text, self.at)
        if not m or abs(int(m.group())) > SAFE:
            self.fail("not an index")
        self.at = m.end()
        if self.peek() and self.peek() in "0123456789":
            self.fail("leading zero")
        return int(m.group())

    # filters

    def logical_or(self, depth: int):
        if depth > MAX_NESTING:
            self.fail("nested too deeply")
        parts = [self.logical_and(depth)]
        while self.then("||"):
            parts.append(self.logical_and(depth))
        return parts[0] if len(parts) == 1 else Logic("or", tuple(parts))

    def then(self, op: str) -> bool:
        before = self.at
        self.blanks()
        if self.take(op):
            self.blanks()
            return True
        self.at = before
        return False

    def logical_and(self, depth: int):
        parts = [self.basic(depth)]
        while self.then("&&"):
            parts.append(self.basic(depth))
        return parts[0] if len(parts) == 1 else Logic("and", tuple(parts))

    def basic(self, depth: int):
        if self.peek() == "!" and self.text[self.at + 1 : self.at + 2] != "=":
            self.at += 1
            self.blanks()
            if self.peek() == "(":
                return Logic("not", (self.group(depth),))
            what = self.operand(depth)
            return Logic("not", (self.as_test(what),))
        if self.peek() == "(":
            return self.group(depth)
        began = self.at
        left = self.operand(depth)
        before = self.at
        self.blanks()
        for op in ("==", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                self.comparable(left, began)
                self.blanks()
                began = self.at
                right = self.operand(depth)
                self.comparable(right, began)
                return Comparison(op, left, right)
        self.at = before
        return self.as_test(left)

    def group(self, depth: int):
        self.need("(")
        self.blanks()
        inner = self.logical_or(depth + 1)
        self.blanks()
        self.need(")")
        return inner

    def as_test(self, what):
        if isinstance(what, SubQuery) or isinstance(what, Call) and FUNCTIONS[what.name][1] == "L":
            return Test(what)
        self.fail("a value alone is no test")

    def comparable(self, what, began: int) -> None:
        if isinstance(what, SubQuery):
            if not what.singular:
                self.fail("only singular queries compare")
            if re.search(r"\[[ \t\n\r]|(?<!['\"])[ \t\n\r]\]", self.text[began : self.at]) and not self._quoted_blank(began):
                self.fail("a singular query has no blanks inside brackets")
        elif isinstance(what, Call) and FUNCTIONS[what.name][1] != "V":
            self.fail("a logical function doesn't compare")

    def _quoted_blank(self, began: int) -> bool:
        bare = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", "''", self.text[began : self.at])
        return not re.search(r"\[[ \t\n\r]|[ \t\n\r]\]", bare)

    def operand(self, depth: int):
        c = self.peek()
        if c and c in "@$":
            self.at += 1
            return SubQuery(c == "@", self.segments(depth + 1))
        if c and c in "'\"":
            return Constant(self.rfc_quoted())
        m = re.compile(r"(?:-?(?:0|[1-9][0-9]*))(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?").match(self.text, self.at)
        if m:
            self.at = m.end()
            if self.peek() and self.peek() in "0123456789":
                self.fail("leading zero")
            return Constant(Number(m.group()))
        m = re.compile(r"[a-z][a-z0-9_]*").match(self.text, self.at)
        if not m:
            self.fail("expected a value")
        word = m.group()
        if self.text[m.end() : m.end() + 1] == "(":
            self.at = m.end() + 1
            return self.call(word, depth)
        if word in ("true", "false", "null"):
            self.at = m.end()
            return Constant({"true": True, "false": False, "null": None}[word])
        self.fail("unknown word")

    def call(self, name: str, depth: int):
        if depth > MAX_NESTING:
            self.fail("nested too deeply")
        if name not in FUNCTIONS:
            self.fail(f"no function {name}")
        args = []
        self.blanks()
        if not self.take(")"):
            while True:
                self.blanks()
                args.append(self.operand(depth + 1))
                self.blanks()
                if self.take(")"):
                    break
                self.need(",")
        types = FUNCTIONS[name][0]
        if len(args) != len(types):
            self.fail(f"{name} takes {len(types)} arguments")
        for want, arg in zip(types, args):
            query, call = isinstance(arg, SubQuery), isinstance(arg, Call)
            if want == "N" and not query or want == "V" and (query and not arg.singular or call and FUNCTIONS[arg.name][1] != "V"):
                self.fail(f"an argument of {name} has the wrong type")
        return Call(name, tuple(args))


# --- evaluation ------------------------------------------------------------------------------------------------------

class _Nothing:
    pass


NOTHING = _Nothing()


class _Run:
    def __init__(self, root, limits: Limits):
        self.root, self.limits, self.visited = root, limits, 0

    def visit(self, n: int = 1) -> None:
        self.visited += n
        if self.visited > self.limits.visited:
            raise LimitExceeded("too many nodes visited")

    def apply(self, nodes: list, segments: tuple[Segment, ...]) -> list:
        for s in segments:
            out: list = []
            for at, v in nodes:
                for a, x in self.below(at, v) if s.descends else ((at, v),):
                    for sel in s.selectors:
                        self.select(a, x, sel, out)
                        if len(out) > self.limits.produced:
                            raise LimitExceeded("too many nodes produced")
            nodes = out
        return nodes

    def below(self, at, v):
        todo = [(at, v)]
        while todo:
            a, x = todo.pop()
            self.visit()
            if len(a) > self.limits.depth:
                raise LimitExceeded("too deep")
            yield a, x
            todo += reversed(self.children(a, x))

    @staticmethod
    def children(at, v) -> list:
        if isinstance(v, dict):
            return [(at + (k,), v[k]) for k in names_in_order(v)]
        return [(at + (i,), x) for i, x in enumerate(v)] if isinstance(v, list) else []

    def select(self, at, v, sel, out: list) -> None:
        self.visit()
        if isinstance(sel, Name):
            if isinstance(v, dict) and sel.name in v:
                out.append((at + (sel.name,), v[sel.name]))
        elif isinstance(sel, Wildcard):
            out += self.children(at, v)
        elif isinstance(sel, At):
            if isinstance(v, list):
                i = sel.index + len(v) if sel.index < 0 else sel.index
                if 0 <= i < len(v):
                    out.append((at + (i,), v[i]))
        elif isinstance(sel, Slice):
            if isinstance(v, list) and sel.step:
                out += [(at + (i,), v[i]) for i in range(*slice(sel.start, sel.end, sel.step).indices(len(v)))]
        else:
            for a, x in self.children(at, v):
                self.visit()
                if self.true(sel.test, x):
                    out.append((a, x))

    def true(self, test, v) -> bool:
        if isinstance(test, Logic):
            if test.op == "not":
                return not self.true(test.parts[0], v)
            return (all if test.op == "and" else any)(self.true(p, v) for p in test.parts)
        if isinstance(test, Test):
            if isinstance(test.what, SubQuery):
                return bool(self.reach(test.what, v))
            a, b = (self.value(x, v) for x in test.what.args)
            if not _is_text(a) or not _is_text(b):
                return False
            return (iregexp.match if test.what.name == "match" else iregexp.search)(a, b)
        a, b = self.value(test.left, v), self.value(test.right, v)
        op = test.op
        if op == "==":
            return _equal(a, b)
        if op == "!=":
            return not _equal(a, b)
        if op in ("<=", ">="):
            return _equal(a, b) or (_less(a, b) if op == "<=" else _less(b, a))
        return _less(a, b) if op == "<" else _less(b, a)

    def nodes(self, q: SubQuery, v) -> list:
        return self.apply([((), v if q.relative else self.root)], q.segments)

    def reach(self, q: SubQuery, v) -> list:
        """Values of nodes() in any order, as a filter wants them: without locations, to count them or to take the only one."""
        steps = q.steps
        if steps is None or self.limits.depth < MAX_DEPTH:  # documents are no deeper
            return [x for _, x in self.nodes(q, v)]
        now = [v if q.relative else self.root]
        for descends, selectors in steps:
            if descends:
                now = list(now)
                for x in now:  # it grows meanwhile; what is counted or stands alone needs no order
                    if isinstance(x, dict):
                        now += x.values()
                    elif isinstance(x, list):
                        now += x
                self.visit(len(now))
            self.visit(len(now) * len(selectors))
            out: list = []
            for x in now:
                for key, is_name in selectors:
                    if is_name:
                        if isinstance(x, dict) and key in x:
                            out.append(x[key])
                    elif key is None:
                        if isinstance(x, dict):
                            out += x.values()
                        elif isinstance(x, list):
                            out += x
                    elif isinstance(x, list) and -len(x) <= key < len(x):
                        out.append(x[key])
            if len(out) > self.limits.produced:
                raise LimitExceeded("too many nodes produced")
            now = out
        return now

    def one(self, q: SubQuery, v):
        """The value of a singular query; NOTHING where there is none."""
        at = v if q.relative else self.root
        for s in q.segments:
            self.visit()
            sel = s.selectors[0]
            if isinstance(sel, Name):
                if not isinstance(at, dict) or sel.name not in at:
                    return NOTHING
                at = at[sel.name]
            else:
                if not isinstance(at, list) or not -len(at) <= sel.index < len(at):
                    return NOTHING
                at = at[sel.index]
            if self.limits.produced < 1:
                raise LimitExceeded("too many nodes produced")
        return at

    def value(self, x, v):
        if isinstance(x, Constant):
            return x.value
        if isinstance(x, SubQuery):
            if x.singular:
                return self.one(x, v)
            found = self.nodes(x, v)
            return found[0][1] if found else NOTHING
        if x.name == "count":
            return Number(len(self.reach(x.args[0], v)))
        if x.name == "value":
            found = self.reach(x.args[0], v)
            return found[0] if len(found) == 1 else NOTHING
        a = self.value(x.args[0], v)
        return Number(len(a)) if _is_text(a) or isinstance(a, (dict, list)) else NOTHING


def _is_text(v) -> bool:
    return isinstance(v, str) and not isinstance(v, Number)


_decimal = lru_cache(65_536)(Decimal)


def _equal(a, b) -> bool:
    if a is NOTHING or b is NOTHING:
        return a is b
    if isinstance(a, Number) and isinstance(b, Number):
        return a == b or _decimal(a) == _decimal(b)
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    return type(a) is type(b) and a == b


def _less(a, b) -> bool:
    if isinstance(a, Number) and isinstance(b, Number):
        return _decimal(a) < _decimal(b)
    if _is_text(a) and _is_text(b):
        return a.encode("utf-8", "surrogatepass") < b.encode("utf-8", "surrogatepass")
    return False


def location(at: tuple) -> str:
    return "$" + "".join(f"[{x}]" if isinstance(x, int) else normalized_name(x) for x in at)


NODE = T.StructType([T.StructField("location", T.StringType()), T.StructField("value", T.StringType())])


@dataclass(frozen=True)
class JsonPath:
    text: str
    segments: tuple[Segment, ...]

    @classmethod
    def compile(cls, text: str) -> "JsonPath":
        """The checked path; PathError (with the offset) for anything RFC 9535 doesn't allow."""
        return cls(text, _Parser(text).query())

    @property
    def singular(self) -> bool:
        return SubQuery(False, self.segments).singular

    def nodes(self, document, limits: Limits = Limits()) -> list[tuple[str, object]]:
        """(normalized location, value) of each node, in order, duplicates kept; `document` as read by json_udf.read_json."""
        return [(location(at), v) for at, v in _Run(document, limits).apply([((), document)], self.segments)]

    def values(self, document, limits: Limits = Limits()) -> list:
        return [v for _, v in _Run(document, limits).apply([((), document)], self.segments)]

    @property
    def native(self) -> bool:
        """Whether the values come from Catalyst expressions alone: names, wildcards, indices and slices without a step."""
        return all(
            not s.descends and len(s.selectors) == 1 and (isinstance(x := s.selectors[0], (Name, At, Wildcard)) or isinstance(x, Slice) and x.step == 1)
            for s in self.segments
        )

    def column(self, doc: Column | str, limits: Limits = Limits()) -> Column:
        """Values of the nodes as an array of variants."""
        doc = F.col(doc) if isinstance(doc, str) else doc
        if not self.native:
            texts = map_json(lambda v: [write_json(x) for x in self.values(v, limits)], T.ArrayType(T.StringType()))(F.to_json(doc))
            return F.transform(texts, lambda t: F.try_parse_json(t))
        at = F.array(doc)
        for s in self.segments:
            at = _step(at, s.selectors[0])
        return at

    def nodes_column(self, doc: Column | str, limits: Limits = Limits()) -> Column:
        """Array of (normalized location, JSON text) of the nodes, batched over Arrow; an error beyond the limits."""
        doc = F.col(doc) if isinstance(doc, str) else doc

        def run(v):
            return [{"location": a, "value": write_json(x)} for a, x in self.nodes(v, limits)]

        return map_json(run, T.ArrayType(NODE))(F.to_json(doc))


def _inside(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _step(at: Column, x) -> Column:
    """Values below an array of values that a name, index or slice selects."""
    if isinstance(x, Name):
        spelled = "$" + _spark_name(x.name)
        return F.filter(F.transform(at, lambda v: F.try_variant_get(v, spelled, "variant")), lambda v: v.isNotNull())
    if isinstance(x, At):
        least, place = (x.index, x.index + 1) if x.index >= 0 else (-x.index - 1, x.index)
        picked = F.transform(at, lambda v: F.when(F.size(_inside(v)) > least, F.try_element_at(_inside(v), F.lit(place))))
        return F.filter(picked, lambda v: v.isNotNull())
    if isinstance(x, Wildcard):
        return F.flatten(F.transform(at, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), _members(v), F.array().cast("array<variant>"))))
    return F.flatten(F.transform(at, lambda v: _part(_inside(v), x)))


def _members(v: Column) -> Column:
    """Values of an object in name order, null for other kinds; the map stands in an array so that it is made once."""
    maps = F.array(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.flatten(F.transform(maps, lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.element_at(m, k))))


def _part(array: Column, x: Slice) -> Column:
    n = F.size(array)
    edge = lambda i, default: F.lit(default) if i is None else F.least(n, F.lit(i)) if i >= 0 else F.greatest(n + i, F.lit(0))
    a = edge(x.start, 0)
    b = n if x.end is None else edge(x.end, 0)
    return F.slice(array, a + 1, F.greatest(b - a, F.lit(0)))


__all__ = ["JsonPath", "Limits", "LimitExceeded", "PathError", "JsonError", "read_json"]
