"""Arrow-batched functions over JSON texts, for what Catalyst has no expression for: strictness, descent, whole predicates."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import AnyDescendant, AnyElement, CatalogPath, Field

MAX_DEPTH = 1000


class Number(str):
    """A number by its spelling, so that nothing is lost between reading and writing."""


#: A text as JSON spells it, as json.dumps(text, ensure_ascii=False) does.
_quoted = json.encoder.encode_basestring


class JsonError(ValueError):
    """A text that isn't strict JSON, with where it went wrong."""

    def __init__(self, message: str, offset: int, line: int, column: int):
        super().__init__(f"{message} at line {line}, column {column} (offset {offset})")
        self.offset, self.line, self.column = offset, line, column


def _no_constant(name: str):
    raise ValueError(f"{name} isn't JSON")


#: Of equal names the last wins. Made once, as making it costs more than reading a short text.
_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_no_constant)


def _plain(text: str) -> str:
    if text.startswith("\ufeff"):
        raise json.JSONDecodeError("a byte order mark stands before the value", text, 0)
    return text


def read_json(text: str, reject_duplicates: bool = False):
    """The value of exactly one strict JSON text, numbers as Number; JsonError otherwise."""

    def pairs(items):
        out = dict(items)
        if reject_duplicates and len(out) != len(items):
            raise ValueError("a field name stands twice")
        return out

    try:
        value = (json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_no_constant, object_pairs_hook=pairs) if reject_duplicates else _DECODER).decode(_plain(text))
    except json.JSONDecodeError as e:
        raise JsonError(e.msg, e.pos, e.lineno, e.colno) from None
    except (ValueError, RecursionError) as e:
        raise JsonError(str(e), 0, 1, 1) from None
    if "\\u" in text and re.search(r"\\u[dD][89a-fA-F]", text):
        try:
            write_json(value).encode()
        except UnicodeEncodeError:
            raise JsonError("lone surrogate", 0, 1, 1) from None
    if text.count("[") + text.count("{") >= MAX_DEPTH and _depth(value) > MAX_DEPTH:
        raise JsonError("nested too deeply", 0, 1, 1)
    return value


def _depth(value) -> int:
    deepest, todo = 0, [(value, 1)]
    while todo:
        v, d = todo.pop()
        deepest = max(deepest, d)
        todo += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return deepest


def write_json(value) -> str:
    """Compact JSON text, names in byte order, numbers as they were spelled."""
    if isinstance(value, str):
        return str(value) if isinstance(value, Number) else _quoted(value)
    if isinstance(value, dict):
        return "{" + ",".join([f"{_quoted(k)}:{write_json(value[k])}" for k in sorted(value)]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(write_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.BooleanType())
def is_strict_json(texts: pd.Series, reject: pd.Series) -> pd.Series:
    def ok(text, no_twins):
        try:
            read_json(text, bool(no_twins))
            return True
        except JsonError:
            return False

    return pd.Series([None if t is None else ok(t, r) for t, r in zip(texts, reject)], dtype=object)


def names_in_order(value: dict) -> list[str]:
    """Names in byte order, which is the order of their code points."""
    return sorted(value)


def values_at(value, path: CatalogPath) -> list:
    """What nodes_at() finds, without the locations; only repeated descents may arrive at a node twice."""
    now, descended = [value], False
    for step in path.steps:
        if isinstance(step, Field):
            name = step.name
            now = [v[name] for v in now if isinstance(v, dict) and name in v]
        elif isinstance(step, AnyElement):
            now = [x for v in now if isinstance(v, list) for x in v]
        elif descended:
            return [v for _, v in nodes_at(value, path)]
        else:
            following, descended = [], True
            for v in now:
                todo = [v]
                while todo:
                    x = todo.pop()
                    following.append(x)
                    if isinstance(x, dict):
                        todo += [x[k] for k in sorted(x, reverse=True)]
                    elif isinstance(x, list):
                        todo += reversed(x)
            now = following
    return now


def nodes_at(value, path: CatalogPath) -> list[tuple[tuple, object]]:
    """(location, value) of everything a shape arrives at, in document order; each node once."""
    now: list[tuple[tuple, object]] = [((), value)]
    for step in path.steps:
        following: list[tuple[tuple, object]] = []
        for at, v in now:
            if isinstance(step, Field):
                if isinstance(v, dict) and step.name in v:
                    following.append((at + (step.name,), v[step.name]))
            elif isinstance(step, AnyElement):
                if isinstance(v, list):
                    following += [(at + (i,), x) for i, x in enumerate(v)]
            elif isinstance(step, AnyDescendant):
                todo = [(at, v)]
                while todo:
                    a, x = todo.pop()
                    following.append((a, x))
                    if isinstance(x, dict):
                        todo += [(a + (k,), x[k]) for k in reversed(names_in_order(x))]
                    elif isinstance(x, list):
                        todo += [(a + (i,), x[i]) for i in range(len(x) - 1, -1, -1)]
        if path.descends:
            following = list(dict((a, (a, x)) for a, x in following).values())
        now = following
    return now


def map_json(function: Callable[[object], object], kind: T.DataType) -> Callable[[Column], Column]:
    """A Column function that applies `function` to the parsed document of each JSON text, null for null or no JSON."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else function(read_json(t)))
            except JsonError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


def descend(doc: Column, path: CatalogPath) -> Column:
    """Nodes at a shape with descendant steps, as an array of variants; each node once, in document order."""
    texts = map_json(lambda v: [write_json(x) for x in values_at(v, path)], T.ArrayType(T.StringType()))
    return F.transform(texts(F.to_json(doc)), lambda t: F.try_parse_json(t))
