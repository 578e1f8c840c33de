"""Path grammars over JSON documents.

Two kinds of path exist. A *location* (`VariantPath`) names exactly one place: field names and array indices. A *shape*
(`CatalogPath`) names a set of places: fields, every array element (`[*]`), and descendants at any depth (`..`). Each has
its own spelling and an RFC 9535 spelling; the readers are strict about which one they take.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum
from functools import total_ordering


class PathError(ValueError):
    """A path that doesn't follow the grammar; `at` is the offset of the offence."""

    def __init__(self, message: str, at: int):
        super().__init__(f"{message} (at {at})")
        self.at = at


class Construct(Enum):
    """What a valid JSONPath may hold that a shape can't."""

    INDEX = "an array index"
    FILTER = "a filter"
    SLICE = "a slice"
    MULTIPLE_SELECTORS = "several selectors"


class NotRepresentable(ValueError):
    """A valid JSONPath that names no shape, with the construct that stands in the way."""

    def __init__(self, construct: Construct, at: int):
        super().__init__(f"{construct.value} names no document shape (at {at})")
        self.construct, self.at = construct, at


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Index:
    position: int


@dataclass(frozen=True)
class AnyElement:
    pass


@dataclass(frozen=True)
class AnyDescendant:
    pass


ANY_ELEMENT, ANY_DESCENDANT = AnyElement(), AnyDescendant()


def _ident(c: str) -> bool:
    return c == "_" or c.isalnum()


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, message: str):
        raise PathError(message, self.at)

    def more(self) -> bool:
        return self.at < len(self.text)

    def peek(self) -> str:
        return self.text[self.at] if self.more() else ""

    def take(self, s: str) -> bool:
        if self.text.startswith(s, self.at):
            self.at += len(s)
            return True
        return False

    def need(self, s: str) -> None:
        if not self.take(s):
            self.fail(f"expected {s!r}")

    def name(self) -> str:
        start = self.at
        while self.more() and _ident(self.peek()):
            self.at += 1
        if start == self.at:
            self.fail("expected a name")
        return self.text[start : self.at]

    def loose_quoted(self) -> str:
        """A name in double quotes in which a backslash makes the next character literal."""
        self.need('"')
        out = []
        while self.more() and self.peek() != '"':
            if self.take("\\") and not self.more():
                self.fail("nothing after the backslash")
            out.append(self.peek())
            self.at += 1
        self.need('"')
        return "".join(out)

    def digits(self, strict: bool = True) -> int:
        m = re.compile(r"0|[1-9][0-9]*" if strict else "[0-9]+").match(self.text, self.at)
        if not m:
            self.fail("expected an index")
        self.at = m.end()
        if int(m.group()) > 2**31 - 1:
            self.fail("index out of range")
        return int(m.group())

    def rfc_quoted(self) -> str:
        """An RFC 9535 string literal in either quote."""
        quote = self.peek()
        if quote not in ("'", '"'):
            self.fail("expected a quoted name")
        self.at += 1
        out = []
        while True:
            if not self.more():
                self.fail("unterminated name")
            c = self.peek()
            self.at += 1
            if c == quote:
                return "".join(out)
            if ord(c) < 0x20:
                self.fail("control character in a name")
            if 0xD800 <= ord(c) < 0xE000:
                self.fail("lone surrogate in a name")
            out.append(self.escape(quote) if c == "\\" else c)

    def escape(self, quote: str) -> str:
        c = self.peek()
        self.at += 1
        if c in "bfnrt/\\" and c:
            return {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}.get(c, c)
        if c == quote and c:
            return c
        if c != "u":
            self.fail("unknown escape")
        unit = self.unit()
        if 0xD800 <= unit < 0xDC00:
            if not self.take("\\u"):
                self.fail("high surrogate without a low one")
            low = self.unit()
            if not 0xDC00 <= low < 0xE000:
                self.fail("high surrogate without a low one")
            return chr(0x10000 + ((unit - 0xD800) << 10) + low - 0xDC00)
        if 0xDC00 <= unit < 0xE000:
            self.fail("low surrogate without a high one")
        return chr(unit)

    def unit(self) -> int:
        part = self.text[self.at : self.at + 4]
        if not re.fullmatch("[0-9A-Fa-f]{4}", part):
            self.fail("expected four hex digits")
        self.at += 4
        return int(part, 16)


def rfc_name_first(c: str) -> bool:
    return bool(c) and (c == "_" or "a" <= c <= "z" or "A" <= c <= "Z" or ord(c) >= 0x80 and not 0xD800 <= ord(c) < 0xE000)


def rfc_name_rest(c: str) -> bool:
    return rfc_name_first(c) or "0" <= c <= "9"


def normalized_name(name: str) -> str:
    """`['name']` as RFC 9535 section 2.7 spells it; lone surrogates are refused."""
    out = []
    short = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "'": "\\'", "\\": "\\\\"}
    for c in name:
        if 0xD800 <= ord(c) < 0xE000:
            raise ValueError("a lone surrogate has no normalized spelling")
        out.append(short.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 0x20 else c))
    return "['" + "".join(out) + "']"


def _plain(name: str) -> str:
    """A step in the own spelling: `.name` where the name allows it, else quoted."""
    if name and all(map(_ident, name)):
        return "." + name
    return '["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


@dataclass(frozen=True)
class VariantPath:
    """One location: a sequence of field names and array indices from the root."""

    steps: tuple[Field | Index, ...] = ()

    @classmethod
    def parse(cls, text: str) -> "VariantPath":
        r = _Reader(text)
        r.need("$")
        steps: list[Field | Index] = []
        while r.more():
            if r.take("."):
                steps.append(Field(r.name()))
            else:
                r.need("[")
                steps.append(Field(r.loose_quoted()) if r.peek() == '"' else Index(r.digits(False)))
                r.need("]")
        return cls(tuple(steps))

    @classmethod
    def parse_normalized(cls, text: str) -> "VariantPath":
        """The one spelling that RFC 9535 section 2.7 gives a location; anything else is refused."""
        r = _Reader(text)
        r.need("$")
        steps: list[Field | Index] = []
        while r.more():
            r.need("[")
            if r.peek() == "'":
                steps.append(Field(r.rfc_quoted()))
            else:
                steps.append(Index(r.digits()))
            r.need("]")
        out = cls(tuple(steps))
        if out.normalized() != text:
            raise PathError("not the normalized spelling", 0)
        return out

    @classmethod
    def parse_json_path(cls, text: str) -> "VariantPath | None":
        """A singular JSONPath (names in any RFC spelling, indices from 0), or None for every other text."""
        try:
            r = _Reader(text)
            r.need("$")
            steps: list[Field | Index] = []
            while r.more():
                if r.take("."):
                    start = r.at
                    if not rfc_name_first(r.peek()):
                        return None
                    while rfc_name_rest(r.peek()):
                        r.at += 1
                    steps.append(Field(text[start : r.at]))
                else:
                    r.need("[")
                    _blanks(r)
                    steps.append(Field(r.rfc_quoted()) if r.peek() in ("'", '"') else Index(r.digits()))
                    _blanks(r)
                    r.need("]")
            return cls(tuple(steps))
        except PathError:
            return None

    def normalized(self) -> str:
        return "$" + "".join(normalized_name(s.name) if isinstance(s, Field) else f"[{s.position}]" for s in self.steps)

    def __str__(self) -> str:
        return "$" + "".join(_plain(s.name) if isinstance(s, Field) else f"[{s.position}]" for s in self.steps)

    def __add__(self, other: "VariantPath") -> "VariantPath":
        return VariantPath(self.steps + other.steps)

    def starts_with(self, other: "VariantPath") -> bool:
        return self.steps[: len(other.steps)] == other.steps

    @property
    def depth(self) -> int:
        return len(self.steps)

    def spark(self) -> str:
        """The location as variant_get spells it."""
        return "$" + "".join(f"[{s.position}]" if isinstance(s, Index) else _spark_name(s.name) for s in self.steps)


def _spark_name(name: str) -> str:
    if "'" not in name:
        return f"['{name}']"
    if '"' not in name:
        return f'["{name}"]'
    raise PathError("variant_get has no spelling for a name with both quotes", 0)


def _blanks(r: _Reader) -> None:
    while r.peek() and r.peek() in " \t\n\r":
        r.at += 1


@total_ordering
@dataclass(frozen=True)
class CatalogPath:
    """A set of locations: fields, every element of an array, and descendants at any depth (zero levels included)."""

    steps: tuple[Field | AnyElement | AnyDescendant, ...] = ()

    def __post_init__(self):
        if any(isinstance(a, AnyDescendant) and isinstance(b, AnyDescendant) for a, b in zip(self.steps, self.steps[1:])):
            raise PathError("two descendant steps in a row", 0)

    @classmethod
    def of(cls, path: "str | CatalogPath") -> "CatalogPath":
        return path if isinstance(path, CatalogPath) else cls.parse(path)

    @classmethod
    def parse(cls, text: str) -> "CatalogPath":
        r = _Reader(text)
        r.need("$")
        steps: list = []
        while r.more():
            if r.take(".."):
                if steps and steps[-1] == ANY_DESCENDANT:
                    r.fail("two descendant steps in a row")
                steps.append(ANY_DESCENDANT)
                if r.more() and _ident(r.peek()):
                    steps.append(Field(r.name()))
                elif r.peek() not in ("", "["):
                    r.fail("expected a name")
            elif r.take("."):
                steps.append(Field(r.name()))
            else:
                r.need("[")
                if r.take("*"):
                    steps.append(ANY_ELEMENT)
                elif r.peek() == '"':
                    steps.append(Field(r.loose_quoted()))
                else:
                    r.fail("a shape has [*] or a quoted name here")
                r.need("]")
        return cls(tuple(steps))

    @classmethod
    def parse_json_path(cls, text: str) -> "CatalogPath":
        """The shape that an RFC 9535 spelling names; NotRepresentable for valid paths that name none.

        `[*]`, `.*` and `[:]` are read as every array element, `..*` as descendants' elements. Blanks may stand inside
        brackets only.
        """
        r = _Reader(text)
        r.need("$")
        steps: list = []
        while r.more():
            if r.take(".."):
                if steps and steps[-1] == ANY_DESCENDANT:
                    r.fail("two descendant steps in a row")
                steps.append(ANY_DESCENDANT)
                if r.peek() == "[":
                    steps.append(cls._bracket(r))
                elif r.take("*"):
                    steps.append(ANY_ELEMENT)
                else:
                    steps.append(Field(cls._shorthand(r)))
            elif r.take("."):
                steps.append(ANY_ELEMENT if r.take("*") else Field(cls._shorthand(r)))
            else:
                steps.append(cls._bracket(r))
        return cls(tuple(steps))

    @staticmethod
    def _shorthand(r: _Reader) -> str:
        start = r.at
        if not rfc_name_first(r.peek()):
            r.fail("expected a name")
        while rfc_name_rest(r.peek()):
            r.at += 1
        return r.text[start : r.at]

    @staticmethod
    def _bracket(r: _Reader) -> "Field | AnyElement":
        opened = r.at
        r.need("[")
        _blanks(r)
        c = r.peek()
        if c == "?":
            raise NotRepresentable(Construct.FILTER, opened)
        if c in ("'", '"') and c:
            step: Field | AnyElement = Field(r.rfc_quoted())
        elif r.take("*"):
            step = ANY_ELEMENT
        elif m := re.compile(r"(-?[0-9]*)[ \t\n\r]*(:[ \t\n\r]*-?[0-9]*[ \t\n\r]*(?::[ \t\n\r]*-?[0-9]*)?)?").match(r.text, r.at):
            if m.group(2) is None:
                if not m.group(1):
                    r.fail("expected a selector")
                raise NotRepresentable(Construct.INDEX, opened)
            if not re.fullmatch(r"[\s:]*(?:1)?", m.group(0)) or re.search("[0-9]", re.split(":", m.group(0) + "::")[0] + re.split(":", m.group(0) + "::")[1]):
                raise NotRepresentable(Construct.SLICE, opened)
            r.at = m.end()
            step = ANY_ELEMENT
        _blanks(r)
        if r.peek() == ",":
            raise NotRepresentable(Construct.MULTIPLE_SELECTORS, opened)
        r.need("]")
        return step

    def __str__(self) -> str:
        out = ["$"]
        after = False
        for s in self.steps:
            if isinstance(s, AnyDescendant):
                out.append("..")
            elif isinstance(s, AnyElement):
                out.append("[*]")
            else:
                spelled = _plain(s.name)
                out.append(spelled[1:] if after and spelled[0] == "." else spelled)
            after = isinstance(s, AnyDescendant)
        return "".join(out)

    def to_json_path(self) -> str:
        """RFC 9535 spelling, every element as `[:]`; a trailing descendant step has none."""
        if self.steps and isinstance(self.steps[-1], AnyDescendant):
            raise ValueError("a trailing descendant step has no JSONPath spelling")
        out = ["$"]
        for s in self.steps:
            if isinstance(s, AnyDescendant):
                out.append("..")
            elif isinstance(s, AnyElement):
                out.append("[:]")
            else:
                body = "".join("\\'" if c == "'" else "\\\\" if c == "\\" else f"\\u{ord(c):04x}" if ord(c) < 0x20 else c for c in s.name)
                out.append(f"['{body}']")
        return "".join(out)

    def __add__(self, other: "CatalogPath") -> "CatalogPath":
        return CatalogPath(self.steps + other.steps)

    def starts_with(self, other: "CatalogPath") -> bool:
        return self.steps[: len(other.steps)] == other.steps

    def __lt__(self, other: "CatalogPath") -> bool:
        return self.rank() < other.rank()

    def rank(self) -> tuple:
        kind = {Field: 0, AnyElement: 1, AnyDescendant: 2}
        return tuple((kind[type(s)], s.name.encode("utf-8", "surrogatepass") if isinstance(s, Field) else b"") for s in self.steps)

    @property
    def depth(self) -> int:
        return len(self.steps)

    @property
    def multiple(self) -> bool:
        return any(not isinstance(s, Field) for s in self.steps)

    @property
    def descends(self) -> bool:
        return any(isinstance(s, AnyDescendant) for s in self.steps)
