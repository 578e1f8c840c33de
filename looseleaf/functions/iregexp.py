"""I-Regexp (RFC 9485): checked grammar, translated to a Python expression that takes the same strings.

The grammar has no back references or lookaround, so a set-of-states matcher decides in time linear in the text; nothing
that a document supplies can make a match backtrack.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

MAX_STATES = 10_000
MAX_DEPTH = 64
_ESCAPABLE = set("()*+-.?[\\]^{|}")
_CATEGORIES = {"L": "lmotu", "M": "cen", "N": "dlo", "P": "cdefios", "Z": "lps", "S": "ckmo", "C": "cfno"}


class RegexpError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise RegexpError("pattern ends early")
        self.at += 1
        return c

    def alternatives(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise RegexpError("nested too deeply")
        branches = [self.branch(depth)]
        while self.peek() == "|":
            self.at += 1
            branches.append(self.branch(depth))
        return ("or", branches)

    def branch(self, depth: int):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.piece(depth))
        return ("seq", parts)

    def piece(self, depth: int):
        atom = self.atom(depth)
        c = self.peek()
        if c and c in "*+?":
            self.at += 1
            return ("repeat", atom, *{"*": (0, None), "+": (1, None), "?": (0, 1)}[c])
        if c == "{":
            self.at += 1
            low = self.number()
            high: int | None = low
            if self.peek() == ",":
                self.at += 1
                high = self.number() if self.peek() != "}" else None
            if self.take() != "}" or high is not None and high < low:
                raise RegexpError("bad quantity")
            return ("repeat", atom, low, high)
        return atom

    def number(self) -> int:
        start = self.at
        while self.peek().isascii() and self.peek().isdigit():
            self.at += 1
        if start == self.at or self.at - start > 9:
            raise RegexpError("bad quantity")
        return int(self.text[start : self.at])

    def atom(self, depth: int):
        c = self.take()
        if c == "(":
            inner = self.alternatives(depth + 1)
            if self.take() != ")":
                raise RegexpError("unclosed group")
            return inner
        if c == ".":
            return ("char", lambda x: x not in "\n\r")
        if c == "^":
            return ("begin",)
        if c == "$":
            return ("end",)
        if c == "[":
            return ("char", self.klass())
        if c == "\\":
            return ("char", self.escaped())
        if c in "*+?{}])":
            raise RegexpError(f"{c} out of place")
        return ("char", lambda x, c=c: x == c)

    def escaped(self):
        c = self.take()
        if c in "pP":
            return self.category(c == "P")
        x = {"n": "\n", "r": "\r", "t": "\t"}.get(c) or (c if c in _ESCAPABLE else None)
        if x is None:
            raise RegexpError(f"\\{c} isn't an escape")
        return lambda y: y == x

    def category(self, negated: bool):
        if self.take() != "{":
            raise RegexpError("expected a category")
        name = ""
        while self.peek() not in ("", "}"):
            name += self.take()
        self.take()
        if not name or name[0] not in _CATEGORIES or len(name) > 2 or len(name) == 2 and name[1] not in _CATEGORIES[name[0]]:
            raise RegexpError(f"no category {name}")
        return lambda x: unicodedata.category(x).startswith(name) != negated

    def klass(self):
        negated = self.peek() == "^"
        self.at += negated
        tests = []
        first = True
        while True:
            c = self.take()
            if c == "]" and not first:
                break
            if c == "]" or c == "[":
                raise RegexpError(f"{c} out of place")
            if c == "-":
                if not first and self.peek() != "]":
                    raise RegexpError("- out of place")
                tests.append(lambda x: x == "-")
                first = False
                continue
            first = False
            if c == "\\" and self.peek() and self.peek() in "pP":
                tests.append(self.escaped())
                continue
            low = self.single(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.single(self.take())
                if high < low:
                    raise RegexpError("range out of order")
                tests.append(lambda x, a=low, b=high: a <= x <= b)
            else:
                tests.append(lambda x, a=low: x == a)
        if not tests:
            raise RegexpError("empty class")
        return lambda x: any(t(x) for t in tests) != negated

    def single(self, c: str) -> str:
        if c != "\\":
            if c in "[]":
                raise RegexpError(f"{c} out of place")
            return c
        e = self.take()
        x = {"n": "\n", "r": "\r", "t": "\t"}.get(e) or (e if e in _ESCAPABLE else None)
        if x is None:
            raise RegexpError(f"\\{e} isn't an escape")
        return x


class Program:
    """A Thompson automaton: `steps[s]` is a test with its next state, or free moves (with an optional anchor)."""

    def __init__(self, pattern: str):
        p = _Parser(pattern)
        tree = p.alternatives()
        if p.at != len(pattern):
            raise RegexpError(") out of place")
        self.tests: list = []
        self.free: list[list[tuple[int, str]]] = []
        self.start = self._new()
        self.final = self._build(tree, self.start)

    def _new(self) -> int:
        if len(self.tests) >= MAX_STATES:
            raise RegexpError("pattern too large")
        self.tests.append(None)
        self.free.append([])
        return len(self.tests) - 1

    def _build(self, node, at: int) -> int:
        what = node[0]
        if what == "char":
            end = self._new()
            self.tests[at] = (node[1], end)
            return end
        if what in ("begin", "end"):
            end = self._new()
            self.free[at].append((end, what))
            return end
        if what == "seq":
            for x in node[1]:
                at = self._build(x, self._hop(at))
            return at
        if what == "or":
            end = self._new()
            for x in node[1]:
                self.free[self._build(x, self._hop(at))].append((end, ""))
            return end
        _, atom, low, high = node
        for _ in range(low):
            at = self._build(atom, self._hop(at))
        if high is None:
            loop = self._hop(at)
            body = self._build(atom, self._hop(loop))
            self.free[body].append((loop, ""))
            return self._hop(loop)
        end = self._new()
        self.free[at].append((end, ""))
        for _ in range(high - low):
            at = self._build(atom, self._hop(at))
            self.free[at].append((end, ""))
        return end

    def _hop(self, at: int) -> int:
        end = self._new()
        self.free[at].append((end, ""))
        return end

    def _close(self, states: set[int], i: int, n: int) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t, anchor in self.free[todo.pop()]:
                if t not in out and (not anchor or (i == 0 if anchor == "begin" else i == n)):
                    out.add(t)
                    todo.append(t)
        return out

    def matches(self, text: str, whole: bool) -> bool:
        n = len(text)
        now = self._close({self.start}, 0, n)
        for i, c in enumerate(text):
            if not whole and self.final in now:
                return True
            following = {t[1] for t in (self.tests[s] for s in now) if t and t[0](c)}
            if not whole:
                following.add(self.start)
            if not following:
                return False
            now = self._close(following, i + 1, n)
        return self.final in now


@lru_cache(maxsize=512)
def compiled(pattern: str) -> Program | None:
    try:
        return Program(pattern)
    except RegexpError:
        return None


def match(text: str, pattern: str) -> bool:
    """Whether the whole text is taken; False for a pattern that isn't an I-Regexp."""
    p = compiled(pattern)
    return p is not None and p.matches(text, True)


def search(text: str, pattern: str) -> bool:
    p = compiled(pattern)
    return p is not None and p.matches(text, False)
