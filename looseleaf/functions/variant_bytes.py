"""Reading the public Variant binary encoding: kinds, children and byte sizes of subtrees without building objects."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from decimal import Context, Decimal
from functools import lru_cache

_EXACT = Context(prec=60)
_INT = {3: (1, "b"), 4: (2, "<h"), 5: (4, "<i"), 6: (8, "<q")}
_FIXED = {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 4, 6: 8, 7: 8, 8: 5, 9: 9, 10: 17, 11: 4, 12: 8, 13: 8, 14: 4, 17: 8, 18: 8, 19: 8, 20: 16}
_KINDS = {0: "NULL", 1: "BOOLEAN", 2: "BOOLEAN", 7: "DOUBLE", 8: "DECIMAL", 9: "DECIMAL", 10: "DECIMAL", 11: "DATE", 12: "TIMESTAMP", 13: "TIMESTAMP", 14: "FLOAT", 15: "BINARY", 16: "STRING", 17: "TIME", 18: "TIMESTAMP", 19: "TIMESTAMP", 20: "UUID"}


@lru_cache(maxsize=4096)
def names(metadata: bytes) -> list[str]:
    """The dictionary of field names; documents of one shape share it."""
    size = (metadata[0] >> 6) + 1
    n = int.from_bytes(metadata[1 : 1 + size], "little")
    at = [int.from_bytes(metadata[1 + size * (1 + i) : 1 + size * (2 + i)], "little") for i in range(n + 1)]
    base = 1 + size * (2 + n)
    return [metadata[base + a : base + b].decode() for a, b in zip(at, at[1:])]


def children(value: bytes, at: int) -> tuple[str, list[tuple[int | None, int]], int]:
    """(OBJECT or ARRAY, [(name id or None, offset)], offset past the end) of a container."""
    head = value[at]
    info = head >> 2
    is_object = head & 3 == 2
    off_size = (info & 3) + 1
    id_size = (info >> 2 & 3) + 1 if is_object else 0
    size = 4 if info >> (4 if is_object else 2) & 1 else 1
    n = value[at + 1] if size == 1 else int.from_bytes(value[at + 1 : at + 5], "little")
    ids = at + 1 + size
    offs = ids + n * id_size
    base = offs + (n + 1) * off_size
    places = _numbers(value, offs, n + 1, off_size)
    labels = _numbers(value, ids, n, id_size) if is_object else [None] * n
    return ("OBJECT" if is_object else "ARRAY"), [(i, base + x) for i, x in zip(labels, places)], base + places[n]


def _numbers(value: bytes, at: int, n: int, size: int) -> list[int]:
    if size == 1:
        return list(value[at : at + n])
    if size in (2, 4):
        return list(struct.unpack_from(f"<{n}{'H' if size == 2 else 'I'}", value, at))
    return [int.from_bytes(value[at + 3 * i : at + 3 * i + 3], "little") for i in range(n)]


def scalar(value: bytes, at: int) -> tuple[str, object, int]:
    """(kind, Python value, byte size) of a scalar; whole decimals and doubles in the 64-bit range count as INTEGER."""
    head = value[at]
    if head & 3 == 1:
        n = head >> 2
        return "STRING", value[at + 1 : at + 1 + n].decode(), 1 + n
    t = head >> 2
    if t in _INT:
        n, form = _INT[t]
        return "INTEGER", struct.unpack_from(form, value, at + 1)[0], 1 + n
    if t in (15, 16):
        n = int.from_bytes(value[at + 1 : at + 5], "little")
        body = value[at + 5 : at + 5 + n]
        return _KINDS[t], body if t == 15 else body.decode(), 5 + n
    size = 1 + _FIXED[t]
    if t in (8, 9, 10):
        unscaled, scale = int.from_bytes(value[at + 2 : at + size], "little", signed=True), value[at + 1]
        whole, rest = divmod(unscaled, 10**scale)
        if not rest and -(2**63) <= whole < 2**63:
            return "INTEGER", whole, size
        return "DECIMAL", Decimal(unscaled).scaleb(-scale, _EXACT), size
    if t in (7, 14):
        d = struct.unpack_from("<d" if t == 7 else "<f", value, at + 1)[0]
        return ("INTEGER", int(d), size) if t == 7 and d == d and abs(d) < 2**63 and d == int(d) else (_KINDS[t], d, size)
    if t in (1, 2):
        return "BOOLEAN", t == 1, size
    return _KINDS.get(t, "OTHER"), None if t == 0 else value[at + 1 : at + size], size


def walk(value: bytes, metadata: bytes, max_depth: int = 1000, max_children: int = 1 << 30) -> Iterator[tuple[tuple, str, object, int, bool]]:
    """(collapsed path, kind, scalar or None, encoded bytes, cut) of every node, root included, in document order.

    A collapsed path holds field names, and None for any array element. `cut` says that a container has more children, or
    lies deeper, than the budgets let the walk follow; its own node is still reported.
    """
    words = names(bytes(metadata))
    todo: list[tuple[int, tuple]] = [(0, ())]
    while todo:
        at, path = todo.pop()
        if value[at] & 3 in (2, 3):
            kind, kids, end = children(value, at)
            cut = len(path) >= max_depth or len(kids) > max_children
            yield path, kind, None, end - at, cut
            if len(path) < max_depth:
                todo += [(a, path + ((words[i],) if i is not None else (None,))) for i, a in reversed(kids[:max_children])]
        else:
            kind, x, size = scalar(value, at)
            yield path, kind, x, size, False


#: Bytes of a scalar by its head; 0 where its length stands beside it.
_SIZES = [1 + (h >> 2) if h & 3 == 1 else 0 if h >> 2 in (15, 16) else 1 + _FIXED.get(h >> 2, 0) for h in range(256)]


class Tally:
    """What stands at one collapsed path: scalars by their encoding, containers by kind, and what lies below."""

    __slots__ = ("below", "containers", "layouts", "scalars")

    def __init__(self):
        self.below: dict[str | None, Tally] = {}
        self.scalars: dict[bytes, int] = {}
        self.containers: dict[str, list[int]] = {}  # nodes, bytes, nodes that the budgets cut
        self.layouts: dict[tuple, list[Tally]] = {}

    def child(self, name: str | None) -> "Tally":
        found = self.below.get(name)
        if found is None:
            found = self.below[name] = Tally()
        return found

    def everywhere(self) -> Iterator[tuple[tuple, "Tally"]]:
        """(collapsed path, tally) of this place and of all below it."""
        todo: list[tuple[tuple, Tally]] = [((), self)]
        while todo:
            path, at = todo.pop()
            yield path, at
            todo += [(path + (name,), x) for name, x in at.below.items()]


def tally(documents: Iterable[tuple[bytes, bytes]], max_depth: int = 1000, max_children: int = 1 << 30) -> Tally:
    """The nodes that walk() reports for all these (value, metadata), counted by place and encoding."""
    root, sizes = Tally(), _SIZES
    for value, metadata in documents:
        value, metadata = bytes(value), bytes(metadata)
        todo = [(0, root, 0)]
        while todo:
            at, place, depth = todo.pop()
            head = value[at]
            if not head & 2:
                size = sizes[head] or 5 + int.from_bytes(value[at + 1 : at + 5], "little")
                raw = value[at : at + size]
                place.scalars[raw] = place.scalars.get(raw, 0) + 1
                continue
            info = head >> 2
            is_object = head & 3 == 2
            off_size = (info & 3) + 1
            if info >> (4 if is_object else 2) & 1:
                n, ids = int.from_bytes(value[at + 1 : at + 5], "little"), at + 5
            else:
                n, ids = value[at + 1], at + 2
            offs = ids + n * ((info >> 2 & 3) + 1) if is_object else ids
            base = offs + (n + 1) * off_size
            places = _numbers(value, offs, n + 1, off_size)
            kind = "OBJECT" if is_object else "ARRAY"
            c = place.containers.get(kind)
            if c is None:
                c = place.containers[kind] = [0, 0, 0]
            c[0] += 1
            c[1] += base + places[n] - at
            if depth >= max_depth or n > max_children:
                c[2] += 1
                if depth >= max_depth:
                    continue
                n = max_children if n > max_children else n
            if is_object:
                key = (info, value[ids:offs], metadata)  # objects of one layout share their children's places
                layout = place.layouts.get(key)
                if layout is None:
                    words = names(metadata)
                    layout = [place.child(words[i]) for i in _numbers(value, ids, (offs - ids) // ((info >> 2 & 3) + 1), (info >> 2 & 3) + 1)]
                    if len(place.layouts) < 4096:
                        place.layouts[key] = layout
                below = zip(layout, places[:n])
            else:
                only = place.child(None) if n else None
                below = ((only, x) for x in places[:n])
            for x, off in below:
                a = base + off
                head = value[a]
                if head & 2:
                    todo.append((a, x, depth + 1))
                else:
                    size = sizes[head] or 5 + int.from_bytes(value[a + 1 : a + 5], "little")
                    raw = value[a : a + size]
                    counts = x.scalars
                    counts[raw] = counts.get(raw, 0) + 1
    return root


def byte_size(value: bytes) -> int:
    if value[0] & 3 in (2, 3):
        return children(value, 0)[2]
    return scalar(value, 0)[2]
