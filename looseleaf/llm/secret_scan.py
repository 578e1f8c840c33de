"""Secret scans with a recursive decoding worklist.

Every text is scanned for the base kinds. Encoded regions found in it (percent escapes, Unicode and hex
escapes, base64 tokens, compressed payloads) are unwrapped into child layers, which go on a worklist and are
scanned and unwrapped in turn until no new layer appears. A layer with
the content and place of an earlier one is not scanned again, so cycles end. Every character of a layer knows the span of the
root text it came from, so a secret found five layers down is reported at root offsets.

Payloads (gzip, zlib, raw deflate; compressed any number of times) are inflated a piece at a time: a piece ends at a blank and
the next one begins OVERLAP bytes before, so memory is bounded by PIECE and the longest stretch without a blank, and nothing
is too large to be scanned. All of a payload has its token's root span. Bytes that aren't text are decoded too, with U+FFFD
for what can't be: a secret beside binary bytes is found. UTF-16 is known by its mark or its zero bytes.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_right
from hashlib import blake2b
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SPAN, field, map_texts

#: Base kinds, in the order in which spans with one start are listed.
BASE_KINDS = ["assign", "access", "hex"]
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
# A failing run holds no shorter passing one, so a minimum length equals dropping short maximal runs.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6

_LINE = re.compile(r"[^\n]+")
_URL = re.compile(r"%[0-9A-Fa-f]{2}")
_UNI = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_URLS = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: A run of base64 signs (both alphabets), the marks that may part it from others, and one on a line of its own below.
MIN_TOKEN = 16
_RUN = re.compile(r"([A-Za-z0-9+/_-]{16,})={0,2}")
_MARK = re.compile(r"[+/_-]")
_NEXT = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/_-]+)(={0,2})(?=[\x20\t]*(?:\r?\n|\Z))")
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")
#: A text without any of these has neither a base span nor a layer to unwrap (RE2 syntax, run over whole batches).
_ANY = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|[A-Za-z0-9+/_-]{16}"

#: The same of bytes, as far as a layer of them could show something.
_ANY_BYTES = re.compile(_ANY.encode())
PIECE, OVERLAP = 1 << 20, 1 << 16


class Layer:
    """A decoded text with the root span `[starts[i], ends[i])` of each of its characters, or one `span` for all of them."""

    __slots__ = ("text", "starts", "ends", "path", "span")

    def __init__(self, text: str, starts, ends, path: str, span: tuple[int, int] | None = None):
        self.text, self.path, self.span = text, path, span
        self.starts, self.ends = (None, None) if starts is None else (array("q", starts), array("q", ends))

    def root(self, a: int, b: int) -> tuple[int, int]:
        return self.span or ((a, b) if self.starts is None else (min(self.starts[a:b]), max(self.ends[a:b])))

    def at(self, i: int) -> tuple[int, int]:
        return self.span or ((i, i + 1) if self.starts is None else (self.starts[i], self.ends[i]))


_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    found = [] if not any(w in low for w in _WORDS) else [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _bytes_to_layer(data: bytes, places: list[tuple[int, int]], path: str) -> Layer:
    """Bytes with their root places as a layer: UTF-16 where they look like it, else UTF-8 with U+FFFD for what isn't text."""
    code = _utf16(data)
    chars, starts, ends, k = [], [], [], 0
    for c in data.decode(code, "replace") if code else data.decode("utf-8", "surrogateescape"):
        n = len(c.encode(code)) if code else 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
        part = places[k : k + n] or places[-1:]
        starts.append(min(p[0] for p in part))
        ends.append(max(p[1] for p in part))
        chars.append(c)
        k += n
    return Layer(_readable("".join(chars)), starts, ends, path)


_UNREADABLE = {c: "\ufffd" for c in (*range(9), 11, 12, *range(14, 32), *range(0xD800, 0xE000))}


def _readable(text: str) -> str:
    return text.translate(_UNREADABLE)


def _utf16(data: bytes) -> str | None:
    """The UTF-16 order of bytes, by a mark in front or by zeros in every other one of the first; None for others."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if data[0] == 0xFF else "utf-16-be"
    head = data[: min(len(data) // 2 * 2, 64)]
    if len(head) < 8:
        return None
    for code, zeros, others in (("utf-16-le", head[1::2], head[::2]), ("utf-16-be", head[::2], head[1::2])):
        if zeros.count(0) >= 0.7 * len(zeros) and not others.count(0):
            return code
    return None


def _url_layer(layer: Layer, begin: int, end: int) -> Layer | None:
    """A line with each run of URL escapes decoded by itself; None if no escape is text.

    Bytes that aren't UTF-8 and control characters become U+FFFD; all else of the line stays.
    """
    text, i, known = layer.text, begin, False
    chars, starts, ends = [], [], []

    def plain(a, b):
        chars.extend(text[a:b])
        for k in range(a, b):
            x, y = layer.at(k)
            starts.append(x)
            ends.append(y)

    for e in _URLS.finditer(text, begin, end):
        plain(i, e.start())
        k = e.start()
        for c in bytes.fromhex(e.group().replace("%", "")).decode("utf-8", "surrogateescape"):
            stray = "\udc80" <= c <= "\udcff"
            n = 3 if stray else 3 * len(c.encode())
            x, y = layer.root(k, k + n)
            bad = stray or c < " " and c not in "\t\n\r"
            known |= not bad
            chars.append("\ufffd" if bad else c)
            starts.append(x)
            ends.append(y)
            k += n
        i = e.end()
    plain(i, end)
    return Layer("".join(chars), starts, ends, layer.path + "url>") if known else None


def _may_inflate(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0)


class Inflater:
    """Pieces of what a compressed byte stream inflates to; `good` says whether the stream came to its end, `used` its bytes."""

    def __init__(self, chunks, bits: int = 47):
        self.chunks, self.bits, self.good, self.used = chunks, bits, False, 0

    def __iter__(self):
        d = zlib.decompressobj(self.bits)
        for buf in self.chunks:
            self.used += len(buf)
            while True:
                try:
                    out = d.decompress(buf, PIECE)
                except zlib.error:
                    self.good = False
                    return
                if out:
                    yield out
                buf = d.unconsumed_tail
                if d.eof:
                    self.good = True
                    if self.bits == 47 and d.unused_data[:2] == b"\x1f\x8b":  # another member
                        buf, d = d.unused_data, zlib.decompressobj(47)
                        continue
                    self.used -= len(d.unused_data)
                    return
                if not buf and len(out) < PIECE:
                    break


def _payload(pieces, span: tuple[int, int], path: str):
    """Layers of an inflated payload: unwrapped further while it is compressed itself, then read a piece at a time."""
    met: set[bytes] = set()
    while True:
        head, pieces = b"", iter(pieces)
        for p in pieces:
            head += p
            if len(head) >= 8 * PIECE:
                break
        mark = blake2b(head, digest_size=16).digest()
        if mark in met:
            return  # it inflates to itself
        if not _may_inflate(head):
            break
        met.add(mark)
        following = iter(Inflater(chain([head], pieces)))
        first = next(following, None)
        if first is None:
            break  # only looked like it
        pieces = chain([first], following)
    carry, code = b"", None
    for p in chain([head], pieces):
        carry += p
        cut = max(carry.rfind(b" "), carry.rfind(b"\n"), carry.rfind(b"\t")) & ~1  # an even place, for UTF-16
        code = code or _utf16(carry)
        if len(carry) >= PIECE and cut > 2 * OVERLAP:
            yield Layer(_decoded_as(carry[:cut], code), None, None, path, span)
            carry = carry[cut - OVERLAP :]
    yield Layer(_decoded_as(carry, code), None, None, path, span)


def _decoded_as(data: bytes, code: str | None) -> str:
    return _readable(data.decode(code or "utf-8", "replace"))


def _text_bytes(data: bytes) -> int:
    """How many of the bytes are UTF-8 without control characters, up to the first that isn't."""
    control = _CONTROL.search(data)
    part = data[: control.start()] if control else data
    try:
        part.decode()
    except UnicodeDecodeError as e:
        return e.start
    return len(part)


def _is_text(data: bytes, whole: bool) -> bool:
    """Whether bytes are text; if not `whole`, the last character may be cut."""
    return _text_bytes(data) >= len(data) - (0 if whole else 3)


def _unwrap(layer: Layer):
    """Child layers of a layer."""
    text, path = layer.text, layer.path
    for line in _LINE.finditer(text) if "%" in text or "\\" in text else ():
        begin, end = line.span()
        if _URL.search(text, begin, end):
            if child := _url_layer(layer, begin, end):
                yield child
        if _UNI.search(text, begin, end):
            units, places, i = [], [], begin
            for e in [*_UNI.finditer(text, begin, end), None]:
                for k in range(i, e.start() if e else end):
                    units.append(text[k])
                    places.append(layer.at(k))
                if e:
                    i, code = e.end(), int(next(g for g in e.groups() if g), 16)
                    if 0xDC00 <= code < 0xE000 and units and "\ud800" <= units[-1] < "\udc00":
                        units[-1] = chr(0x10000 + ((ord(units[-1]) - 0xD800) << 10) + code - 0xDC00)
                        places[-1] = (places[-1][0], layer.root(*e.span())[1])
                    else:
                        units.append(chr(code) if code <= 0x10FFFF else "\ufffd")
                        places.append(layer.root(*e.span()))
            decoded = "".join("\ufffd" if "\ud800" <= c < "\ue000" else c for c in units)
            yield Layer(decoded, [p[0] for p in places], [p[1] for p in places], path + "unicode>")
    last = 0  # end of the wrapped block before
    for m in _RUN.finditer(text):
        places, edges, pad = list(range(*m.span(1))), [m.start(1), *(x.end() for x in _MARK.finditer(text, *m.span(1)))], m.end() - m.end(1)
        yield from _tokens(layer, places, [x - m.start(1) for x in edges], pad, False)
        if pad or m.start() < last:
            continue
        # Lines of equal width below it, the last of which may be shorter, are joined; the first may begin with other text.
        starts, width, after = [x - m.start(1) for x in edges], 0, _NEXT.match(text, m.end())
        while after and (not width or len(after[1]) <= width):
            width = width or len(after[1])
            starts.append(len(places))
            starts += [len(places) + x.end() - after.start(1) for x in _MARK.finditer(text, *after.span(1))]
            places += range(*after.span(1))
            last, pad = after.end(), len(after[2])
            if pad or len(after[1]) < width:
                break
            after = _NEXT.match(text, after.end())
        if last > m.end():
            yield from _tokens(layer, places, starts, pad, True)


def _tokens(layer: Layer, places: list[int], starts: list[int], pad: int, wrapped: bool):
    """Child layers of the base64 tokens in a run of characters, at `places` of the layer's text.

    A token begins at one of `starts` (the run's own, behind a mark, a line's) and ends at the next mark or line end that leaves
    it text, at best that of the run, where `pad` signs `=` follow. Of a wrapped run only tokens of more than one line count.
    What is left of a run behind its last token is decoded whole, in each of the four ways in which its starts lie, and kept
    where something could be found beside its other bytes.
    """
    text, path, n = layer.text, layer.path, len(places)
    run = "".join([text[p] for p in places])
    code = run.replace("-", "+").replace("_", "/")
    ends = sorted({n, *(x for x in starts if x), *(x - 1 for x in starts if x)})
    done, last = 0, None

    def root(a, b):
        return layer.root(places[a], places[b - 1] + 1 + (pad if b == n else 0))

    def decoded(start):
        size = n - start
        return base64.b64decode(code[start : n - (size % 4 == 1)] + "=" * (-(size - (size % 4 == 1)) % 4))

    def one_line(start, end):
        return wrapped and places[end - 1] - places[start] == end - 1 - start  # found where that line is looked at

    def mapped(part, start, end):
        at = [start + i // 3 * 4 + i % 3 for i in range(len(part))]
        return _bytes_to_layer(part, [root(a, min(a + 2, end)) for a in at], path + "base64>")

    for start in starts:
        if start < done or n - start < MIN_TOKEN:
            continue
        head = base64.b64decode(code[start : start + MIN_TOKEN])
        packed = _may_inflate(head)
        if not packed and not _is_text(head, False):
            if not _raw_deflate(code, start, n):
                continue
        data = decoded(start)
        if packed or not _is_text(head, False):
            inner = Inflater([data], 47 if packed else -15)
            pieces = iter(inner)
            first, more = next(pieces, None), next(pieces, None)
            sure = inner.good or more is not None or packed and data[0] == 0x1F
            if first is not None and sure and (packed or _is_text(first, False)):
                end = min(n, start + -(-inner.used * 4 // 3)) if more is None and inner.good and inner.used < len(data) else n
                if not one_line(start, end):
                    yield from _payload(chain([first], [] if more is None else [more], pieces), root(start, end), path + "base64>inflate>")
                done, last = end, start
                continue
        good = _text_bytes(data)
        top = n if good == len(data) else start + -(-good * 4 // 3)
        for k in range(bisect_right(ends, top) - 1, -1, -1):
            end = ends[k]
            if end - start < MIN_TOKEN:
                break
            token = run[start:end]
            if len(token) % 4 == 1:
                continue  # not a whole number of bytes
            part = data[: len(token) * 3 // 4]
            if not _is_text(part, True):
                continue
            done, last = end, start
            if not one_line(start, end):
                yield mapped(part, start, end)
            break
    rest = [x for x in starts if x >= done]
    if last is not None:  # bytes of the last token beyond what was text
        rest.insert(0, last + (done - last) // 4 * 4)
    for start in {x % 4: x for x in reversed(rest) if n - x >= MIN_TOKEN}.values():
        data = decoded(start)
        wide = _utf16(data)
        if (_ANY_BYTES.search(data.replace(b"\0", b"") if wide else data)) and not one_line(start, n):
            yield mapped(data, start, n)


def _raw_deflate(code: str, start: int, n: int) -> bool:
    """Whether bytes that carry no header begin as a deflate stream of text could (tried on the first of them)."""
    head = base64.b64decode(code[start : start + min((n - start) // 4 * 4, 256)])
    try:
        out = zlib.decompressobj(-15).decompress(head, 256)
    except zlib.error:
        return False
    return _is_text(out, False)


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text: base kinds of its own characters, and `layers>kind` for those inside decoded layers."""
    order = {k: i for i, k in enumerate(BASE_KINDS)}
    base = base_spans(text)
    plain = sorted((a, b) for _, a, b in base)
    begins, furthest = [a for a, _ in plain], list(accumulate((b for _, b in plain), max))
    found: dict[tuple[str, int, int], str] = {}  # (kind, start, end) in root offsets: the shallowest layers that show it
    seen = {_mark(text, (0, len(text)))}
    work = [_unwrap(Layer(text, None, None, ""))]  # the deepest layer's children first, so that few layers are held at once
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
            continue
        if not child.text or (mark := _mark(child.text, child.root(0, len(child.text)))) in seen:
            continue
        seen.add(mark)
        for kind, a, b in base_spans(child.text):
            at, name = child.root(a, b), child.path + kind
            # What the root text shows plainly, decoded along with its line, isn't added again.
            k = bisect_right(begins, at[0]) - 1
            if k < 0 or furthest[k] < at[1]:
                found[kind, *at] = min(found.get((kind, *at), name), name, key=lambda p: (p.count(">"), p))
        work.append(_unwrap(child))
    spans = base + [(name, a, b) for (_, a, b), name in found.items()]
    return sorted(spans, key=lambda s: (s[1], order.get(s[0], len(order)), s[0], s[2]))


def _mark(text: str, at: tuple[int, int]) -> bytes:
    """What tells a layer from all others: its content and the root span it came from."""
    return blake2b(text.encode() + repr(at).encode(), digest_size=16).digest()


def scan_secrets(df: DataFrame, id_cols: list[str] | None = None, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """`id_cols` of each row with the array of secret spans (kind, start, end) of its whole text.

    Offsets are code points of the row's text, end exclusive, sorted by start, then base kinds as listed, then
    name and end. Kinds found inside decoded layers carry the layers' names, such as `base64>url>assign`; their
    offsets cover the encoded characters that produced them. Payloads are scanned whole, whatever they inflate to. Null and
    empty texts: no spans. Repeated rows repeat; other columns are not read.
    """

    def start():
        def work(texts):
            hit = pa.compute.match_substring_regex(pa.array(texts, pa.binary()), _ANY).to_pylist()
            return {spans_col: [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t.decode())] if h else [] for t, h in zip(texts, hit)]}

        return work

    return map_texts(df, id_cols or ["doc_id"], text_col, T.StructType([field(spans_col, T.ArrayType(SPAN))]), start)


def redact_secrets(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`df` with each merged secret span of `text_col` replaced by `mask`; all columns and rows stay.

    Null texts stay null and texts without secrets stay as they are.
    """
    names = [c for c in df.columns if c != text_col]

    def start():
        def work(texts):
            hit = pa.compute.match_substring_regex(pa.array(texts, pa.binary()), _ANY).to_pylist()
            return {text_col: [_masked(t.decode(), mask) if h else None if t is None else t.decode() for t, h in zip(texts, hit)]}

        return work

    out = map_texts(df, names, text_col, T.StructType([field(text_col, T.StringType())]), start)
    return out.select(*[f"`{c}`" for c in df.columns])


def _masked(text: str, mask: str) -> str:
    out, last = [], 0
    for _, a, b in scan_text(text):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], mask]
        last = b
    return "".join([*out, text[last:]])
