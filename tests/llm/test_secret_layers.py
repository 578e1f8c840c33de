"""Layers of secret scans that stand beside stray, binary, prefixed or wrapped content."""

import base64
import gzip
import zlib

import pytest

from looseleaf.llm import secret_scan


def hidden(text, *secrets):
    """Whether the mask takes away what encodes each secret, and the spans."""
    spans = secret_scan.scan_text(text)
    return spans, secret_scan._masked(text, "[S]")


@pytest.mark.parametrize("stray", ["caf%E9 ... ", "rose 20%decline; ", "a%00b ", "%C3 %A9 ", "%ff%fe", "\x01 "])
def test_stray_escapes_leave_the_rest_of_a_line(stray):
    text = stray + "password%3Dhunter2hunter2 é"
    spans, masked = hidden(text)
    assert ("url>assign", len(stray), len(text) - 2) in spans and masked == stray + "[S] é"


def test_url_places():
    text = "%E9%C3%A9%F0%9F%98%80 %73ecret%3D%61bcdefg%E9%20x"
    spans, _ = hidden(text)
    a = text.index("%73")
    assert spans == [("url>assign", a, text.index("%E9%20"))]
    assert secret_scan.scan_text("%E9 %00 token") == []


BINARY = bytes(range(256)) * 8


@pytest.mark.parametrize("packed", [gzip.compress(BINARY, mtime=0), zlib.compress(BINARY), gzip.compress(gzip.compress(BINARY, mtime=0), mtime=0)])
def test_nested_binary_payloads(packed):
    token = base64.b64encode(packed).decode()
    text = f"%41 {token} password%3Dhunter2hunter2"
    assert [s[0] for s in secret_scan.scan_text(text)] == ["url>assign"]
    nested = base64.b64encode(f"x {token} secret=abcdefgh".encode()).decode()
    assert [s[0] for s in secret_scan.scan_text(nested)] == ["base64>assign"]
    assert [s[0] for s in secret_scan.scan_text(f"\\u0041 {token} token\\u003dabcdefgh")] == ["unicode>assign"]


PLAIN = "a password=hunter2hunter2?>~ b"
LONG = "\n".join(f"line {k} of the text" for k in range(30)) + "\nsecret=abcdefgh-and-more " + "z" * 40


@pytest.mark.parametrize("data", [PLAIN.encode(), gzip.compress(PLAIN.encode(), mtime=0), zlib.compress(PLAIN.encode())])
@pytest.mark.parametrize("before", ["https://h.example/cfg/", "payload-", "key_", "a/b-c_d+", ""])
@pytest.mark.parametrize("after", ["", "/rest-of_it", "-x"])
@pytest.mark.parametrize("encode", [base64.b64encode, base64.urlsafe_b64encode])
def test_base64_behind_and_before_marks(data, before, after, encode):
    token = encode(data).decode().rstrip("=")
    spans, masked = hidden(f"see {before}{token}{after} end")
    assert any(s[0] in ("base64>assign", "base64>inflate>assign") for s in spans), (spans, token)
    assert token not in masked and masked.startswith(f"see {before}") and masked.endswith(" end")


@pytest.mark.parametrize("width", [76, 64, 75, 19])
@pytest.mark.parametrize("glue", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("before", ["", "text above\n", "data: ", "key_"])
def test_wrapped_base64(width, glue, before):
    for data, name in ((LONG.encode(), "base64>assign"), (gzip.compress(LONG.encode(), mtime=0), "base64>inflate>assign"), (gzip.compress(BINARY, mtime=0), None)):
        token = base64.b64encode(data).decode()
        lines = [token[k : k + width] for k in range(0, len(token), width)]
        text = before + glue.join(lines) + "\nbelow"
        spans, masked = hidden(text)
        assert (name is None and not spans) or name in {s[0] for s in spans}
        if name == "base64>inflate>assign":
            assert masked == before + "[S]" + "\nbelow"


def test_a_secret_over_a_line_break_keeps_its_place():
    token = base64.b64encode(b"x" * 40 + b" password=hunter2hunter2 " + b"y" * 40).decode()
    text = "\n".join(token[k : k + 64] for k in range(0, len(token), 64))
    spans, _ = hidden(text)
    a, b = 41 // 3 * 4 + 41 % 3, 64 // 3 * 4 + 1
    assert any(k == "base64>assign" and x == a and y > 65 for k, x, y in spans), (spans, a, b)


def test_long_runs_stay_linear():
    import random
    import time

    data = random.Random(1).randbytes(750_000)
    began = time.perf_counter()
    secret_scan.scan_text(base64.b64encode(data).decode())
    assert time.perf_counter() - began < 30


SECRET = "x password=hunter2hunter2 y"


def raw(data):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


@pytest.mark.parametrize("data, name", [
    (SECRET.encode("utf-16-le"), "base64>assign"), (SECRET.encode("utf-16-be"), "base64>assign"), (SECRET.encode("utf-16"), "base64>assign"),
    (b"ab\x00cd " + SECRET.encode(), "base64>assign"), (b"\xff\xfa\x80" * 5 + SECRET.encode() + b"\x00\x01", "base64>assign"),
    (raw((SECRET + " and more of it").encode()), "base64>inflate>assign"), (gzip.compress(SECRET.encode("utf-16-le")), "base64>inflate>assign"),
    (gzip.compress(b"\x00\x01\x02 " + SECRET.encode()), "base64>inflate>assign"), (gzip.compress(b"first member ") + gzip.compress(SECRET.encode()), "base64>inflate>assign"),
    (gzip.compress(SECRET.encode() * 50)[:-12], "base64>inflate>assign"),
])
def test_payloads_that_are_not_plain_text(data, name):
    token = base64.b64encode(data).decode()
    spans, masked = hidden(f"é see {token} end")
    assert name in {s[0] for s in spans} and token not in masked, spans
    assert all(6 <= a < b <= 6 + len(token) for _, a, b in spans)


def test_payload_compressed_a_hundred_times():
    data = SECRET.encode()
    for k in range(100):
        data = (gzip.compress if k % 2 else zlib.compress)(data)
    assert [s[0] for s in secret_scan.scan_text(base64.b64encode(data).decode())] == ["base64>inflate>assign"]


def test_large_inflations_are_scanned_in_bounded_memory():
    import tracemalloc

    c = zlib.compressobj(9, zlib.DEFLATED, 31)
    packed = b"".join(c.compress(b"line of no interest\n" * 50_000) for _ in range(100)) + c.compress(SECRET.encode() + b" and the rest" * 100_000) + c.flush()
    token = base64.b64encode(packed).decode()
    tracemalloc.start()
    spans = secret_scan.scan_text(f"a {token} b")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ("base64>inflate>assign", 2, 2 + len(token)) in spans and peak < 120 << 20
    twice = base64.b64encode(gzip.compress(packed)).decode()
    assert "base64>inflate>assign" in {s[0] for s in secret_scan.scan_text(twice)}


def test_many_spans_take_linear_time():
    import time

    text = "\n".join(f"pass%77ord%3Dhunter{k:06d} token=abcdef{k:06d}" for k in range(8000))
    began = time.perf_counter()
    assert len(secret_scan.scan_text(text)) == 16000
    assert time.perf_counter() - began < 10
