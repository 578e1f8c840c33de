"""Personal data: expressions propose spans, checksums confirm them, context words adjust their score.

Everything here is a Spark SQL expression over one row: no shuffle, no Python, no state. A kind's matches come from
one pass of its expression; their places come from splitting the text at the same expression and adding up lengths,
since Spark has no function that returns positions. A match's surroundings are read from short pieces of the text, so time
is near linear in the text and in its matches. The expressions are written so that they run in linear time
(possessive repeats, and starts only at a run's first character or right after the previous match) and still find
exactly the leftmost non-overlapping matches of the plain form given beside each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Kinds that stand in the base digest, in the order in which spans with one start are listed.
BASE_KINDS = ["email", "ip", "card", "phone"]
EXTRA_KINDS = ["iban", "ssn"]


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a substring or `[0-9]` without which a text can't hold the kind
    check: str | None  # SQL condition on the matched text m
    score: float  # before context
    least: float  # spans below this are dropped
    words: str  # context words, as an alternation


def _luhn() -> str:
    """Digits are padded in front to 19, so odd places from the right (1st, 3rd, ...) are the odd places here."""
    digit = "int(substring(lpad(regexp_replace(m, '[^0-9]', ''), 19, '0'), i, 1))"
    value = f"if(i % 2 = 1, {digit}, if({digit} > 4, {digit} * 2 - 9, {digit} * 2))"
    return f"length(regexp_replace(m, '[^0-9]', '')) between 14 and 19 and aggregate(sequence(1, 19), 0, (t, i) -> t + {value}) % 10 = 0"


def _mod97() -> str:
    """Country and check digits go to the end, letters count from 10: the number is 1 modulo 97."""
    bare = "regexp_replace(m, ' ', '')"
    moved = f"substring({bare}, 5) || substring({bare}, 1, 4)"
    step = "int((r * if(c rlike '[0-9]', 10, 100) + if(c rlike '[0-9]', ascii(c) - 48, ascii(c) - 55)) % 97)"
    return f"aggregate(split({moved}, ''), 0, (r, c) -> {step}) = 1"


_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

KINDS = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None, 0.8, 0.0, "e-?mail|mail|contact|write to|reach"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", rf"m rlike '^{_PART}\\.{_PART}\\.{_PART}\\.{_PART}$'", 0.6, 0.0, "ip|address|host|server|client"),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "[0-9]", _luhn(), 0.7, 0.0, "card|credit|visa|payment|account"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", "length(regexp_replace(m, '[^0-9]', '')) between 10 and 15", 0.6, 0.0, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[0-9]", _mod97(), 0.9, 0.5, "iban|bank|account|transfer"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "not m rlike '^(000|666|9)|-00-|-0000$'", 0.3, 0.5, "ssn|social security|tax id"),
]
#: Code points on either side of a span in which context words count, and what one adds to its score.
CONTEXT, BONUS = 40, 0.3
_BLOCK = 256
_PIECE = 256


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prefix_sums(steps: str) -> str:
    """Running totals of an array of bigints, in blocks: arrays grow to _BLOCK at most in one fold, so it stays near linear."""
    blocks = f"transform(sequence(0, (size({steps}) - 1) div {_BLOCK}), b -> slice({steps}, int(b * {_BLOCK} + 1), {_BLOCK}))"
    run = "aggregate(x, array(0L), (t, v) -> concat(t, array(element_at(t, -1) + v)))"
    totals = f"aggregate(transform({blocks}, x -> aggregate(x, 0L, (t, v) -> t + v)), array(0L), (t, v) -> concat(t, array(element_at(t, -1) + v)))"
    return f"flatten(zip_with({blocks}, slice({totals}, 1, size({totals}) - 1), (x, t0) -> transform(slice({run}, 2, size(x)), v -> v + t0)))"


def pii_spans(df: DataFrame, id_cols: list[str] | None = None, text_col: str = "text", spans_col: str = "spans", kinds: list[Kind] | None = None) -> DataFrame:
    """`id_cols` of each row with the array of personal-data spans (kind, start, end, score) of its whole text.

    Offsets are code points, end exclusive. Spans are sorted by start, then kind as listed in `kinds`, then end;
    overlapping spans of different kinds all stay. `score` is the kind's own, plus BONUS where one of its context words
    stands within CONTEXT code points, at most 1; a span below the kind's least score is dropped. Null and empty texts
    have no spans. One row out per row in; repeated rows repeat; other columns are not read.
    """
    kinds = KINDS if kinds is None else kinds
    ids = id_cols or ["doc_id"]
    names = [f"c{i}" for i in range(len(ids))]
    at = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(ids, names)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    at = at.withColumn("digits", F.col("t").rlike("[0-9]"))
    none = F.array().cast("array<string>")
    for k in kinds:
        needs = F.col("digits") if k.needs == "[0-9]" else F.col("t").contains(k.needs)
        if k.name != "email":
            needs = F.col("digits") & needs
        at = at.withColumn(f"m_{k.name}", F.when(needs, F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))).otherwise(none))
    matched = F.expr(" or ".join(f"size(m_{k.name}) > 0" for k in kinds))
    # Pieces of _PIECE code points each, for looking at a match's surroundings without counting from the text's start.
    at = at.withColumn("pieces", F.when(matched, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))).otherwise(none))
    for k in kinds:
        # Length between the matches and of the match before: their running total is each match's start. The arrays are walked
        # side by side, never indexed: the optimizer may put the split here, and must not do so once a match.
        gaps = f"split(t, {_sql_text(k.pattern)}, -1)"
        m = f"m_{k.name}"
        steps = f"zip_with(slice({gaps}, 1, size({m})), concat(array(''), slice({m}, 1, size({m}) - 1)), (g, m) -> bigint(length(g) + length(m)))"
        at = at.withColumn(f"s_{k.name}", F.expr(f"if(size({m}) > 0, {steps}, cast(array() as array<bigint>))"))
    typed = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"
    parts = []
    for rank, k in enumerate(kinds):
        starts = _prefix_sums(f"s_{k.name}")
        zipped = f"zip_with(m_{k.name}, {starts}, (m, s) -> struct(m, s))"
        sure = f"filter({zipped}, z -> {re.sub(r'\bm\b', 'z.m', k.check)})" if k.check else zipped
        begin, end = f"greatest(z.s - {CONTEXT}, 0)", "(z.s + length(z.m))"
        around = f"lower({_stretch(begin, f'z.s - {begin}')} || ' ' || {_stretch(end, str(CONTEXT))})"
        score = f"round(least(1.0D, {k.score}D + if({around} rlike {_sql_text(rf'(?<![a-z])(?:{k.words})(?![a-z])')}, {BONUS}D, 0.0D)), 3)"
        made = f"transform({sure}, z -> named_struct('start', z.s, 'rank', {rank}, 'end', z.s + length(z.m), 'kind', '{k.name}', 'score', {score}))"
        parts.append(f"if(size(m_{k.name}) > 0, filter({made}, x -> x.score >= {k.least}D), cast(array() as {typed}))")
    spans = f"transform(array_sort(concat({', '.join(parts)})), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'score', x.score))"
    return at.select(*[F.col(n).alias(c) for c, n in zip(ids, names)], F.expr(spans).alias(spans_col))


def _stretch(begin: str, length: str) -> str:
    """Up to CONTEXT code points of the text from `begin` (from 0), out of at most two pieces."""
    piece = lambda add: f"coalesce(try_element_at(pieces, int({begin} div {_PIECE}) + {add}), '')"
    return f"substring({piece(1)} || {piece(2)}, int({begin} % {_PIECE}) + 1, int({length}))"


def masked_text(text: Column, spans: Column) -> Column:
    """`text` with every span replaced by its kind in brackets; where spans overlap, the first one's kind stands."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    first = F.struct(F.lit(0).cast("bigint").alias("last"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        put = F.concat(state["out"], t.substr((state["last"] + 1).cast("int"), (s["start"] - state["last"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= state["last"], F.struct(s["end"].alias("last"), put.alias("out"))).otherwise(
            F.struct(F.greatest(state["last"], s["end"]).alias("last"), state["out"].alias("out"))
        )

    return F.when(text.isNotNull(), F.aggregate(spans, first, add, lambda s: F.concat(s["out"], F.substring(t, (s["last"] + 1).cast("int"), F.lit(2147483647)))))
