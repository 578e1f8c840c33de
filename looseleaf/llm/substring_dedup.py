"""Substring dedup by content-defined chunks of a gear rolling hash.

The gear hash of a place is the sum of table values of the bytes before it, shifted left once per byte; only its last
32 bytes count. A chunk ends where the hash is the least of all within REACH bytes on either side, so cuts depend on
nothing but the text near them: the same passage is cut alike wherever it stands, an insertion moves the cuts around it
only, and chunks have REACH + 1 bytes at least and about 2 * REACH + 1 on average. Where nothing is the least (one word
over and over) places that equal the least are taken, LONGEST / 2 bytes apart, so such stretches are cut alike too.

From every chunk on, the fewest chunks in which `min_words` words begin make a stretch; stretches are compared by 96 bits of
a digest of their bytes. One that stands in two documents is a repeat: all of it stands in one other document, so a passage
is never put together from unrelated ones. Repeats that overlap or touch are one passage.

Per digest only the least and greatest document are kept, a min/max aggregate combined before the shuffle; occurrences
then join it, and the adaptive skew join splits digests that stand in many documents. Texts are chunked once for each of
the two: writing the stretches and reading them twice would take more disk than the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import BLANKS, LOWER_TABLE, field, map_texts, slices

REACH = 20
LONGEST = 160
WINDOW = 32
MIN_WORDS = 25
_GAP = WINDOW + REACH
#: A text is hashed in stretches of about this many bytes.
_STRETCH = 1 << 20

GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, np.uint32)
GEAR[0] = 0


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte (32 bits, so of the last 32 bytes), by doubling instead of byte by byte."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        # The hash over 2k bytes: that over the last k, plus that over the k before, moved on.
        moved = h[:-k] << np.uint32(k)
        h[k:] += moved
    return h


def _least_around(h: np.ndarray, reach: int, ties: bool = False) -> np.ndarray:
    """Whether each value is the least within `reach` on either side, the first of equals (or, with `ties`, each of them)."""
    # Minimum over [i, i + reach) by doubling, then compared on both sides.
    top = np.iinfo(h.dtype).max
    low, have = h, 1
    while have < reach:
        step = min(have, reach - have)
        low = np.minimum(low, np.concatenate([low[step:], np.full(min(step, len(low)), top, h.dtype)])[: len(h)])
        have += step
    n = len(h)
    before = np.full(n, top, h.dtype)
    before[reach:] = low[: max(n - reach, 0)]
    after = np.full(n, top, h.dtype)
    after[:-1] = low[1:]
    least = (h <= before if ties else h < before) & (h <= after)
    if n > 1:  # the first few have a shorter stretch before them
        least[: min(reach, n)] = False
    return least


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) of the chunks of a text's bytes, its own end last."""
    n = len(data)
    found = []
    for a in range(0, max(n, 1), _STRETCH):
        lo, hi = max(a - WINDOW - REACH, 0), min(a + _STRETCH + REACH, n)
        padded = np.concatenate([np.zeros(_GAP if lo == 0 else 0, np.uint8), data[lo:hi]])
        ends = np.nonzero(_least_around(gear(padded), REACH))[0] - (_GAP if lo == 0 else 0) + lo + 1
        found.append(ends[(ends > a) & (ends <= min(a + _STRETCH, n))])
    ends = np.concatenate(found)
    ends = np.concatenate([ends[ends < n], [n]]) if n else ends[:0]
    sizes = np.diff(np.concatenate([[0], ends]))
    if len(ends) and sizes.max() > LONGEST:
        extra = [_even_cuts(data, e - size, e) for e, size in zip(ends.tolist(), sizes.tolist()) if size > LONGEST]
        ends = np.sort(np.concatenate([ends, *extra]))
    return ends


def _even_cuts(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Cuts of a stretch without a least hash: its first place that equals the least, and on from each LONGEST / 2 bytes or more.

    In text of one period these places are a whole number of periods apart, so chunks are alike wherever the stretch begins.
    """
    out, last = [], begin
    for a in range(begin, end, _STRETCH):
        lo, hi = max(a - _GAP, 0), min(a + _STRETCH + REACH, len(data))
        weak = np.nonzero(_least_around(gear(np.concatenate([np.zeros(_GAP if lo == 0 else 0, np.uint8), data[lo:hi]])), REACH, True))[0] - (_GAP if lo == 0 else 0) + lo + 1
        weak = weak[(weak > a) & (weak < min(a + _STRETCH, end))]
        k = 0
        while (k := int(np.searchsorted(weak, last + (LONGEST // 2 if out else 1), "left"))) < len(weak):
            last = int(weak[k])
            out.append(last)
    # What is left without such a place is cut every LONGEST bytes.
    edges = [begin, *out, end]
    return np.array(sorted({*out, *(x for p, q in zip(edges, edges[1:]) for x in range(p + LONGEST, q, LONGEST))}), np.int64)


_IS_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS, np.uint8))


_NONE = tuple(np.empty(0, np.int64) for _ in range(8))


def stretches(text: bytes, min_words: int) -> tuple[np.ndarray, ...]:
    """All stretches of a text: digest (64 and 32 bits), first chunk, chunk past the end, start and end (code points), words before it and up to its end."""
    low = text.translate(LOWER_TABLE)
    data = np.frombuffer(low, np.uint8)
    ends = cuts(data)
    if not len(ends):
        return _NONE
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    points = np.cumsum((data & 0xC0) != 0x80)
    begun = ~_IS_BLANK[data]
    begun[1:] &= _IS_BLANK[data[:-1]]
    # A cut inside a character belongs behind it.
    p_end = points[ends - 1]
    p_start = np.concatenate([[0], p_end[:-1]])
    words = np.concatenate([[0], np.cumsum(begun)[ends - 1]])
    begun[starts] = False  # whether a word begins at a chunk's first byte depends on what is before the chunk
    inner = np.concatenate([[0], np.cumsum(begun)[ends - 1]])
    past = np.searchsorted(inner, inner[:-1] + min_words, "left")
    first = np.nonzero(past < len(inner))[0]
    if not len(first):
        return _NONE
    past = past[first]
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(low[a:b]) for a, b in zip(starts[first].tolist(), ends[past - 1].tolist())]), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1].astype(np.int32), first, past, p_start[first], p_end[past - 1], words[first], words[past]


_NAMES = ["d1", "d2", "seq", "past", "start", "end", "before", "words"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]


def stretch_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per stretch of every whole text: `id`, digest `d1` and `d2`, `seq` and `past` (chunks), `start`, `end`, `before`, `words`.

    `seq` holds a hash of the text above the chunk's number, so texts with one id stay apart. Null and empty texts, and
    rows with a null id, have none.
    """
    named = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("id is not null and t <> ''")
    id_type = to_arrow_type(named.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in slices(texts):
                made = []
                for t in texts.slice(a, b - a).to_pylist():
                    d1, d2, seq, *rest = stretches(t, min_words)
                    made.append((d1, d2, seq + (xxhash.xxh32_intdigest(t) >> 1 << 32), *rest))
                rows = np.repeat(np.arange(a, b), [len(m[0]) for m in made])
                columns = [pa.array(np.concatenate([m[k] for m in made])).cast(t) for k, t in enumerate(_TYPES)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)).cast(id_type), *columns], names=["id", *_NAMES])

    return named.mapInArrow(run, f"id {named.schema['id'].dataType.simpleString()}, d1 long, d2 int, seq long, past int, start int, end int, before int, words int")


def _repeats(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Stretches that stand in more than one document, with `first`, the least id of them."""
    found = stretch_table(df, id_col, text_col, min_words)
    again = found.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("d1", "d2", "first")
    return found.join(again, ["d1", "d2"]).drop("d1", "d2").dropDuplicates(["id", "seq"]).withColumn("text", F.shiftright("seq", 32))


def _merged(hits: DataFrame) -> DataFrame:
    """Passages: stretches of one text that overlap or touch, in one row each."""
    order = Window.partitionBy("id", "text").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.col("seq") - F.shiftleft("text", 32)
    other = F.col("first") < F.col("id")
    known = F.max(F.when(other, F.col("words"))).over(before)
    fresh = F.when(other, F.greatest(F.col("words") - F.greatest(F.col("before"), F.coalesce(known, F.col("before"))), F.lit(0))).otherwise(0)
    marked = hits.withColumns({"new": (chunk > F.coalesce(F.max("past").over(before), F.lit(-1))).cast("long"), "fresh": fresh, "chunk": chunk})
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("id", "text", "run").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.max("words") - F.min("before")).cast("long").alias("n_words"),
        (F.max("past") - F.min("chunk")).alias("n_chunks"), F.min("first").alias("first_id"), F.sum("fresh").cast("long").alias("n_words_again"),
    )


def duplicate_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per passage that stands in more than one document: where, how long, and where it stands first.

    Columns: `id_col`, `start`, `end` (code points of the document's text, end exclusive), `n_words`, `n_chunks`,
    `first_id` (least id of a document that holds one of its stretches) and `n_words_again` (words of stretches whose least
    document is another one: 0 where the passage stays, all of them where it is a repeat). Every stretch of `min_words` words
    in it stands word for word (but for ASCII case) in one other document. Repeats within one document don't count, nor do
    repeated rows of one id; two texts with one id don't repeat each other. Cuts fall up to REACH + 2 * REACH bytes inside the
    true ends. Null and empty texts, null ids: no rows.
    """
    return _merged(_repeats(df, id_col, text_col, min_words)).select(F.col("id").alias(id_col), "start", "end", "n_words", "n_chunks", "first_id", "n_words_again")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`df` with every stretch taken out of `text_col` that stands in a document of smaller id; the first document keeps it.

    All rows and columns stay; null texts stay null. Options and edge cases as in duplicate_passages.
    """
    names = df.columns
    at, text = names.index(id_col), names.index(text_col)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    gone = _merged(_repeats(plain, f"c{at}", f"c{text}", min_words).filter("first < id"))
    spans = gone.groupBy(F.col("id").alias("id"), F.col("text").alias("text")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("spans"))

    # Texts are told apart by the hash that stretches carry.
    marked = map_texts(plain, plain.columns, f"c{text}", T.StructType([field("hash", T.LongType())]), lambda: lambda texts: {"hash": [None if t is None else xxhash.xxh32_intdigest(t) >> 1 for t in texts]})
    rows = marked.join(spans, (F.col(f"c{at}") == F.col("id")) & (F.col("hash") == F.col("text")), "left")
    t = F.col(f"c{text}")
    # Kept parts lie between one span's end and the next one's start.
    begins = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.e"))
    ends = F.concat(F.col("spans.s"), F.array(F.length(t).cast("long")))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))), "")
    return rows.withColumn(f"c{text}", F.when(F.col("spans").isNull(), t).otherwise(kept)).select(*plain.columns).toDF(*names)
