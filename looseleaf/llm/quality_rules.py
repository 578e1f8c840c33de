"""Quality rules: per-document base rules and cross-document line frequency.

Each text's lines are normalised (words lower-cased, joined by single spaces) and hashed. For every host the number of
distinct documents that hold a line is counted; lines in more than `max_share` of a host's documents, and in more than
`min_docs` of them, are boilerplate and are removed; a document of which too little is left is rejected.
The counts are two-step aggregates on (host, line, document) and (host, line), both combined before the shuffle, so
neither a host with a third of all rows nor a line in every document meets in one task.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, LOWER, UPPER, field, map_texts, stored

_SYMBOLS = b"#*$%&|<>"
#: Bytes that aren't the first of a character, and blanks: what is left are the code points in words.
_NOT_COUNTED = bytes(range(0x80, 0xC0)) + BLANKS


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    n = len(words)
    dup = 0
    if b"\n" in text:
        lines = [x for x in text.split(b"\n") if x.translate(None, BLANKS)]
        dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            hit = bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    hit[i] = hit[i + 1] = hit[i + 2] = 1
                    hit[j] = hit[j + 1] = hit[j + 2] = 1
            repeat = sum(hit)
    return n, len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, _SYMBOLS)), dup, repeat


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    h = xxhash.xxh64_intdigest(line, 42)
    return h - (1 << 64) if h >> 63 else h


def line_words(text: bytes) -> dict[int, int]:
    """Hash of each distinct normalised line with a word -> words in all its occurrences."""
    out: dict[int, int] = {}
    for line in text.split(b"\n"):
        normal = normal_line(line)
        if normal:
            h = line_hash(normal)
            out[h] = out.get(h, 0) + normal.count(b" ") + 1
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_LINE = T.StructType([field("h", T.LongType()), field("w", T.LongType())])
_KEY = ["__k1", "__k2", "__host"]


def keyed(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """`df` with a 192-bit key of its id, text and host, equal only for repeated rows (and for none that differ, but for hash chance)."""
    c = lambda x: F.col(f"`{x}`")
    return df.withColumns({"__k1": F.xxhash64(c(id_col)), "__k2": F.xxhash64(c(text_col)), "__host": F.xxhash64(c(host_col))})


def quality_decisions(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_docs: int = 10,
    max_share: float = 0.05,
    left_words: int = 30,
    left_share: float = 0.3,
) -> DataFrame:
    """One row per row of `df`: id, base counts, removed lines, verdicts, and the row's key.

    Columns: `id_col`, the five base counts, `n_removed_lines` and `n_removed_words`, `removed` (hashes of the removed
    lines, null for none), `base_failed`, `kept`, `__k1`, `__k2`, `__host`. Null and empty texts have no words and fail.
    Rows with a null host form one host; rows with a null id count as one document. Repeated rows count once and each
    get the same result. Extra columns of `df` are not read. An empty table gives an empty result.
    """
    rows = keyed(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, text_col, host_col])]), id_col, text_col, host_col)

    def start():
        def work(texts):
            got = [base_counts(t or b"") for t in texts]
            out = {name: list(col) for name, col in zip(_COUNTS, zip(*got))}
            out["__lines"] = [[{"h": h, "w": w} for h, w in line_words(t or b"").items()] for t in texts]
            return out

        return work

    new = T.StructType([*(field(c, T.LongType()) for c in _COUNTS), field("__lines", T.ArrayType(_LINE))])
    found = stored(map_texts(rows, [id_col, *_KEY], text_col, new, start))
    hosts = found.groupBy("__host").agg(F.count_distinct("__k1").alias("__docs"))
    lines = found.select(*_KEY, F.explode("__lines").alias("l")).select(*_KEY, F.col("l.h").alias("__h"), F.col("l.w").alias("__w"))
    often = (
        lines.groupBy("__host", "__h", "__k1").agg(F.lit(1).alias("__one"))
        .groupBy("__host", "__h").agg(F.count("*").alias("__n"))
        .filter(F.col("__n") > min_docs)
        .join(hosts, "__host").filter(F.col("__n") > max_share * F.col("__docs")).select("__host", "__h")
    )
    removed = (
        lines.join(often, ["__host", "__h"])
        .groupBy(*_KEY, "__h").agg(F.max("__w").alias("__w"))
        .groupBy(*_KEY).agg(F.count("*").alias("n_removed_lines"), F.sum("__w").alias("n_removed_words"), F.collect_list("__h").alias("removed"))
    )
    n, gone = F.col("n_words"), F.coalesce("n_removed_words", F.lit(0))
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)
    return (
        found.drop("__lines").join(removed, _KEY, "left")
        .withColumns({"n_removed_lines": F.coalesce("n_removed_lines", F.lit(0).cast("long")), "n_removed_words": gone.cast("long"), "base_failed": failed})
        .withColumn("kept", ~failed & (n - gone >= left_words) & (n - gone >= left_share * n))
    )


def quality_filter(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", **options) -> DataFrame:
    """The rows of `df` that are kept, all columns as they were but for removed lines of `text_col` (and `n_chars`, if there).

    Row identity is by key, so repeated rows all stay or all go; columns of any name may be there. See quality_decisions for
    options and edge cases.
    """
    names = df.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    plain = df.toDF(*at.values())
    keys = [at[c] for c in (id_col, text_col, host_col)]
    made = quality_decisions(plain, *keys, **options).filter("kept").select(*_KEY, F.col("removed").alias("__removed")).dropDuplicates(_KEY)
    clean = without_lines(keyed(plain, *keys).join(made, _KEY), at[text_col])
    if "n_chars" in at:
        n = at["n_chars"]
        clean = clean.withColumn(n, F.when(F.col("__removed").isNull(), F.col(n)).otherwise(F.length(at[text_col])).cast(df.schema["n_chars"].dataType))
    return clean.select(*at.values()).toDF(*names)


def without_lines(df: DataFrame, text_col: str) -> DataFrame:
    """`df` with the lines of `text_col` whose hash is in the array column `__removed` taken out; other rows untouched."""
    t = F.col(f"`{text_col}`")
    normal = lambda line: F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), "[\\x20\\x09-\\x0D]+", " "))
    left = F.filter(F.split(t, "\n", -1), lambda line: ~F.array_contains(F.col("__removed"), F.xxhash64(normal(line))))
    return df.withColumn(text_col, F.when(F.col("__removed").isNull(), t).otherwise(F.array_join(left, "\n")))

