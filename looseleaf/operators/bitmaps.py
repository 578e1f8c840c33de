"""Sets of ordinals as DataFrames: algebra, rank and select, and the portable Roaring format in and out.

A set is a DataFrame with one long column `n`, distinct. Algebra is joins and unions that Catalyst plans; compressed
blocks (one bitmap per 32,768 ordinals) serve counting without expanding the sets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def of(spark: SparkSession, numbers: Iterable[int]) -> DataFrame:
    return spark.createDataFrame([(int(n),) for n in sorted(set(numbers))], "n long")


def of_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    """first to last, both included."""
    return spark.range(first, last + 1).withColumnRenamed("id", "n")


def intersection(first: DataFrame, *others: DataFrame) -> DataFrame:
    for x in others:
        first = first.join(x, "n", "left_semi")
    return first


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    for x in others:
        first = first.unionByName(x)
    return first.distinct()


def and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "n", "left_anti")


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("n").agg(F.count("*").alias("c")).filter("c = 1").select("n")


def blocks(a: DataFrame) -> DataFrame:
    """The set as one bitmap per bucket of 32,768 ordinals (shifted by one, so that bucket and position are unambiguous)."""
    n = F.col("n") + 1
    return a.groupBy(F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def and_cardinality(a: DataFrame, b: DataFrame) -> int:
    """Size of the intersection from the blocks: what moves is one bitmap per bucket and side."""
    both = blocks(a).unionByName(blocks(b)).groupBy("bucket").agg(F.count("*").alias("c"), F.bitmap_and_agg("bits").alias("bits"))
    return both.filter("c = 2").agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]


def cardinality(a: DataFrame) -> int:
    return a.count()


def intersects(a: DataFrame, b: DataFrame) -> bool:
    return not intersection(a, b).isEmpty()


def contains(a: DataFrame, n: int) -> bool:
    return not a.filter(F.col("n") == n).isEmpty()


def first(a: DataFrame) -> int | None:
    return a.agg(F.min("n")).first()[0]


def last(a: DataFrame) -> int | None:
    return a.agg(F.max("n")).first()[0]


def rank(a: DataFrame, n: int) -> int:
    """How many members are at most n."""
    return a.filter(F.col("n") <= n).count()


def select(a: DataFrame, k: int) -> int | None:
    """The member with k members before it, or None; counts per range first, then one range's members."""
    width = 1 << 16
    sizes = a.groupBy(F.floor(F.col("n") / width).alias("b")).agg(F.count("*").alias("c"))
    before = 0
    for r in sizes.orderBy("b").toLocalIterator():
        if before + r.c > k:
            rows = a.filter(F.floor(F.col("n") / width) == r.b).orderBy("n").offset(k - before).limit(1).collect()
            return rows[0].n
        before += r.c
    return None


def add_range(a: DataFrame, low: int, high: int) -> DataFrame:
    return union(a, of_range(a.sparkSession, low, high))


def remove_range(a: DataFrame, low: int, high: int) -> DataFrame:
    return a.filter(~F.col("n").between(low, high))


def cursor(a: DataFrame, start: int | None = None) -> Iterator[int]:
    """Members in order, from `start` on, streamed partition by partition."""
    rows = a if start is None else a.filter(F.col("n") >= start)
    return (r.n for r in rows.orderBy("n").toLocalIterator())


def with_rank(a: DataFrame) -> DataFrame:
    """Each member with its rank from 0, from range counts and a window within each range."""
    b = a.withColumn("b", F.floor(F.col("n") / (1 << 16)))
    sizes = b.groupBy("b").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    own = b.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("n")) - 1)
    return own.join(sizes.select("b", F.coalesce("before", F.lit(0)).alias("before")), "b").select("n", (F.col("r") + F.col("before")).alias("rank"))


# --- portable Roaring format (public specification), 32-bit ----------------------------------------------------------

_PLAIN, _RUNS = 12346, 12347


def encode_roaring(members: Iterable[int]) -> bytes:
    """The portable serialisation of a set of unsigned 32-bit numbers, each container in its smallest form."""
    high: dict[int, list[int]] = {}
    for n in sorted(set(members)):
        if not 0 <= n < 1 << 32:
            raise ValueError(f"{n} isn't an unsigned 32-bit number")
        high.setdefault(n >> 16, []).append(n & 0xFFFF)
    made: list[tuple[int, int, bool, bytes]] = []
    for key, low in high.items():
        runs: list[list[int]] = []
        for x in low:
            if runs and runs[-1][0] + runs[-1][1] + 1 == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 0])
        flat = 2 * len(low) if len(low) <= 4096 else 8192
        if 2 + 4 * len(runs) < flat:
            made.append((key, len(low), True, struct.pack("<H", len(runs)) + b"".join(struct.pack("<HH", *r) for r in runs)))
        elif len(low) <= 4096:
            made.append((key, len(low), False, struct.pack(f"<{len(low)}H", *low)))
        else:
            bits = bytearray(8192)
            for x in low:
                bits[x >> 3] |= 1 << (x & 7)
            made.append((key, len(low), False, bytes(bits)))
    n = len(made)
    some = any(m[2] for m in made)
    if some:
        flags = bytearray((n + 7) // 8)
        for i, m in enumerate(made):
            flags[i >> 3] |= m[2] << (i & 7)
        head = struct.pack("<I", _RUNS | n - 1 << 16) + bytes(flags)
    else:
        head = struct.pack("<II", _PLAIN, n)
    head += b"".join(struct.pack("<HH", m[0], m[1] - 1) for m in made)
    if not some or n >= 4:
        at = len(head) + 4 * n
        for m in made:
            head += struct.pack("<I", at)
            at += len(m[3])
    return head + b"".join(m[3] for m in made)


def decode_roaring(data: bytes) -> list[int]:
    """Members, in order, of a portable serialisation; ValueError for one that is damaged or has bytes left over."""
    try:
        (cookie,) = struct.unpack_from("<I", data, 0)
        at = 4
        flags = b""
        if cookie & 0xFFFF == _RUNS:
            n = (cookie >> 16) + 1
            flags = data[4 : 4 + (n + 7) // 8]
            at += (n + 7) // 8
        elif cookie == _PLAIN:
            (n,) = struct.unpack_from("<I", data, 4)
            at = 8
        else:
            raise ValueError("not a portable Roaring bitmap")
        if n > 1 << 16:
            raise ValueError("too many containers")
        keys = [struct.unpack_from("<HH", data, at + 4 * i) for i in range(n)]
        at += 4 * n
        if not flags or n >= 4:
            at += 4 * n
        out: list[int] = []
        for i, (key, less) in enumerate(keys):
            size = less + 1
            if flags and flags[i >> 3] >> (i & 7) & 1:
                (runs,) = struct.unpack_from("<H", data, at)
                low = [x for r in range(runs) for a, b in [struct.unpack_from("<HH", data, at + 2 + 4 * r)] for x in range(a, a + b + 1)]
                at += 2 + 4 * runs
            elif size <= 4096:
                low = list(struct.unpack_from(f"<{size}H", data, at))
                at += 2 * size
            else:
                if len(data) < at + 8192:
                    raise ValueError("cut short")
                low = [k << 3 | b for k, byte in enumerate(data[at : at + 8192]) if byte for b in range(8) if byte >> b & 1]
                at += 8192
            if len(low) != size or any(a >= b for a, b in zip(low, low[1:])) or low and low[-1] > 0xFFFF:
                raise ValueError("a container isn't what its header says")
            out += [key << 16 | x for x in low]
    except struct.error:
        raise ValueError("cut short") from None
    if at != len(data) or any(a >= b for a, b in zip(out, out[1:])):
        raise ValueError("bytes left over or keys out of order")
    return out
