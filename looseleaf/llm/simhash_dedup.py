"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into segments of 22, 21 and 21 bits. Two fingerprints at 2 or fewer differing bits agree
on one segment at least, and differ in at most 2 bits of any other (pigeonhole). A segment is read as a word of the
binary Golay code [23, 12, 7], which is perfect: every word decodes to one codeword within 3 bits. Decoding a segment
and each of its one-bit neighbours gives 1 or 6 codeword indices; two segments at distance 2 or less have a word within
one bit of both, hence a common index. The keys of a fingerprint are (which segment, its bits, an index of the next
segment), about 16 of 33 or 34 bits; equal keys propose pairs and the full distance decides.

Only distinct fingerprints are joined; copies collapse before. A key shared by more than BUCKET fingerprints isn't
paired off: its members go, exactly, through one-bit balls instead (fingerprints within 2 bits share a word within one
bit of both, and no ball holds more than 65), so no group is ever expanded into all its pairs and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_texts, stored
from .components import components

SEED = 42
#: Shift and width of each segment.
SEGMENTS = [(42, 22), (21, 21), (0, 21)]
RADIUS = 2
BUCKET = 64
_PIECE = 1 << 16


# --- fingerprints -----------------------------------------------------------------------------------------------------

def shingle_hashes(text: bytes, size: int = 3) -> np.ndarray:
    """XXH64 of each run of `size` words of the ASCII-lower-cased text, repeats included; fewer words: of all of them."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    each = (digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()))
    return np.fromiter(each, np.uint64, len(words) - size + 1)


def fingerprint(text: bytes, size: int = 3) -> int:
    """64 bits, each 1 where it is set in over half the shingle hashes; 0 without a word."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _PIECE):
        part = hashes[a : a + _PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_cols: list[str] | None = None, text_col: str = "text", size: int = 3, out: str = "fp") -> DataFrame:
    """`id_cols` of each row and the fingerprint of its whole text as a signed long; null and empty texts have 0."""

    def start():
        return lambda texts: {out: [_signed(fingerprint(t or b"", size)) for t in texts]}

    return map_texts(df, id_cols or ["doc_id"], text_col, T.StructType([field(out, T.LongType())]), start)


# --- Golay code -------------------------------------------------------------------------------------------------------

_POLY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _POLY << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of each byte at each of three places, and the error pattern of each of the 2048 remainders."""
    rest = np.array([[_remainder(v << 8 * k) if v << 8 * k < 1 << 23 else 0 for v in range(256)] for k in range(3)], np.int64)
    errors = np.zeros(2048, np.int64)
    bits = [1 << k for k in range(23)]
    for e in [*bits, *(x | y for x in bits for y in bits if x < y), *(x | y | z for x in bits for y in bits if x < y for z in bits if y < z)]:
        errors[_remainder(e)] = e
    return rest, errors


def golay_index(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index (0..4095, its message bits) of the codeword nearest to each 23-bit word."""
    rest, errors = tables
    r = rest[0][words & 255] ^ rest[1][words >> 8 & 255] ^ rest[2][words >> 16]
    return (words ^ errors[r]) >> 11


def golay_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint, and the row each belongs to."""
    u = fps.astype(np.int64).view(np.uint64)
    parts = [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    keys, rows = [], []
    for i in range(3):
        j = (i + 1) % 3
        near = parts[j][:, None] ^ np.array([0, *(1 << k for k in range(SEGMENTS[j][1]))], np.int64)[None, :]
        index = np.sort(golay_index(near, tables), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, _ = np.nonzero(new)
        keys.append((np.int64(i) << 34) | (parts[i][row] << 12) | index[new])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def ball_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint and its 64 one-bit neighbours, and the row each belongs to."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    near = fps.astype(np.int64).view(np.uint64)[:, None] ^ flips[None, :]
    return near.ravel().view(np.int64), np.repeat(np.arange(len(fps)), 65)


def _keyed(fps: DataFrame, golay: bool) -> DataFrame:
    def run(batches):
        tables = _tables() if golay else None
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(all_fps), _PIECE // 8):
                part = all_fps[a : a + _PIECE // 8]
                keys, rows = golay_keys(part, tables) if golay else ball_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with equal keys (rows sorted by key) whose fingerprints differ in at most `radius` bits."""
    left, right = [], []
    step = 1
    at = np.nonzero(keys[1:] == keys[:-1])[0]
    u = fps.view(np.uint64)
    while len(at):
        close = np.bitwise_count(u[at] ^ u[at + step]) <= radius
        left.append(at[close])
        right.append(at[close] + step)
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _paired(keyed: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(a, b) links of equal keys within `radius`; (fp, null) for members of keys with more than `bucket` fingerprints.

    Keys are hashed to partitions and sorted within; a task streams them and holds one bucket at a time.
    """

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        big: int | None = None  # the last key, if it already has more than `bucket` members

        def done(k, f):
            if not len(k):
                return
            edge = np.nonzero(np.diff(k))[0] + 1
            size = np.diff(np.concatenate([[0], edge, [len(k)]]))
            each = np.repeat(size, size)
            hot = each > bucket
            if hot.any():
                yield out(f[hot], [None] * int(hot.sum()))
                k, f = k[~hot], f[~hot]
            x, y = close_pairs(k, f, radius)
            if len(x):
                lo, hi = np.minimum(f[x], f[y]), np.maximum(f[x], f[y])
                pair = np.unique(np.stack([lo, hi]), axis=1)
                yield out(pair[0], pair[1])

        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if big is not None:
                same = int(np.searchsorted(k, big, "right"))
                if same:
                    yield out(f[:same], [None] * same)
                    k, f = k[same:], f[same:]
                if not len(k):
                    continue
                big = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            yield from done(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
            if len(keys) > bucket:
                yield out(fps, [None] * len(fps))
                big, keys, fps = int(keys[-1]), keys[:0], fps[:0]
        yield from done(keys, fps)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a < b) that connect all distinct fingerprints (column `fp`) within `radius` <= 2 bits of one another.

    Every pair within the radius is linked, directly or, for members of overfull keys, over a common one-bit ball.
    """
    if radius > 2:
        raise ValueError("the keys guarantee a radius of 2")
    found = stored(_paired(_keyed(fps, True), radius, bucket))
    links = found.filter("b is not null").select("a", "b")
    hot = stored(found.filter("b is null").select(F.col("a").alias("fp")).distinct())
    if radius and not hot.isEmpty():
        links = links.union(_paired(_keyed(hot, False), radius, 65).filter("b is not null"))
    return links.distinct()


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = RADIUS, bucket: int = BUCKET, extra: list[str] | None = None) -> DataFrame:
    """One row per row of `df`: `id_col`, columns `extra`, `fp` (signed long) and `component_id`.

    `component_id` is the smallest id reachable over links, the row's own included; null ids are passed over, and a
    component of null ids only has null. Null and empty texts share fingerprint 0 and are linked like any other. Repeated
    rows repeat with the same component. An empty table gives an empty result; other columns are not read.
    """
    rows = stored(fingerprints(df, [id_col, *(extra or [])], text_col, size))
    classes = stored(rows.groupBy("fp").agg(F.min(f"`{id_col}`").alias("__least")))
    roots = components(fingerprint_links(classes, radius, bucket)).withColumnRenamed("node", "fp")
    linked = classes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("__least").alias("__all"))
    of = classes.join(linked.select("fp", "root").join(least, "root").select("fp", "__all"), "fp", "left")
    of = of.select("fp", F.coalesce("__all", "__least").alias("component_id"))
    return rows.join(of, "fp", "left").select(f"`{id_col}`", *[f"`{c}`" for c in extra or []], "fp", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group=simhash_groups, **options) -> DataFrame:
    """The rows of `df` that stay when one document of each group (as made by `group`) does: that with the group's smallest id.

    Of repeated rows (same id and text) one stays. Rows with a null id in a group that has ids go; where a group has
    null ids only, each distinct text stays. All columns stay as they are.
    """
    names = df.columns
    at, text = names.index(id_col), names.index(text_col)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    keyed = plain.withColumns({"k1": F.xxhash64(f"c{at}"), "k2": F.xxhash64(f"c{text}")})
    groups = group(keyed, f"c{at}", f"c{text}", extra=["k1", "k2"], **options)
    stay = groups.filter(F.col(f"c{at}").eqNullSafe(F.col("component_id"))).select("k1", "k2").distinct()
    return keyed.join(stay, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).drop("k1", "k2").toDF(*names)
