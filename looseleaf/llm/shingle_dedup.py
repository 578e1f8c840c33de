"""Near-duplicates by SimHash and Golay-code fuzzy hashing, decided by the exact Jaccard similarity of five-word shingle sets.

Two texts are linked if their sets of distinct shingles have a similarity of 0.8 or more. At 0.8 some 15 % of SimHash bits
differ, about 10 of 64, too many for one fingerprint to tell related texts from others; so a set's SimHash is continued,
bit by bit a vote of all its shingles. Pairs of segments of 23 bits make BANDS bands. A segment is read as a word of the
binary Golay code, as in op 6; instead of all its one-bit neighbours, the words made by flipping any of the FLIPS bits with
the closest votes are decoded, and the NEAR codewords that contradict the fewest votes are kept. The keys of a band are the
KEYS pairs of codeword indices that contradict the fewest votes. Equal keys propose a pair if TAG further bits, others in
each band, differ in at most RADIUS. Sets at exactly 0.8 are proposed by a band with a chance of some 0.56, so by none with
1e-9 (3e-8 for the smallest sets, of four and five shingles), and less above. The distance over the tags of all bands then
screens a pair (at 0.8 fewer than one in 1e10 is more than SCREEN), and the sets themselves, made again from both whole
texts, decide.

Only distinct sets are joined; copies collapse before. Members of a key with more than BUCKET sets are first compared with its
smallest one only; members that are then still in different components are compared with each other, so a large family of
near copies costs one pair a member and no link between components is lost.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_texts, stored
from .components import components
from .simhash_dedup import _remainder, _tables, close_pairs, golay_index, shingle_hashes

SIZE, SIMILARITY = 5, 0.8
BANDS, WIDTH = 25, 23
FLIPS, NEAR, KEYS = 6, 6, 8
TAG, RADIUS = 32, 9
BUCKET = 16
#: Largest share of all tags' bits that may differ: 0.15 and some ten standard deviations, or 0.19 (the smallest sets) and over six.
SCREEN = 0.28
_PIECE = 255
_AT_ONCE = 16
_KEPT = 64
_NONE = np.iinfo(np.int64).max

#: Keys take 29 bits.
_CODE = (1 << 29) - 1
#: Bits in segments, and 64-bit hashes of a shingle that make up these and the tags.
_CODED = BANDS * 2 * WIDTH
_HASHES = -(-(_CODED + BANDS * TAG) // 64)
_RANDOM = np.random.Generator(np.random.PCG64(20240301))
_FLIP = _RANDOM.integers(0, 1 << 64, _HASHES - 1, np.uint64, endpoint=False)
_TIMES = _RANDOM.integers(0, 1 << 64, _HASHES - 1, np.uint64, endpoint=False) | np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 64, _HASHES - 1, np.uint64, endpoint=False) | np.uint64(1)
#: Each way to flip some of FLIPS bits.
_SOME = np.array(list(itertools.product([0, 1], repeat=FLIPS)), np.int64)
_BIT = np.int64(1) << np.arange(WIDTH, dtype=np.int64)
#: Low 11 bits of the codeword of each index.
_PARITY = np.array([_remainder(i << 11) for i in range(4096)], np.int64)


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; those of fewer words are one shingle, no word is none."""
    return np.unique(shingle_hashes(text, size))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the long SimHash, the shingles whose hash has it set less those whose hash hasn't."""
    ones = np.zeros(_HASHES * 64, np.int64)
    for a in range(0, len(hashes), _PIECE):
        h = hashes[a : a + _PIECE, None]
        x = h ^ _FLIP
        x = (x ^ x >> np.uint64(32)) * _TIMES
        x = (x ^ x >> np.uint64(29)) * _MIX
        x = np.concatenate([h, x ^ x >> np.uint64(32)], axis=1)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * ones - len(hashes)


def near_codewords(ballots: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For segments (n x WIDTH votes), NEAR numbers `votes contradicted << 12 | codeword index`, least first; _NONE if there are fewer."""
    weight = np.abs(ballots)
    word = (ballots > 0) @ _BIT
    loose = np.argpartition(weight * 32 + np.arange(WIDTH), FLIPS - 1, axis=1)[:, :FLIPS]
    index = golay_index(word[:, None] ^ _BIT[loose] @ _SOME.T, tables)
    # The votes of the bits in which each codeword differs from the segment, summed by tables over six bits at a time.
    codeword = index << 11
    codeword |= _PARITY[index]
    wrong = codeword ^ word[:, None]
    cost = np.zeros(index.shape, np.int64)
    for a in range(0, WIDTH, 6):
        part = weight[:, a : a + 6]
        sums = np.zeros((len(part), 1), np.int64)
        for k in range(part.shape[1]):
            sums = np.concatenate([sums, sums + part[:, k : k + 1]], axis=1)
        cost += np.take_along_axis(sums, wrong >> a & (1 << part.shape[1]) - 1, axis=1)
    found = np.sort(cost << 12 | index, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = _NONE
    return np.sort(found, axis=1)[:, :NEAR]


def golay_keys(ballots: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The keys of each text (texts x bits votes): up to KEYS a band, made of the band and a codeword index of either segment."""
    n = len(ballots)
    near = near_codewords(ballots[:, :_CODED].reshape(-1, WIDTH), tables).reshape(n, BANDS, 2, NEAR)
    cost, index = near >> 12, near & 4095
    both = (cost[:, :, 0, :, None] + cost[:, :, 1, None, :]).reshape(n, BANDS, -1)
    code = (index[:, :, 0, :, None] << 12 | index[:, :, 1, None, :]).reshape(n, BANDS, -1)
    code += np.arange(BANDS, dtype=np.int64)[:, None] << 24
    real = both < _NONE >> 12
    best = np.sort(np.where(real, both << 29 | code, _NONE), axis=2)[:, :, :KEYS]
    return [(row[row < _NONE] & _CODE).astype(np.int32) for row in best.reshape(n, -1)]


def tags_of(ballots: np.ndarray) -> np.ndarray:
    """The tag of each band (texts x BANDS)."""
    bits = np.packbits(ballots[:, _CODED : _CODED + BANDS * TAG] > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<i4").astype(np.int32)


def signatures(df: DataFrame, keep: list[str], text_col: str, size: int = SIZE) -> DataFrame:
    """Columns `keep` of each row, the digest of its shingle set (`set`), its `keys` and its `tags`; texts without a word have none."""

    def lists(arrays):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32)))

    def start():
        tables = _tables()

        def work(texts):
            digests, keys, tags, none = [], [], [], np.empty(0, np.int32)
            for a in range(0, len(texts), _AT_ONCE):
                sets = [shingle_set(t or b"", size) for t in texts[a : a + _AT_ONCE]]
                digests += [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
                full = [votes(s) for s in sets if len(s)]
                ballots = np.stack(full) if full else np.empty((0, _HASHES * 64), np.int64)
                made = iter(zip(golay_keys(ballots, tables), tags_of(ballots)))
                for s in sets:
                    k, t = next(made) if len(s) else (none, none)
                    keys.append(k)
                    tags.append(t)
            return {"set": pa.array(np.array(digests, np.uint64).view(np.int64)), "keys": lists(keys), "tags": lists(tags)}

        return work

    new = T.StructType([field("set", T.LongType()), field("keys", T.ArrayType(T.IntegerType())), field("tags", T.ArrayType(T.IntegerType()))])
    return map_texts(df, keep, text_col, new, start)


def _keyed(classes: DataFrame) -> DataFrame:
    """(key, set) of each set: a key in the low 29 bits, over it the tag of the key's band."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, _PIECE):
                batch = whole.slice(a, _PIECE)
                many = pa.compute.list_value_length(batch.column(1)).to_numpy()
                key = batch.column(1).flatten().to_numpy().astype(np.int64)
                tag = batch.column(2).flatten().to_numpy().view(np.uint32).astype(np.int64).reshape(-1, BANDS)
                rows = np.repeat(np.arange(int((many > 0).sum())), many[many > 0])
                key |= tag[rows, key >> 24] << 29
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column(0).to_numpy(), many))], names=["key", "set"])

    return classes.select("set", "keys", "tags").mapInArrow(run, "key long, set long")


def _proposed(keyed: DataFrame, bucket: int = 1) -> DataFrame:
    """What keys with more than one set propose; of those with at most `bucket`, all pairs (a, b) with near tags.

    Keys with more have (key, first, member) for each member, the first included, its `tag`, and whether it is `close` to the
    first by the tags. Keys are hashed to partitions and sorted within; a task streams them and holds one batch and
    one bucket, whatever a key's size.
    """

    def pairs(k, s, t):
        x, y = close_pairs(k, t, RADIUS)
        return pa.RecordBatch.from_arrays([pa.array(k[x]), pa.array(s[x]), pa.array(s[y]), pa.nulls(len(x), pa.int64()), pa.array(np.ones(len(x), bool))], names=names)

    def star(k, first, tag, s, t):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(first), pa.array(s), pa.array(t), pa.array(np.bitwise_count(tag ^ t) <= RADIUS)], names=names)

    def run(batches):
        held = [np.empty(0, np.int64)] * 3  # the last key's members until they are more than `bucket` or the next key comes
        big = None  # the last key with its first member and that one's tag, once it has more

        for batch in batches:
            full, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            k, t = full & _CODE, full >> 29
            if big:
                n = int(np.searchsorted(k, big[0], "right"))
                yield star(k[:n], np.full(n, big[1]), np.full(n, big[2]), s[:n], t[:n])
                if n == len(k):
                    continue
                k, s, t, big = k[n:], s[n:], t[n:], None
            k, s, t = (np.concatenate([h, c]) for h, c in zip(held, (k, s, t)))
            if not len(k):
                continue
            edge = np.concatenate([[0], np.nonzero(np.diff(k))[0] + 1])
            size = np.diff(np.concatenate([edge, [len(k)]]))
            first, tag, each = np.repeat(s[edge], size), np.repeat(t[edge], size), np.repeat(size, size)
            much, last = each > bucket, len(k)
            if size[-1] > bucket:
                big, held = (int(k[-1]), int(first[-1]), int(tag[-1])), [c[:0] for c in held]
            else:
                last = int(edge[-1])
                held = [c[last:] for c in (k, s, t)]
            yield star(*(c[much] for c in (k, first, tag, s, t)))
            few = ~much[:last]
            yield pairs(*(c[:last][few] for c in (k, s, t)))
        yield pairs(*held)

    names = ["key", "a", "b", "tag", "close"]
    code = F.col("key").bitwiseAND(F.lit(_CODE))
    return keyed.repartition(code).sortWithinPartitions(code, "set").mapInArrow(run, "key long, a long, b long, tag long, close boolean")


def _screened(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose SimHashes are near enough for a similarity of 0.8."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(k).flatten().to_numpy().view(np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= SCREEN * BANDS * TAG))

    with_a = pairs.join(classes.select(F.col("set").alias("a"), F.col("tags").alias("x")), "a")
    both = with_a.join(classes.select(F.col("set").alias("b"), F.col("tags").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are at least that similar."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}

        def sets(key, text):
            if key not in kept:
                if len(kept) >= _KEPT:
                    kept.clear()
                kept[key] = shingle_set(text, size)
            return kept[key]

        for batch in batches:
            a, b, x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            # A hair is allowed for, as 0.8 has no exact double.
            near = [similarity_of(sets(a[i], x[i].as_py()), sets(b[i], y[i].as_py())) >= similarity - 1e-12 for i in range(len(a))]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("set").alias("a"), F.col("t").alias("x")), "a")
    both = with_a.join(texts.select(F.col("set").alias("b"), F.col("t").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _texts(pairs: DataFrame, classes: DataFrame, hashed: DataFrame) -> DataFrame:
    """(set, t): a whole text of each set in `pairs`."""
    sets = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    wanted = sets.join(classes, "set").select("set", "text_hash")
    return stored(hashed.select("text_hash", "t").join(wanted, "text_hash").select("set", "t").dropDuplicates(["set"]))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY, extra: list[str] | None = None) -> DataFrame:
    """One row per row of `df`: `id_col`, columns `extra` and `component_id`, the smallest id reachable over links.

    Null ids are passed over, and a component of null ids only has null. Words are those of the fingerprints (ASCII-lower-cased,
    cut at blanks); null and texts without a word are alike. Repeated rows repeat with the same component. Other columns are
    not read, so their names don't matter.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the keys are made for a similarity of {SIMILARITY} or more")
    names = [f"c{i}" for i in range(len(extra or []))]
    plain = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"), *[F.col(f"`{c}`").alias(n) for c, n in zip(extra or [], names)])
    hashed = plain.withColumn("text_hash", F.xxhash64("t"))
    rows = stored(signatures(hashed, ["id", "text_hash", *names], "t", size))
    classes = stored(rows.groupBy("set").agg(F.min("id").alias("least"), F.min("text_hash").alias("text_hash"), F.any_value("keys").alias("keys"), F.any_value("tags").alias("tags")))
    found = stored(_proposed(_keyed(classes), BUCKET))
    pairs = stored(found.filter("close and a <> b").select("a", "b").distinct())
    near = stored(_screened(pairs, classes))
    texts = _texts(near, classes, hashed)
    links = stored(_verified(near, texts, size, similarity))
    roots = stored(components(links).withColumnRenamed("node", "set"))

    member = found.filter("tag is not null").select("key", F.col("b").alias("set"), "tag")
    member = stored(member.join(roots, "set", "left").select("key", "set", "tag", F.coalesce("root", "set").alias("root")))
    # Roots are paired first, so that a family's own pairs are never formed.
    root = stored(member.select("key", "root").distinct())
    ends = root.withColumnRenamed("root", "r").join(root.withColumnRenamed("root", "q"), "key").filter("r < q")
    one, other = (member.select("key", F.col("set").alias(s), F.col("tag").alias(f"tag_{s}"), F.col("root").alias(r)) for s, r in (("x", "r"), ("y", "q")))
    across = ends.join(one, ["key", "r"]).join(other, ["key", "q"]).filter(F.bit_count(F.col("tag_x").bitwiseXOR(F.col("tag_y"))) <= RADIUS)
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    late = stored(_screened(across.join(pairs, ["a", "b"], "left_anti"), classes))
    if not late.isEmpty():
        links = links.union(stored(_verified(late, _texts(late, classes, hashed), size, similarity)))
        roots = components(links).withColumnRenamed("node", "set")
    linked = classes.join(roots, "set")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    of = classes.join(linked.select("set", "root").join(lowest, "root").select("set", "lowest"), "set", "left")
    of = of.select("set", F.coalesce("lowest", "least").alias("component_id"))
    return rows.join(of, "set", "left").select(F.col("id").alias(id_col), *[F.col(n).alias(c) for c, n in zip(extra or [], names)], "component_id")
