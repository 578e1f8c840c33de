"""Benchmark decontamination with SimHash windows the size of each item.

For every benchmark item, windows of a document with as many words as the item are fingerprinted (64-bit SimHash over
weighted five-word shingles) and compared with it. A multi-index over eight 8-bit blocks finds candidates: fingerprints
within RADIUS = 23 bits differ in at most 2 bits of some block (pigeonhole), so a block table of all bytes within 2 bits
of an item's byte misses none. The weighted Jaccard similarity of the shingles then decides exactly.

A window at 0.8 shares at least 0.8 of an item's weight, so it holds one of any of its shingles that together weigh more
than the other 0.2. The rarest such shingles among the items are its anchors: only windows with an anchor of an item are
fingerprinted and compared with it, and none at 0.8 is lost by that. (The Hamming blocks alone would let most random pairs
through: two bytes of 8 bits are within 2 of each other in one of 7 cases, and any of eight blocks suffices.)
Items are the stated query set: they go to the tasks in blocks of bounded size, and every document is read whole against
each block; with several blocks each one's hits are written before the next is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, filter_texts, map_texts, stored
from .license_scan import words_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
#: Items and bytes of item text that one broadcast block holds at most (a longer item stands alone).
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_MAX_WORDS = 500_000


class WordHashes(dict):
    """Hash of each word met, bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles_of(words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, int]:
    """Hash of each run of five words (fewer words: of all of them as one), and the words in a run."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _MIX[k]
        out ^= out >> np.uint64(29)
    return out, size


def weights_of(words: list[bytes], size: int) -> np.ndarray:
    """Weight of each run of `size` words: the bytes of its words."""
    total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.float64, len(words)))])
    return total[size:] - total[:-size]


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of a remix of the hashes (rows of 64)."""
    x = hashes * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


@dataclass
class Item:
    item_id: object
    n_words: int
    counts: dict[int, int]
    weights: dict[int, float]
    total: float


class ItemIndex:
    """A block of items: their shingles, and per window size their fingerprints with the Hamming block tables."""

    def __init__(self, items: list[tuple[object, bytes]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.hashes = WordHashes()
        self.items: list[Item] = []
        prints: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            sh, size = shingles_of(words, self.hashes)
            w = weights_of(words, size)
            counts: dict[int, int] = {}
            for s in sh.tolist():
                counts[s] = counts.get(s, 0) + 1
            weights = dict(zip(sh.tolist(), w.tolist()))
            fp = int(_packed((_bits(sh) * w[:, None]).sum(axis=0)[None, :])[0])
            prints.setdefault(len(words), []).append((len(self.items), fp))
            self.items.append(Item(item_id, len(words), counts, weights, float(w.sum())))
        self._choose_anchors()
        self.short = any(i.n_words < SHINGLE for i in self.items)
        near = [np.array([v for v in range(256) if bin(v ^ x).count("1") <= RADIUS // BLOCKS]) for x in range(256)]
        self.by_size: dict[int, tuple[list[int], np.ndarray, np.ndarray]] = {}
        for n, group in prints.items():
            tables = np.zeros((BLOCKS, 256, len(group)), bool)
            for k, (_, fp) in enumerate(group):
                for b in range(BLOCKS):
                    tables[b, near[fp >> 8 * b & 255], k] = True
            self.by_size[n] = ([k for k, _ in group], np.array([fp for _, fp in group], np.uint64), tables)

        self.place = {k: (n, col) for n, (group, _, _) in self.by_size.items() for col, k in enumerate(group)}

    def _choose_anchors(self) -> None:
        """Sorted anchor shingles, and the items of each (`owners[first[i]:first[i + 1]]`)."""
        common: dict[int, int] = {}
        for i in self.items:
            for s in i.counts:
                common[s] = common.get(s, 0) + 1
        owned: dict[int, list[int]] = {}
        for k, i in enumerate(self.items):
            weight = 0.0
            for s in sorted(i.counts, key=lambda s: (common[s], s)):
                owned.setdefault(s, []).append(k)
                weight += i.counts[s] * i.weights[s]
                if weight > (1 - self.similarity) * i.total * (1 + 1e-9):
                    break
        keys = sorted(owned)
        self.shingles = np.array(keys, np.uint64)
        self.owners = np.array([k for s in keys for k in owned[s]], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(owned[s]) for s in keys])]).astype(np.int64)

    def candidates(self, prints: np.ndarray, item: int) -> np.ndarray:
        """Rows of all fingerprints within RADIUS of an item's, through the block tables."""
        size, col = self.place[item]
        _, own, tables = self.by_size[size]
        hit = np.zeros(len(prints), bool)
        for b in range(BLOCKS):
            hit |= tables[b, (prints >> np.uint64(8 * b)).astype(np.int64) & 255, col]
        row = np.nonzero(hit)[0]
        return row[np.bitwise_count(prints[row] ^ own[col]) <= RADIUS]

    def hits(self, text: bytes, similarity: float) -> list[tuple[object, int, int, float]]:
        """(item id, first word, end word, similarity) of item-sized windows at least that similar, none overlapping per item."""
        if similarity < self.similarity:
            raise ValueError(f"the anchors are made for a similarity of {self.similarity} or more")
        words = words_of(text)
        if not words or not len(self.shingles):
            return []
        sh, size = shingles_of(words, self.hashes)
        at = np.searchsorted(self.shingles, sh)
        at[at == len(self.shingles)] = 0
        anchor = np.nonzero(self.shingles[at] == sh)[0]
        out = []
        if size == SHINGLE and len(anchor):
            out += self._windows(words, sh, anchor, at[anchor], similarity)
        if self.short:
            out += self._short(words)
        return out

    def _short(self, words: list[bytes]) -> list[tuple[object, int, int, float]]:
        """Items of fewer than five words are one shingle: a window is that shingle or isn't similar at all."""
        out = []
        for n in {i.n_words for i in self.items if i.n_words < SHINGLE}:
            if len(words) < n:
                continue
            group = {next(iter(i.counts)) for i in self.items if i.n_words == n}
            h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
            m = len(words) - n + 1
            sh = np.zeros(m, np.uint64)
            for k in range(n):
                sh += h[k : k + m] * _MIX[k]
                sh ^= sh >> np.uint64(29)
            for p in np.nonzero(np.isin(sh, np.array(list(group), np.uint64)))[0].tolist():
                same = [i for i in self.items if i.n_words == n and int(sh[p]) in i.counts]
                out += [(i.item_id, p, p + n, 1.0) for i in same]
        return out

    def _windows(self, words, sh, anchor, which, similarity):
        w = weights_of(words, SHINGLE)
        found: dict[int, list[tuple[float, int]]] = {}
        # Places of each item's anchors in the text.
        n_owners = self.first[which + 1] - self.first[which]
        spot = np.repeat(anchor, n_owners)
        item = self.owners[np.repeat(self.first[which], n_owners) + np.arange(len(spot)) - np.repeat(np.cumsum(n_owners) - n_owners, n_owners)]
        order = np.lexsort((spot, item))
        spot, item = spot[order], item[order]
        edge = np.concatenate([[0], np.nonzero(np.diff(item))[0] + 1, [len(item)]])
        for e, f in zip(edge[:-1].tolist(), edge[1:].tolist()):
            k, at = int(item[e]), spot[e:f]
            n = self.items[k].n_words
            m = n - SHINGLE + 1
            if n < SHINGLE:
                continue
            if len(words) < n:  # the whole document is the window; its weight bounds the similarity
                if similarity * self.items[k].total <= w.sum() and (s := self._similar(self.items[k], sh, w)) >= similarity:
                    found.setdefault(k, []).append((s, 0))
                continue
            # Starts of windows with an anchor in them, as ranges that don't overlap.
            last = len(sh) - m
            lo, hi = np.maximum(at - m + 1, 0), np.minimum(at, last)
            fresh = np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1] + 1])
            begins = lo[fresh]
            ends = np.maximum.accumulate(hi)[np.concatenate([np.nonzero(fresh)[0][1:] - 1, [len(hi) - 1]])]
            for a, b in zip(begins.tolist(), ends.tolist()):
                for c in range(a, b + 1, 4096):
                    d = min(c + 4095, b)
                    part = np.concatenate([np.zeros((1, 64)), np.cumsum(_bits(sh[c : d + m]) * w[c : d + m, None], axis=0)])
                    prints = _packed(part[m:] - part[:-m])
                    for r in self.candidates(prints, k).tolist():
                        s = self._similar(self.items[k], sh[c + r : c + r + m], w[c + r : c + r + m])
                        if s >= similarity:
                            found.setdefault(k, []).append((s, c + r))
        out = []
        for k, places in found.items():
            taken: list[int] = []
            n = self.items[k].n_words
            for s, p in sorted(places, key=lambda x: (-x[0], x[1])):
                if all(abs(p - q) >= n for q in taken):
                    taken.append(p)
                    out.append((self.items[k].item_id, p, min(p + n, len(words)), s))
        return out

    @staticmethod
    def _similar(item: Item, hashes: np.ndarray, weights: np.ndarray) -> float:
        """Weighted Jaccard similarity of two multisets of shingles: common weight over all weight."""
        counts: dict[int, int] = {}
        both = 0.0
        for s in hashes.tolist():
            c = counts[s] = counts.get(s, 0) + 1
            if c <= item.counts.get(s, 0):
                both += item.weights[s]
        return both / (item.total + float(weights.sum()) - both)


_HIT = T.StructType([field("item", T.StringType()), field("start", T.LongType()), field("end", T.LongType()), field("similarity", T.DoubleType())])


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """Items (id as text) in blocks of bounded count and size, each fetched by itself; null ids or texts are left out."""
    named = items.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).dropna()
    n, size = named.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    place = F.pmod(F.xxhash64("i"), F.lit(blocks))
    for k in range(blocks):
        yield [(r.i, r.t.encode()) for r in named.filter(place == k).orderBy("i").collect()]


def benchmark_hits(
    df: DataFrame,
    items: DataFrame,
    id_cols: list[str] | None = None,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row per place where a document repeats a benchmark item: `id_cols`, item (of its own type), start, end (words), similarity.

    Words are lower-cased runs of ASCII letters, digits and other characters. Of overlapping windows of one item the most
    similar one is given, the first on ties; places of different items may overlap. Documents without a hit have no row,
    nor do null or empty texts; repeated rows repeat; items that are null or have no word match nothing; items of fewer
    than five words match where they stand word for word. No items or no documents: no rows.
    """
    ids = id_cols or ["doc_id"]
    names = [f"c{i}" for i in range(len(ids))]
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(ids, names)], F.col(f"`{text_col}`").alias("t"))
    id_type = items.schema[item_id].dataType
    out = None
    for block in item_blocks(items, item_id, item_text):
        def start(block=block):
            index = ItemIndex(block, similarity)

            def work(texts):
                return {"hits": [[{"item": i, "start": a, "end": b, "similarity": s} for i, a, b, s in index.hits(t, similarity)] if t else [] for t in texts]}

            return work

        made = map_texts(plain, names, "t", T.StructType([field("hits", T.ArrayType(_HIT))]), start)
        part = made.select(*names, F.explode("hits").alias("h")).select(*names, F.col("h.item").cast(id_type).alias("item"), "h.start", "h.end", "h.similarity")
        if len(block) < BLOCK_ITEMS and out is None:
            out = part
        else:  # one of several blocks: written, so that neither its items nor its plan is held on
            part = stored(part)
            out = part if out is None else out.unionAll(part)
    return out.toDF(*ids, "item", "start", "end", "similarity")


def without_benchmark(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `df` whose whole text repeats no item; all columns stay, null and empty texts too."""
    for block in item_blocks(items, item_id, item_text):
        def start(block=block):
            index = ItemIndex(block, similarity)
            return lambda texts: [not t or not index.hits(t, similarity) for t in texts]

        df = filter_texts(df, text_col, start)
    return df

