"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums, over common three-letter subsequences with gaps (within SPAN letters, edges included),
the product of their weights DECAY ** gaps, over both strings' lengths; inserted characters lower a value but don't void
it, so `id.iot` and `idxiot` stay near `idiot`. Strings are a sentence's words, letters set apart by blanks (`i d i o t`)
drawn together, and phrases of two neighbouring words, whose blank is a character that may be skipped like any other. They
are mapped by Nyström features over landmark strings (the kernel to each landmark times the inverse root of the landmarks'
own kernel matrix), and a linear machine separates them. A sentence's margin is that of its worst string and a text's that
of its worst sentence: labels belong to whole texts, so training alternates between picking each toxic text's witnesses
and fitting (multiple-instance learning), with the strings of other texts, the closest ones first, as negatives. A string
is a witness by its rates: clearly more frequent in toxic texts than in others, so a mislabelled or quoting text doesn't
clear it. A logistic curve turns margins into scores.

A linear machine over Nyström features is a sum over landmarks, and so one weight per subsequence: scoring a string costs
time in its length alone. Training takes a bounded sample of labelled rows; scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_texts, stored
from .language_id import fold
from .linear_svm import fit, platt, sigmoid

SPAN, DECAY, BITS = 6, 0.7, 18
LANDMARKS = 320
#: Most labelled texts of each class that training takes (about), and most phrases it learns.
PER_CLASS, PHRASES = 1500, 200
#: How many times as frequent in toxic texts a witness must be, and how unlikely by chance (a likelihood ratio).
RATIO, SURE = 4.0, 12.0
_PAIRS = [(j, k, DECAY ** (k - 2)) for k in range(2, SPAN) for j in range(1, k)]
_MAX_WORDS = 300_000

#: Look-alikes become letters; marks inside a word vanish, other ASCII marks and digits part words.
_LOOKS = dict(zip(b"013457@$", b"oieastas"))
_INSIDE = b".-_*'~^`"
_CLEAN = bytes(
    _LOOKS.get(c, c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256)
)


_APART = re.compile(rb"(?<![^ ])[a-z](?: +[a-z]){2,}(?![^ ])")
_BANG = re.compile(rb"(?<=[A-Za-z])!(?=[A-Za-z])")
_SENTENCE = re.compile(rb"[.!?]+[ \t\r\n]+|\n+")


def cleaned(text: bytes) -> bytes:
    """A text's normalised words, set apart by blanks; `!` between letters is an i."""
    return _BANG.sub(b"i", text).translate(_CLEAN, _INSIDE)


def words_in(text: bytes) -> set[bytes]:
    """Distinct normalised words of a text, and letters set apart by blanks drawn together."""
    clean = cleaned(text)
    words = set(clean.split())
    if any(len(w) == 1 for w in words):
        words.update(m.group().replace(b" ", b"") for m in _APART.finditer(clean))
    return words


def phrases_in(text: bytes, known: dict[bytes, set[bytes]] | None = None) -> set[bytes]:
    """Pairs of neighbouring words of each sentence; with `known` (first word -> second words) only those."""
    out = set()
    if known is not None and not known:
        return out
    for sentence in _SENTENCE.split(text):
        words = cleaned(sentence).split()
        if known is None:
            out.update(map(b" ".join, zip(words, words[1:])))
        elif not known.keys().isdisjoint(words):
            out.update(a + b" " + b for a, b in zip(words, words[1:]) if a in known and b in known[a])
    return out


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row, hashed subsequence, weight over the word's length) of all gapped subsequences of the words."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    row = np.repeat(np.arange(len(words)), sizes)
    rows, keys, values = [], [], []
    for j, k, v in _PAIRS:
        if len(data) <= k:
            continue
        same = row[:-k] == row[k:]
        h = data[:-k] * np.uint32(0x9E3779B1) ^ data[j : len(data) - k + j] * np.uint32(0x85EBCA77) ^ data[k:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        keys.append((h >> np.uint32(32 - BITS))[same])
        rows.append(row[:-k][same])
        values.append(np.full(int(same.sum()), v))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0)
    rows_, keys_, values_ = map(np.concatenate, (rows, keys, values))
    size = np.sqrt(np.bincount(rows_, values_**2, len(words)))
    return rows_, keys_, values_ / np.maximum(size, 1e-9)[rows_]


class Landmarks:
    """Words with their subsequences, for kernels of other words to all of them at once."""

    def __init__(self, words: list[bytes]):
        rows, keys, values = subsequences(words)
        self.used = np.unique(keys)
        self.table = np.zeros((len(self.used) + 1, len(words)), np.float32)  # the last row stands for subsequences of none
        np.add.at(self.table, (np.searchsorted(self.used, keys), rows), values.astype(np.float32))

    def kernel(self, words: list[bytes], step: int = 200) -> np.ndarray:
        """Kernel matrix of words to landmarks, some words at a time."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for a in range(0, len(words), step):
            rows, keys, values = subsequences(words[a : a + step])
            at = np.searchsorted(self.used, keys)
            at[(at == len(self.used)) | (self.used[np.minimum(at, len(self.used) - 1)] != keys)] = len(self.used)
            known = np.nonzero(at < len(self.used))[0]
            known = known[np.argsort(rows[known], kind="stable")]
            if len(known):
                first = np.nonzero(np.diff(rows[known], prepend=-1))[0]
                part = self.table[at[known]] * values[known, None].astype(np.float32)
                out[a + rows[known][first]] = np.add.reduceat(part, first, axis=0)
        return out


class ToxicityModel:
    """Weights per subsequence, an offset, and the curve from margins to scores."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float, phrases: dict[bytes, set[bytes]] | None = None):
        self.weights, self.offset, self.slope, self.shift, self.phrases = weights, offset, slope, shift, phrases or {}
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def margins(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            rows, keys, values = subsequences(part)
            out[a : a + len(part)] = np.bincount(rows, self.weights[keys] * values, len(part))
        return out + self.offset

    def margin(self, texts: list[bytes | None]) -> list[float]:
        """Worst string's margin of each text; that of no resemblance at all without a word."""
        sets = [words_in(t) | phrases_in(t, self.phrases) if t else set() for t in texts]
        if len(self.known) > _MAX_WORDS:
            self.known.clear()
        new = list(set().union(*sets) - self.known.keys()) if sets else []
        self.known.update(zip(new, self.margins(new).tolist()))
        get = self.known.__getitem__
        return [max(map(get, s)) if s else min(self.offset, -1.0) for s in sets]

    def scores(self, texts: list[bytes | None]) -> list[float]:
        return sigmoid(self.slope * np.array(self.margin(texts)) + self.shift).tolist() if texts else []


def _varied(words: list[bytes], seed: int) -> list[bytes]:
    """Each word with a letter put in at every inner place, and one letter doubled."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for w in words:
        inner = [i for i in range(1, len(w)) if w[i] < 128 and w[i - 1] < 128]
        out += [w[:i] + bytes([97 + int(rng.integers(26))]) + w[i:] for i in inner if len(w) > 3]
        if len(w) > 4 and inner:
            i = inner[int(rng.integers(len(inner)))]
            out.append(w[:i] + w[i - 1 : i] + w[i:])
    return list(dict.fromkeys(out))


def _telling(pos: Counter, neg: Counter, n_pos: int, n_neg: int) -> dict[bytes, float]:
    """Strings clearly more frequent in toxic texts, with how sure that is."""
    out = {}
    for w, a in pos.items():
        b = neg.get(w, 0)
        if a < 2 or a * n_neg < RATIO * b * n_pos:
            continue
        all_ = n_pos + n_neg
        g = 2 * (a * np.log(a * all_ / ((a + b) * n_pos)) + (b * np.log(b * all_ / ((a + b) * n_neg)) if b else 0.0))
        if g >= SURE:
            out[w] = g
    return out


def _without_copies(bags: list, labels: list[int]) -> list[tuple]:
    """Of bags of one label that share most words the first: copies of one text would pass for evidence."""
    rng = np.random.Generator(np.random.PCG64(3))
    times = rng.integers(0, 1 << 63, 16, np.uint64) | np.uint64(1)
    met: dict[tuple, int] = {}
    kept = []
    for bag, y in zip(bags, labels):
        words = [w for w in bag if b" " not in w]
        if not words:
            continue
        low = (np.fromiter(map(hash_of, words), np.uint64, len(words))[:, None] * times).min(axis=0)
        keys = [(y, k, *low[4 * k : 4 * k + 4].tolist()) for k in range(4)]
        if not any(k in met and 5 * len(set(bag).intersection(kept[met[k]][0])) >= 3 * max(len(bag), len(kept[met[k]][0])) for k in keys):
            for k in keys:
                met.setdefault(k, len(kept))
            kept.append((bag, y))
    return kept


def train_on(bags: list, labels: list[int], landmarks: int = LANDMARKS, rounds: int = 3) -> ToxicityModel:
    """A model from texts' distinct words and phrases (any collection of them) and their labels (1: toxic). Deterministic; all-negative scores where nothing tells the classes apart."""
    kept = _without_copies(bags, labels)
    toxic, clean = [b for b, y in kept if y], [b for b, y in kept if not y]
    empty = ToxicityModel(np.zeros(1 << BITS), -1.0, 2.0, -2.0)
    if not toxic or not clean:
        return empty
    pos, neg = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    telling = _telling(pos, neg, len(toxic), len(clean))
    words = {w for w in telling if b" " not in w}
    # A phrase counts where it tells more than its words do.
    pairs = sorted((p for p in telling if b" " in p and words.isdisjoint(p.split(b" "))), key=lambda p: (-telling[p], p))[:PHRASES]
    phrases: dict[bytes, set[bytes]] = {}
    for p in pairs:
        phrases.setdefault(p.split(b" ")[0], set()).add(p.split(b" ")[1])
    # Other phrases stay out of the bags, but for some of clean texts that share a word with one: they are negatives.
    near = {w for p in pairs for w in p.split(b" ")}
    beside = [p for p, _ in sorted(neg.items(), key=lambda x: (-x[1], x[0])) if b" " in p and p not in telling and not near.isdisjoint(p.split(b" "))][:3000]
    own = words | set(pairs)
    toxic, clean = ([tuple(w for w in b if b" " not in w or w in own) for b in group] for group in (toxic, clean))
    del kept
    neg = Counter({w: n for w, n in neg.items() if b" " not in w})
    if not own:
        return empty
    witness = [max(sorted(b), key=lambda w: telling.get(w, 0.0)) for b in toxic if not own.isdisjoint(b)]
    by_count = sorted((w for w in neg if w not in own), key=lambda w: (-neg[w], w))
    rng = np.random.Generator(np.random.PCG64(11))
    some = [by_count[i] for i in sorted(rng.choice(len(by_count), min(9000, len(by_count)), replace=False))]
    negatives = list(dict.fromkeys(by_count[:2500] + some + beside))
    vocabulary = sorted(set().union(*toxic, *clean))
    model = empty
    for turn in range(rounds):
        found = Counter(w for w in witness if w in own)
        positives = [w for w, _ in found.most_common()]
        if turn:  # all telling strings on the toxic side of the machine
            rest = sorted(own)
            positives = list(dict.fromkeys(positives + [w for w, m in zip(rest, model.margins(rest)) if m > 0.0]))
        varied = [w for w in _varied(positives, 5) if neg.get(w, 0) == 0]
        marks = list(dict.fromkeys(positives[: landmarks // 2] + negatives[: landmarks // 2]))
        land = Landmarks(marks)
        between = land.kernel(marks).astype(np.float64)
        value, vector = np.linalg.eigh((between + between.T) / 2)
        good = value > 1e-4 * value[-1]
        root = vector[:, good] / np.sqrt(value[good])
        items = positives + varied + negatives
        x = land.kernel(items) @ root.astype(np.float32)
        y = np.array([1.0] * (len(positives) + len(varied)) + [-1.0] * len(negatives))
        counts = np.array([1.0 + np.log1p(found[w]) for w in positives] + [0.4] * len(varied) + [1.0] * len(negatives))
        counts = np.where(y > 0, counts / counts[y > 0].sum(), counts / counts[y < 0].sum())
        w, b = fit(x, y, counts, reg=1e-4, steps=400)
        beta = root @ w
        rows, keys, values = subsequences(marks)
        weights = np.bincount(keys, beta[rows] * values, 1 << BITS)
        model = ToxicityModel(weights, b, 2.0, 0.0, phrases)
        margin_of = dict(zip(vocabulary, model.margins(vocabulary).tolist()))
        witness = [max(bag, key=lambda w: (margin_of[w], w)) for bag in toxic]
        hard = sorted((w for w in neg if w not in own), key=lambda w: (-margin_of[w], w))[:4000]
        negatives = list(dict.fromkeys(hard[: landmarks // 4] + by_count[: landmarks // 4] + hard + negatives))
    worst = np.array([max(map(margin_of.__getitem__, b)) for b in toxic + clean])
    slope, shift = platt(worst, np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return ToxicityModel(model.weights.astype(np.float32), model.offset, slope, shift, phrases)


def hash_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 3)


def train(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, landmarks: int = LANDMARKS) -> ToxicityModel:
    """A model from texts joined with their labels (null ids, texts and labels teach nothing).

    At most about 1.5 * `per_class` labelled texts of each class, those with the least id hashes, are read for it: their
    ids are few, so they are broadcast; their distinct words and phrases are what reaches the driver. Of an id's several
    texts the one with the least hash is taken, so repeated rows don't add to the sample.
    """
    told = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("i is not null and y is not null")
    told = told.groupBy("i").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    chosen = None
    for y in (0, 1):
        part = told.filter((F.col("y") == y) & (u < min(1.0, 1.5 * per_class / max(counts.get(y, 0), 1))))
        chosen = part if chosen is None else chosen.unionAll(part)
    named = texts.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("t is not null")
    sample = stored(named.join(F.broadcast(chosen), "i").groupBy("i").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.max("y").alias("y")))
    # Phrases are counted where the texts are; only those that may tell, and some beside them, reach the driver.
    array = T.StructType([field("p", T.ArrayType(T.BinaryType()))])
    each = map_texts(sample, ["y"], "t", array, lambda: lambda made: {"p": [sorted(phrases_in(t)) for t in made]}).select("y", F.explode("p").alias("p"))
    total = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    counted = each.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).persist()
    often = counted.filter((F.col("a") >= 3) & (F.col("a") * total.get(0, 0) >= RATIO * F.col("b") * total.get(1, 0))).orderBy(F.desc("a"), "b", "p").limit(10 * PHRASES)
    keep = {bytes(r["p"]) for r in often.collect()}
    near = sorted({w for p in keep for w in p.split(b" ")})
    if near:
        shared = counted.filter("b > 1").withColumn("w", F.split(F.decode("p", "utf-8"), " ")).filter(F.arrays_overlap("w", F.array(*[F.lit(w.decode("utf-8", "replace")) for w in near])))
        keep |= {bytes(r["p"]) for r in shared.orderBy(F.desc("b"), "p").limit(3000).collect()}
    counted.unpersist()

    def start():
        return lambda made: {"words": [sorted(words_in(t) | (phrases_in(t) & keep if keep else set())) for t in made]}

    rows = map_texts(sample, ["i", "y"], "t", T.StructType([field("words", T.ArrayType(T.BinaryType()))]), start).toLocalIterator()
    # One object a string, and tuples of them: texts share most of their words, and the driver holds them all.
    known: dict[bytes, bytes] = {}
    got = sorted(((r["i"], r["y"], tuple(known.setdefault(w, w) for w in map(bytes, r["words"]))) for r in rows), key=lambda r: (r[0], r[1]))
    del known
    return train_on([r[2] for r in got], [r[1] for r in got], landmarks)


def score_toxicity(df: DataFrame, model: ToxicityModel, id_cols: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """`id_cols` of each row and `score` (0 to 1) of its whole text; null and empty texts score as text without a word."""

    def start():
        return lambda texts: {"score": model.scores(texts)}

    return map_texts(df, id_cols or ["doc_id"], text_col, T.StructType([field("score", T.DoubleType())]), start)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 2, folds: int = 4, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """`id_col`, `held_out`, `score`, `predicted` of every row; labels are learned only from ids that aren't held out.

    A row is held out if crc32 of its id as text is `held_out` modulo `folds`; a null id isn't, and teaches nothing. Of an
    id with several labels the greatest counts. Without labels of both classes every text scores low.
    """
    part = fold(F.col(f"`{id_col}`"), folds)
    model = train(df.filter(part != held_out), labels.filter(part != held_out), id_col, text_col, label_col, per_class)
    out = score_toxicity(df, model, [id_col], text_col)
    return out.select(f"`{id_col}`", F.coalesce(part == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
