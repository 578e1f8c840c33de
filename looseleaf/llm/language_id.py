"""Hierarchical language identification: family first, then one-versus-one linear SVMs between its languages.

Features are hashed byte 2- and 3-grams of the whole text (ASCII lower-cased, digits and ASCII punctuation as blanks),
as square roots of their shares. Training takes at most `per_language` documents of each language, those with the least
id hashes, so the fit is bounded and repeatable; prediction reads every text whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_texts
from .linear_svm import fit, sigmoid

FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic", "sl": "slavic",
}
PER_LANGUAGE = 300
BITS = 13
_PIECE = 1 << 20
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed 2- and 3-grams of a text."""
    d = np.frombuffer(b" " + b" ".join(text.translate(_CLEAN).split()) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(d), _PIECE):
        p = d[a : a + _PIECE + 2]
        two = p[:-1] * np.uint32(0x9E3779B1) + p[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + p[2:] * np.uint32(0x27D4EB2F)
        for h in (two, three):
            out += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def as_features(counts: np.ndarray) -> np.ndarray:
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts.astype(np.float64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class LanguageModel:
    """One-versus-one machines between families and between the languages of each family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str]):
        self.langs = sorted(set(langs))
        self.family_of = {v: families.get(v, v) for v in self.langs}
        self.families = sorted(set(self.family_of.values()))
        labels = np.array(langs)
        groups = np.array([self.family_of[v] for v in langs])
        self.pairs: list[tuple[str, str, str]] = []  # (level, first, second); a positive margin speaks for the first
        columns, offsets = [], []

        def learn(level, names, of):
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    rows = (of == a) | (of == b)
                    y = np.where(of[rows] == a, 1.0, -1.0)
                    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
                    w, c = fit(x[rows], y, share)
                    self.pairs.append((level, a, b))
                    columns.append(w.astype(np.float32))
                    offsets.append(c)

        learn("", self.families, groups)
        for f in self.families:
            learn(f, [v for v in self.langs if self.family_of[v] == f], labels)
        self.w = np.stack(columns, axis=1) if columns else np.zeros((1 << BITS, 0), np.float32)
        self.b = np.array(offsets)

    def _choose(self, level: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """Winner by votes, then by summed margins, then by name; and how clearly it beats its closest rival."""
        votes = {v: [0, 0.0] for v in names}
        worst = {v: np.inf for v in names}
        for (at, a, b), m in zip(self.pairs, margins):
            if at == level and a in votes and b in votes:
                for v, s in ((a, m), (b, -m)):
                    votes[v][0] += s > 0
                    votes[v][1] += s
                    worst[v] = min(worst[v], s)
        best = min(names, key=lambda v: (-votes[v][0], -votes[v][1], v))
        return best, float(sigmoid(4.0 * worst[best])) if np.isfinite(worst[best]) else 1.0

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text.decode()):
            return "und", 0.0
        margins = as_features(gram_counts(text)) @ self.w + self.b
        family, sure = self._choose("", self.families, margins)
        lang, surer = self._choose(family, [v for v in self.langs if self.family_of[v] == family], margins)
        return lang, sure * surer


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None) -> LanguageModel:
    """A model from rows with a language and a text; a bounded sample by id hash, at most `per_language` of each language.

    Counts per language come from all rows; only the sampled rows' features reach the driver.
    """
    named = labelled.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("lang")).filter("i is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * per_language / n)))]) if counts else None
    if share is None:
        return LanguageModel(np.zeros((0, 1 << BITS)), [], families or FAMILIES)
    sample = named.withColumn("u", u).filter(F.col("t").isNotNull() & (F.col("u") < F.element_at(share, F.col("lang"))))

    def start():
        def work(texts):
            made = [gram_counts(t or b"") for t in texts]
            at = [np.nonzero(m)[0] for m in made]
            return {"at": [a.tolist() for a in at], "n": [m[a].tolist() for m, a in zip(made, at)], "ok": [bool(t) and has_letter(t.decode()) for t in texts]}

        return work

    new = T.StructType([field("at", T.ArrayType(T.IntegerType())), field("n", T.ArrayType(T.LongType())), field("ok", T.BooleanType())])
    taken: dict[str, list] = {}
    rows = map_texts(sample, ["lang", "u", "i"], "t", new, start).filter("ok").toLocalIterator()
    for r in sorted(rows, key=lambda r: (r["lang"], r["u"], r["i"])):
        group = taken.setdefault(r["lang"], [])
        if len(group) < per_language:
            group.append(r)
    x = np.zeros((sum(map(len, taken.values())), 1 << BITS))
    langs = []
    for r in (r for group in taken.values() for r in group):
        x[len(langs), r["at"]] = r["n"]
        langs.append(r["lang"])
    return LanguageModel(np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)), langs, families or FAMILIES)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(id_col.cast("string")) % folds


def predict_languages(df: DataFrame, model: LanguageModel, id_cols: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """`id_cols` of each row, `lang_pred` (a learned language; `und` for null texts, texts without a letter, or no model) and `score`.

    One row out per row in, ties broken by name; nothing but the text decides.
    """

    def start():
        def work(texts):
            got = [model.predict(t) for t in texts]
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return work

    return map_texts(df, id_cols or ["doc_id"], text_col, T.StructType([field("lang_pred", T.StringType()), field("score", T.DoubleType())]), start)


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 0, folds: int = 5, per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None) -> DataFrame:
    """`id_col`, `held_out`, `lang_pred`, `score` of every row; the model learns from the rows that aren't held out.

    A row is held out if crc32 of its id as text is `held_out` modulo `folds`; rows with a null id aren't, and teach nothing.
    """
    part = fold(F.col(f"`{id_col}`"), folds)
    model = train(df.filter(part != held_out), id_col, text_col, lang_col, per_language, families)
    out = predict_languages(df, model, [id_col], text_col)
    return out.select(f"`{id_col}`", F.coalesce(part == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
