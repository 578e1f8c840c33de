"""Queries over (key, doc) tables: predicate, projection, inclusive key range, limit; answers in key order."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import VariantPath
from .predicates import TRUE, Predicate, compile_predicate


@dataclass(frozen=True)
class Projection:
    """What a row holds besides its key: nothing, the document, or the values at named locations."""

    paths: tuple[str, ...] | None = None
    whole: bool = False

    @classmethod
    def of(cls, *paths: str) -> "Projection":
        """Locations only; a wildcard is refused. A column is named by its path's text."""
        for p in paths:
            VariantPath.parse(p)
        return cls(tuple(paths))

    def columns(self, doc: str = "doc") -> list[Column]:
        if self.whole:
            return [F.col(doc)]
        # An absent value is null; a JSON null stays a variant null.
        return [F.try_variant_get(F.col(doc), VariantPath.parse(p).spark(), "variant").alias(p) for p in self.paths or ()]


KEYS, DOCUMENT = Projection(), Projection(whole=True)


@dataclass(frozen=True)
class Query:
    predicate: Predicate = TRUE
    projection: Projection = KEYS
    first: object = None
    last: object = None
    limit: int | None = None

    @classmethod
    def where(cls, predicate: Predicate) -> "Query":
        return cls(predicate)

    def project(self, projection: Projection) -> "Query":
        return replace(self, projection=projection)

    def range(self, first=None, last=None) -> "Query":
        """Keys from `first` to `last`, both included; None leaves a side open."""
        return replace(self, first=first, last=last)

    def take(self, n: int) -> "Query":
        if n < 0:
            raise ValueError("a limit can't be negative")
        return replace(self, limit=n)

    def on(self, docs: DataFrame, key: str = "key", doc: str = "doc", ordered: bool = True) -> DataFrame:
        """The answer over a table with one row per live key. `ordered=False` leaves the global sort to the caller.

        With a limit the first rows in key order are kept per task before they meet, so no full sort takes place.
        """
        found = in_range(docs, self.first, self.last, key)
        if self.predicate != TRUE:
            found = found.filter(compile_predicate(self.predicate, doc))
        found = found.select(key, *self.projection.columns(doc))
        if self.limit is not None:
            return found.orderBy(key).limit(self.limit)
        return found.orderBy(key) if ordered else found

    def keys(self, docs: DataFrame, key: str = "key", doc: str = "doc") -> list:
        """All matching keys, in order, on the driver; for answers known to be small."""
        return [r[0] for r in replace(self, projection=KEYS).on(docs, key, doc).collect()]


def in_range(docs: DataFrame, first=None, last=None, key: str = "key") -> DataFrame:
    if first is not None:
        docs = docs.filter(F.col(key) >= F.lit(first))
    return docs.filter(F.col(key) <= F.lit(last)) if last is not None else docs


def with_prefix(docs: DataFrame, prefix, key: str = "key") -> DataFrame:
    """Rows whose key begins with `prefix` (bytes or text); an empty prefix keeps all."""
    return docs.filter(F.startswith(F.col(key), F.lit(prefix))) if prefix else docs


def successor(key: bytes) -> bytes:
    """The next key in byte order."""
    return key + b"\0"


def row_json(projection: Projection, doc: str = "doc") -> Column:
    """A row as JSON text: the document, `{}` for keys only, else an object of the named values (null where absent)."""
    if projection.whole:
        return F.to_json(doc)
    parts: list[Column] = [F.lit("{")]
    for i, p in enumerate(projection.paths or ()):
        value = F.coalesce(F.to_json(F.col(f"`{p}`")), F.lit("null"))
        parts += [F.lit(("," if i else "") + json.dumps(p, ensure_ascii=False) + ":"), value]
    return F.concat(*parts, F.lit("}"))
