"""The schema model: path statistics of documents as a two-level aggregation.

Tasks walk their documents once and emit, per Arrow batch and path, a partial sketch (counts per kind, bytes, bounds) and
the distinct value signatures; Spark then merges partials per path. Distinct counts come from a theta sketch, exact below
its 1024 entries and mergeable, so no path's values ever meet in one place. What reaches a task grows with the number of
paths, not with the data.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variant_bytes
from ..functions.paths import ANY_ELEMENT, CatalogPath, Field

SCALARS = ["NULL", "BOOLEAN", "INTEGER", "DECIMAL", "DOUBLE", "FLOAT", "STRING", "BINARY", "DATE", "TIME", "TIMESTAMP", "UUID"]
KINDS = [*SCALARS, "ARRAY", "OBJECT"]
NUMERIC = ["INTEGER", "DECIMAL", "DOUBLE", "FLOAT"]


@dataclass(frozen=True)
class Budgets:
    paths: int = 1024
    depth: int = 32
    children: int = 65_536
    text_bytes: int = 64


def signature(kind: str, x) -> bytes | None:
    """Identity of a scalar: a tag and its canonical text; equal numbers of any width are one value; none for null."""
    if kind in NUMERIC:
        if isinstance(x, int):
            return b"1%d" % x
        if isinstance(x, float) and not math.isfinite(x):
            return b"1" + repr(x).encode()
        d = Decimal(repr(x)) if isinstance(x, float) else Decimal(x)
        text = f"{d:f}"
        if "." in text:
            text = text.rstrip("0").rstrip(".")
        return b"1" + (b"0" if text in ("-0", "") else text.encode())
    if kind == "STRING":
        return b"2" + x.encode()
    if kind == "BOOLEAN":
        return b"01" if x else b"00"
    if kind == "NULL" or x is None:
        return None
    return {"BINARY": b"3", "UUID": b"5"}.get(kind, b"4") + bytes(x)


def path_of(collapsed: tuple) -> CatalogPath:
    return CatalogPath(tuple(ANY_ELEMENT if x is None else Field(x) for x in collapsed))


_BOUND = "struct<rank:string,digits:string>"
_PARTIAL = f"path string, kind string, n long, bytes long, low {_BOUND}, high {_BOUND}, first string, last string, cuts long, sigs array<long>"
_NINES = str.maketrans("0123456789", "9876543210")


def _number(kind: str, x) -> Decimal | None:
    if kind not in NUMERIC or isinstance(x, float) and not math.isfinite(x):
        return None
    return Decimal(repr(x)) if isinstance(x, float) else Decimal(x)


def rank_of(d: Decimal) -> str:
    """A text whose byte order is the order of numbers, whatever their width: sign, exponent, digits."""
    if not d:
        return "1"
    places = "".join(map(str, d.as_tuple().digits)).rstrip("0")
    if d > 0:
        return f"2{d.adjusted() + 50_000:05d}{places}"
    return f"0{50_000 - d.adjusted():05d}{places.translate(_NINES)}~"


def spelled_number(d: Decimal) -> str:
    """A number's digits without trailing zeros; with an exponent where it is far from the ones."""
    sign, digits, exponent = d.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    bare = text.rstrip("0")
    if not bare:
        return "0"
    short = Decimal((sign, tuple(map(int, bare)), exponent + len(text) - len(bare)))
    return f"{short:f}" if -40 < short.adjusted() < 40 else str(short)


def _bound(d: Decimal | None) -> dict | None:
    return None if d is None else {"rank": rank_of(d), "digits": spelled_number(d)}


def partial_sketch(docs: DataFrame, doc: str = "doc", budgets: Budgets = Budgets()) -> DataFrame:
    """Partial sketches: rows of (path, kind) with counts and bounds, and rows of (path, sig) for distinct scalars."""

    def run(batches):
        for batch in batches:
            root = variant_bytes.tally(((v["value"], v["metadata"]) for v in batch.column(0).to_pylist() if v is not None), budgets.depth, budgets.children)
            rows = [row for path, at in root.everywhere() for row in _rows_of(path, at, budgets)]
            cols = list(zip(*rows)) if rows else [[]] * 10
            bound = pa.struct([("rank", pa.string()), ("digits", pa.string())])
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), bound, bound, pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            fixed = [[_bound(x) for x in col] if t is bound else col for col, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(fixed, types)], names=["path", "kind", "n", "bytes", "low", "high", "first", "last", "cuts", "sigs"])

    partial = docs.select(F.col(doc).alias("doc")).mapInArrow(run, _PARTIAL)
    return partial.select("*", F.explode_outer("sigs").alias("sig")).drop("sigs")


def _rows_of(path: tuple, at: variant_bytes.Tally, budgets: Budgets) -> list[tuple]:
    """A batch's partial rows of one path: one per kind, and one with the signatures of the distinct scalars."""
    spelled = str(path_of(path))
    out: list[tuple] = [(spelled, kind, n, size, None, None, None, None, cuts, None) for kind, (n, size, cuts) in at.containers.items()]
    kinds: dict[str, list] = {}
    for raw, n in at.scalars.items():  # each encoding is read once, however often it stands
        kind, x, size = variant_bytes.scalar(raw, 0)
        c = kinds.setdefault(kind, [0, 0, []])
        c[0] += n
        c[1] += n * size
        c[2].append(x)
    sigs: set[bytes] = set()
    for kind, (n, size, found) in kinds.items():
        low = high = first = last = None
        if len(path) < budgets.depth and kind != "NULL":  # a scalar at the depth limit counts, but bounds and distinct values stop above it
            if kind in NUMERIC:
                finite = [x for x in found if not isinstance(x, float) or math.isfinite(x)]
                if finite:
                    low, high = _number(kind, min(finite)), _number(kind, max(finite))
            elif kind == "STRING":  # code points are in the order of their bytes
                first, last = min(found), max(found)
            sigs.update(signature(kind, x) for x in found)
        out.append((spelled, kind, n, size, low, high, first, last, 0, None))
    sigs.discard(None)
    if sigs:
        digest = hashlib.blake2b
        out.append((spelled, None, 0, 0, None, None, None, None, 0, [int.from_bytes(digest(s, digest_size=8).digest(), "little", signed=True) for s in sigs]))
    return out


def merge_sketches(partials: DataFrame) -> DataFrame:
    """One row per path from partial sketches; merging is associative and commutative."""
    per_kind = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in KINDS]
    merged = partials.groupBy("path").agg(
        F.sum("n").alias("observations"), F.sum("bytes").alias("total_bytes"), F.min("low")["digits"].alias("low"), F.max("high")["digits"].alias("high"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("cuts").alias("cuts"),
        F.coalesce(F.expr("theta_sketch_estimate(theta_sketch_agg(sig, 10))"), F.lit(0)).cast("long").alias("distinct"), *per_kind,
    )
    histogram = F.array_sort(
        F.filter(F.array(*[F.struct((-F.col(k)).alias("minus"), F.lit(k).alias("kind")) for k in KINDS]), lambda x: x["minus"] < 0)
    )
    top = F.try_element_at(histogram, F.lit(1))
    return merged.withColumn("histogram", F.transform(histogram, lambda x: F.struct(x["kind"].alias("kind"), (-x["minus"]).alias("count")))).withColumns({
        "nulls": F.col("NULL"), "dominant": top["kind"], "stability": -top["minus"] / F.col("observations"), "average_bytes": F.col("total_bytes") / F.col("observations"),
    }).drop(*[k for k in KINDS])


def widened(text: str | None, limit: int, upper: bool) -> tuple[str | bytes | None, bool]:
    """A text bound cut to `limit` bytes so that it still holds, and whether it is exact; no upper bound if none is that short."""
    if text is None:
        return None, True
    data = text.encode()
    if len(data) <= limit:
        return text, True
    cut = data[:limit]
    if not upper:
        return cut.decode("utf-8", "ignore"), False
    while cut and cut[-1] == 0xFF:
        cut = cut[:-1]
    return (cut[:-1] + bytes([cut[-1] + 1]) if cut else None), False


def path_statistics(docs: DataFrame, doc: str = "doc", budgets: Budgets = Budgets()) -> DataFrame:
    """Statistics of every collapsed path, the most observed `budgets.paths` of them, ties by path; in no order.

    Columns: path, observations (every node, so more than documents under `[*]`), nulls, histogram (kind, count; by count,
    then name), dominant, stability, total_bytes, average_bytes, distinct (scalars but null), low and high (numbers of any
    width, exact, as their digits), first
    and last (texts, byte order), cuts (containers the walk budgets cut short).
    """
    merged = merge_sketches(partial_sketch(docs, doc, budgets))
    return merged.orderBy(F.col("observations").desc(), "path").limit(budgets.paths)


@dataclass
class PathModel:
    path: CatalogPath
    observations: int
    nulls: int
    kinds: dict[str, int]
    dominant: str
    stability: float
    total_bytes: int
    distinct: int
    low: Decimal | None
    high: Decimal | None
    first: str | None
    last: str | None
    documents: int

    @property
    def presence(self) -> float:
        """Observations per document; above 1 under array elements."""
        return self.observations / self.documents if self.documents else 0.0

    @property
    def null_fraction(self) -> float:
        return self.nulls / self.observations if self.observations else 0.0

    @property
    def stable_scalar(self) -> bool:
        return self.dominant not in ("ARRAY", "OBJECT", "NULL") and self.stability >= 0.9

    def text_bounds(self, limit: int = 64):
        return widened(self.first, limit, False), widened(self.last, limit, True)


@dataclass
class Schema:
    """The inferred model: bounded in size by the path budget, so it lives on the driver."""

    documents: int
    paths: list[PathModel] = field(default_factory=list)
    overflow: int = 0
    segments: tuple[int, int] = (1, 1)

    def get(self, path: str | CatalogPath) -> PathModel | None:
        wanted = CatalogPath.of(path)
        return next((p for p in self.paths if p.path == wanted), None)

    def required(self, fraction: float = 1.0) -> list[CatalogPath]:
        return [p.path for p in self.paths if p.presence >= fraction]

    def render(self) -> str:
        lines = [f"{self.documents} documents, {len(self.paths)} paths" + (f", {self.overflow} more" if self.overflow else "")]
        for p in self.paths:
            kinds = ", ".join(f"{k} {n}" for k, n in p.kinds.items())
            lines.append(f"{p.path}  presence {p.presence:.2f}  {kinds}  distinct {p.distinct}  nulls {p.null_fraction:.2f}")
        return "\n".join(lines)


def infer_schema(docs: DataFrame, doc: str = "doc", budgets: Budgets = Budgets()) -> Schema:
    merged = merge_sketches(partial_sketch(docs, doc, budgets)).persist()
    total = merged.count()
    root = merged.filter("path = '$'").first()
    n = root.observations if root else 0  # every document that isn't null has a root
    rows = merged.orderBy(F.col("observations").desc(), "path").limit(budgets.paths).collect()
    merged.unpersist()
    models = [
        PathModel(CatalogPath.parse(r.path), r.observations, r.nulls, {h.kind: h["count"] for h in r.histogram}, r.dominant, r.stability, r.total_bytes, r["distinct"], None if r.low is None else Decimal(r.low), None if r.high is None else Decimal(r.high), r["first"], r["last"], n)
        for r in rows
    ]
    return Schema(n, sorted(models, key=lambda m: m.path), max(0, total - budgets.paths))


# --- recommendations -------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class CandidateOptions:
    least_observations: int = 16
    least_presence: float = 0.5
    least_stability: float = 0.9
    least_distinct: int = 2
    most_distinct_fraction: float = 1.0
    least_byte_share: float = 0.05
    limit: int = 16


@dataclass(frozen=True)
class Candidate:
    path: CatalogPath
    index: str  # INVERTED or COLUMN
    score: float


def index_candidates(schema: Schema, options: CandidateOptions = CandidateOptions()) -> list[Candidate]:
    """Ranked index recommendations, best first; ties by path, then kind. Byte shares are of the root's bytes."""
    root = schema.get("$")
    whole = root.total_bytes if root else 0
    out = []
    for p in schema.paths:
        if p.observations < options.least_observations or p.presence < options.least_presence or not p.stable_scalar or p.stability < options.least_stability:
            continue
        if p.distinct >= options.least_distinct and p.distinct <= options.most_distinct_fraction * max(schema.documents, 1):
            out.append(Candidate(p.path, "INVERTED", min(p.presence, 1.0) * p.stability * (1 - 1 / p.distinct)))
        share = p.total_bytes / whole if whole else 0.0
        if share >= options.least_byte_share:
            out.append(Candidate(p.path, "COLUMN", p.presence * p.stability * share))
    return sorted(out, key=lambda c: (-c.score, c.path.rank(), c.index))[: options.limit]


@dataclass(frozen=True)
class Shredding:
    path: CatalogPath
    parquet_type: str
    residual: bool
    byte_share: float


_PARQUET = {"BOOLEAN": "BOOLEAN", "INTEGER": "INT64", "DECIMAL": "DECIMAL", "DOUBLE": "DOUBLE", "FLOAT": "FLOAT", "STRING": "STRING", "BINARY": "BINARY", "DATE": "DATE", "TIME": "TIME", "TIMESTAMP": "TIMESTAMP", "UUID": "UUID"}


def shredding_advice(schema: Schema) -> list[Shredding]:
    """Fields worth a typed column, by share of bytes; shares are of the bytes of all fields, ancestors included."""
    whole = sum(p.total_bytes for p in schema.paths)
    out = [
        Shredding(p.path, _PARQUET[p.dominant], p.stability < 1.0, p.total_bytes / whole if whole else 0.0)
        for p in schema.paths if p.dominant in _PARQUET and p.path.steps and not p.path.multiple
    ]
    return sorted(out, key=lambda s: (-s.byte_share, s.path.rank()))


def selectivity(schema: Schema, kind: str, path: str | CatalogPath, values: int = 1, negated: bool = False) -> float:
    """Estimated share of documents: EQ presence * k / distinct, RANGE presence / 3, EXISTS presence, IS_NULL presence * nulls."""
    p = schema.get(path)
    share = 0.0
    if p:
        presence = min(p.presence, 1.0)
        share = {"EQ": presence * values / max(p.distinct, 1), "RANGE": presence / 3, "EXISTS": presence, "IS_NULL": presence * p.null_fraction}[kind]
    share = min(max(share, 0.0), 1.0)
    return 1 - share if negated else share
