"""Diagnostics over document tables: what correlation, shape, exploding and text bounds would cost."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variant_bytes
from ..functions.paths import CatalogPath
from .predicates import Predicate, compile_predicate, nodes, path
from .schema import path_of


@dataclass(frozen=True)
class CorrelationCost:
    documents: int
    elements: int
    correlated: int
    uncorrelated: int

    @property
    def false_positives(self) -> int:
        return self.uncorrelated - self.correlated

    @property
    def rate(self) -> float:
        """Share of uncorrelated matches that aren't correlated ones."""
        return self.false_positives / self.uncorrelated if self.uncorrelated else 0.0

    @property
    def amplification(self) -> float:
        return self.uncorrelated / self.correlated if self.correlated else float("inf") if self.uncorrelated else 1.0


def correlation_cost(docs: DataFrame, elements: str, operand: Predicate, uncorrelated: Predicate, doc: str = "doc") -> CorrelationCost:
    """One pass: how many documents an elemMatch takes, and how many its parts taken apart do."""
    d = F.col(doc)
    row = docs.select(
        F.size(nodes(d, CatalogPath.parse(elements))).alias("n"), compile_predicate(path(elements).elem_match(operand), d).alias("c"), compile_predicate(uncorrelated, d).alias("u")
    ).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if("c"), F.count_if("u")).first()
    return CorrelationCost(*row)


def predicted_rate(elements: int, p: float, q: float) -> float:
    """Expected false share when each of n elements meets one test with chance p and the other with q, independently."""
    both = (1 - (1 - p) ** elements - (1 - q) ** elements) + (1 - p - q + p * q) ** elements
    together = 1 - (1 - p * q) ** elements
    return (both - together) / both if both > 0 else 0.0


def corpus_shape(docs: DataFrame, doc: str = "doc", discriminator: str = "@type") -> DataFrame:
    """Per collapsed path: objects, arrays, the deepest container below it, and which discriminator values its objects carry.

    Columns: path, objects, arrays, depth (of the path), types (array of (value, count), by value). Tasks pre-aggregate.
    """

    def run(batches):
        for batch in batches:
            seen: dict[tuple, list[int]] = {}
            for v in batch.column(0).to_pylist():
                if v is None:
                    continue
                kinds: dict[tuple, str] = {}
                for p, kind, x, _, _ in variant_bytes.walk(v["value"], v["metadata"]):
                    if kind in ("OBJECT", "ARRAY"):
                        c = seen.setdefault((p, None), [0, 0])
                        c[kind == "ARRAY"] += 1
                        kinds[p] = kind
                    elif p and p[-1] == discriminator and kind == "STRING":
                        seen.setdefault((p[:-1], x), [0, 0])[0] += 1
            rows = [(str(path_of(p)), len(p), t, a, b) for (p, t), (a, b) in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["path", "depth", "type", "objects", "arrays"])

    parts = docs.select(F.col(doc).alias("doc")).mapInArrow(run, "path string, depth int, type string, objects long, arrays long")
    merged = parts.groupBy("path", "depth", "type").agg(F.sum("objects").alias("objects"), F.sum("arrays").alias("arrays"))
    plain = F.col("type").isNull()
    return merged.groupBy("path", "depth").agg(
        F.sum(F.when(plain, F.col("objects")).otherwise(0)).alias("objects"), F.sum(F.when(plain, F.col("arrays")).otherwise(0)).alias("arrays"),
        F.array_sort(F.collect_list(F.when(~plain, F.struct(F.col("type").alias("value"), F.col("objects").alias("count"))))).alias("types"),
    )


def explode_cost(docs: DataFrame, elements: str, doc: str = "doc") -> dict:
    """Bytes if every element at a path were a document of its own: whole (kept in place too) and elided (taken out)."""
    size = F.udf(lambda v: None if v is None else len(v.value), "long")
    row = docs.select(size(F.col(doc)).alias("own"), F.transform(nodes(F.col(doc), CatalogPath.parse(elements)), lambda e: F.octet_length(F.to_json(e))).alias("parts")).agg(
        F.count("*").alias("n"), F.sum("own").alias("own"), F.sum(F.size("parts")).alias("elements"), F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("moved")
    ).first()
    own, moved = row.own or 0, row.moved or 0
    return {"documents": row.n, "elements": row.elements or 0, "bytes": own, "whole": own + moved, "elided": max(own, moved), "factor_whole": (own + moved) / own if own else 1.0}


def text_bound_cost(texts: DataFrame, column: str, block_rows: int = 8192, widths: tuple[int, ...] = (8, 16, 32, 64)) -> DataFrame:
    """Per bound width: blocks, blocks whose bounds still tell them from all texts, and bytes the bounds take.

    Blocks are runs of `block_rows` rows of one sorted partition, as a sorted side table would hold them.
    """
    part = F.spark_partition_id()
    rows = texts.select(F.col(column).alias("t")).filter("t is not null").sortWithinPartitions("t")
    numbered = rows.withColumn("b", part).withColumn("i", F.monotonically_increasing_id() % (1 << 33)).withColumn("k", F.floor(F.col("i") / block_rows))
    bounds = numbered.groupBy("b", "k").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    out = None
    for w in widths:
        cut = bounds.select(F.substring(F.encode("lo", "utf-8"), 1, w).alias("lo"), F.substring(F.encode("hi", "utf-8"), 1, w).alias("hi"))
        row = cut.agg(F.lit(w).alias("width"), F.count("*").alias("blocks"), F.count_if(F.col("lo") != F.col("hi")).alias("telling"), F.sum(F.octet_length("lo") + F.octet_length("hi")).alias("bytes"))
        out = row if out is None else out.unionByName(row)
    return out


def amplification(store, json_bytes: int) -> dict[str, float]:
    """Bytes on disk by kind of file, over the bytes of the JSON that went in."""
    fs = store._fs
    out = {}
    for kind in ("data", "indexes", "manifests"):
        p = store._path(kind)
        out[kind] = fs.getContentSummary(p).getLength() / json_bytes if json_bytes and fs.exists(p) else 0.0
    return out
