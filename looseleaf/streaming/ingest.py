"""Structured Streaming into and out of a store: incremental JSON lines, and draining by key order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..operators.query import successor
from ..sources.store import DocumentStore


def numbered(lines: DataFrame) -> DataFrame:
    """Column `ordinal` (from 0, blank lines counted) for rows (value, file, block) of text files as they were read.

    A split is read by one task in order, so a line's place in it comes from the row's number in the task; a split's own
    first place is the count of lines in the splits before it, a table with one row per split.
    """
    at = lines.withColumn("__at", F.monotonically_increasing_id())
    splits = at.groupBy("file", "block").agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = splits.select("file", "block", "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return at.join(firsts, ["file", "block"]).withColumn("ordinal", F.col("__at") - F.col("__low") + F.col("__before")).drop("__at", "__low", "__before")


def ingest_lines(spark: SparkSession, source: str, store: DocumentStore, checkpoint: str, key: Callable[[DataFrame], DataFrame] | None = None):
    """JSON-lines files of a folder into a store, each file once, one commit per micro-batch; ends when all is read.

    Blank lines are counted and passed over; lines that aren't JSON (a torn last line too) are counted and left out. `key`
    adds the column `key` to (value, file, ordinal, doc), unique among them; without it keys are the file's path and the line's
    ordinal in it, so repeated lines stay apart and a replayed batch rewrites the same keys and changes nothing. Returns the
    counts per batch.
    """
    counts: list[dict] = []
    lines = spark.readStream.format("text").load(source).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def commit(batch: DataFrame, number: int) -> None:
        made = numbered(batch).withColumn("doc", V.fast_json(F.when(F.trim("value") != "", F.col("value"))))
        keyed = key(made) if key else made.withColumn("key", F.concat_ws(":", "file", F.lpad(F.col("ordinal").cast("string"), 12, "0")))
        keyed = keyed.persist()
        n = keyed.agg(F.count("*").alias("lines"), F.count_if(F.trim("value") == "").alias("blank"), F.count_if(F.col("doc").isNotNull()).alias("documents")).first()
        store.append(keyed.filter(F.col("doc").isNotNull()).select("key", "doc"), unique=key is None)
        keyed.unpersist()
        counts.append({"batch": number, **n.asDict(), "rejected": n["lines"] - n["blank"] - n["documents"]})

    lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counts


def drain(store: DocumentStore, ship: Callable[[DataFrame], None], watermark: bytes | None = None, rows: int = 100_000) -> bytes | None:
    """Ships live documents in key order, from a watermark on, in slices of `rows`; what was shipped is deleted, then compacted.

    Each slice is taken from a snapshot, shipped, and only then recorded and deleted, so a failure repeats a slice and
    loses none. Returns the watermark for the next call.
    """
    while True:
        snap = store.snapshot()
        part = store.scan(watermark, None, snap).limit(rows)
        last = part.agg(F.max("key").alias("k"), F.count("*").alias("n")).first()
        if not last.n:
            break
        ship(part)
        store.delete_range(watermark, bytes(last.k))
        watermark = successor(bytes(last.k))
    store.compact()
    return watermark
