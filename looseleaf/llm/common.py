"""Helpers shared by the corpus operators: batch-wise maps over whole texts and shared-folder storage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII letters are the only ones that change case anywhere in this package.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bytes of `[\x20\x09-\x0D]`; bytes.split() cuts at exactly these.
BLANKS = b" \t\n\x0b\x0c\r"

#: Texts are handed to Python in slices of about this many bytes, so a batch of long texts stays bounded.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's `spark.checkpoint.dir`.

    Where it is unset a temporary one is made on a local master (tests); on a cluster that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = jsc.getCheckpointDir()
        if not known.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="looseleaf-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/looseleaf/{spark.sparkContext.applicationId}"


def clear_stored(spark: SparkSession) -> None:
    """Deletes what stored() wrote for this application; DataFrames that read it stop working."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    Results are lazy, so nothing is deleted here; clear_stored() does once they have been used.
    """
    path = f"{_own(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column, each of about SLICE_BYTES (a longer text stands alone)."""
    lengths = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    start = size = 0
    for row, n in enumerate(pa.compute.binary_length(lengths).to_pylist()):
        size += n or 0
        if size >= SLICE_BYTES:
            yield start, row + 1
            start, size = row + 1, 0
    if start < len(column):
        yield start, len(column)


def map_texts(
    df: DataFrame,
    keep: list[str],
    text_col: str,
    new: T.StructType,
    start: Callable[[], Callable[[list[bytes | None]], dict[str, list]]],
) -> DataFrame:
    """Columns `keep` of every row plus those of `new`, computed from whole texts in Arrow batches.

    `start()` runs once per task and returns the function from a list of UTF-8 texts (None for null) to
    the new columns, each a list or an Arrow array. No row is dropped or reordered, and nothing but the needed columns is read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f"c{i}" for i in range(len(keep))]
    kept = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text_col}`").cast("string").alias("text"))
    made_names = [f"n{i}" for i in range(len(new))]
    schema = T.StructType([*kept.schema.fields[:-1], *(T.StructField(n, f.dataType, True) for n, f in zip(made_names, new))])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            for a, b in slices(texts):
                made = work(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in range(len(keep))), *(made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow)],
                    names=[*names, *made_names],
                )

    return kept.mapInArrow(run, schema).toDF(*keep, *new.names)


SPAN = T.StructType([field("kind", T.StringType()), field("start", T.LongType()), field("end", T.LongType())])


def span_text(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined in the order given; the empty string for none."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by place in `kinds` (others after, by name), then end."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))]) if kinds else None
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            (F.coalesce(F.try_element_at(rank, s["kind"]), F.lit(len(kinds))) if kinds else F.lit(0)).alias("rank"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
        ),
    )
    return F.array_sort(keyed)


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def filter_texts(df: DataFrame, text_col: str, start: Callable[[], Callable[[list[bytes | None]], list[bool]]]) -> DataFrame:
    """The rows of `df` for which the function made by `start()` says True of the whole text, all columns as they are."""
    names = df.columns
    at = names.index(text_col)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            for a, b in slices(texts):
                yield batch.slice(a, b - a).filter(pa.array(keep(texts.slice(a, b - a).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
