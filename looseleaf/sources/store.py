"""A versioned document store on Parquet: segments listed by numbered manifests, each commit one new manifest.

A segment is a Parquet directory of (key, seq, doc); a null doc is a tombstone. A manifest lists the live segments with their
key and sequence ranges. It is written under a name of its own and then linked (local disks) or renamed without overwriting
(others; the file system must rename atomically, as HDFS does and plain object stores don't), so of two writers of one
version one fails and data that no manifest lists is never read (a writer that dies leaves nothing visible). Readers hold a
manifest and a sequence: a snapshot.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V
from ..operators.query import in_range, with_prefix


class StoreError(RuntimeError):
    """Base of the store's errors."""


class Locked(StoreError):
    """Another writer holds the store, or committed the same version first."""


class Closed(StoreError):
    """The store was closed."""


class Corrupt(StoreError):
    """A manifest can't be read."""


class Unsupported(StoreError):
    """A manifest of a format that this version doesn't know."""


FORMAT = 1
SCHEMA = "key binary, seq long, doc variant"


@dataclass(frozen=True)
class Segment:
    name: str
    rows: int
    first: str  # base64 of the least and greatest key
    last: str
    low_seq: int
    high_seq: int
    tombstones: int
    level: int = 0
    versions: bool = False  # a key may stand more than once in it

    def may_hold(self, first: bytes | None, last: bytes | None) -> bool:
        a, b = base64.b64decode(self.first), base64.b64decode(self.last)
        return not (first is not None and b < first or last is not None and a > last)


@dataclass(frozen=True)
class Manifest:
    version: int
    sequence: int
    segments: tuple[Segment, ...] = ()
    format: int = FORMAT


@dataclass(frozen=True)
class Snapshot:
    """An immovable view: the manifest's segments, rows up to a sequence."""

    manifest: Manifest
    sequence: int


@dataclass
class WriteBatch:
    """Puts and deletes that become visible together; of several for one key the last one counts."""

    ops: list[tuple[bytes, str | None]] = field(default_factory=list)

    def put(self, key, json_text: str) -> "WriteBatch":
        self.ops.append((as_key(key), json_text))
        return self

    def delete(self, key) -> "WriteBatch":
        self.ops.append((as_key(key), None))
        return self


@dataclass(frozen=True)
class Options:
    """What a store does besides storing."""

    level0_segments: int = 4  # compaction starts beyond this many
    target_rows: int = 5_000_000  # rows per file of a compacted segment
    pending_writes: int = 10_000  # puts and deletes held in memory before they are flushed
    observers: tuple[Callable[["DocumentStore", Segment], None], ...] = ()


def as_key(key) -> bytes:
    """A key's bytes; text as UTF-8, where a lone surrogate is refused."""
    if isinstance(key, str):
        return key.encode("utf-8")
    return bytes(key)


class DocumentStore:
    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.path, self.options = V.configure(spark), path.rstrip("/"), options
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._pending: dict[bytes, str | None] = {}
        self._open = True
        self.problems: list[str] = []
        self._fs.mkdirs(self._path("manifests"))
        if not self._versions():
            self._write_manifest(Manifest(0, 0))

    # --- files ---

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def names(self, *parts: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        folder = self._path(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _versions(self, folder: str = "manifests") -> list[int]:
        return sorted(int(n[:-5]) for n in self.names(folder) if n.endswith(".json") and n[:-5].isdigit())

    def _next(self) -> int:
        """The version after the highest number seen, whether its manifest can be read or not."""
        return max(self._versions()) + 1

    def _read_text(self, *parts: str) -> str:
        stream = self._fs.open(self._path(*parts))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit_file(self, folder: str, number: int, text: str) -> None:
        """A numbered file, whole or not at all; a number that exists already is another writer's."""
        jvm = self.spark._jvm
        self._fs.mkdirs(self._path(folder))
        temporary, final = self._path(folder, f"{uuid.uuid4().hex}.tmp"), self._path(folder, f"{number:012d}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                at = [jvm.java.io.File(self._fs.makeQualified(p).toUri().getPath()).toPath() for p in (final, temporary)]
                jvm.java.nio.file.Files.createLink(*at)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                options = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                context.rename(temporary, final, options)
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getName():
                raise Locked(f"{folder} {number} was committed by another writer") from None
            raise
        finally:
            if self._fs.exists(temporary):
                self._fs.delete(temporary, False)

    def _write_manifest(self, m: Manifest) -> None:
        self.commit_file("manifests", m.version, json.dumps(asdict(m)))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest readable manifest, or the one of a version. Torn newest files are passed over and reported."""
        if not self._open:
            raise Closed(self.path)
        for v in [version] if version is not None else reversed(self._versions()):
            try:
                raw = json.loads(self._read_text("manifests", f"{v:012d}.json"))
            except ValueError as e:
                if version is not None:
                    raise Corrupt(f"manifest {v}: {e}") from None
                self.problems.append(f"manifest {v} is torn")
                continue
            if raw["format"] > FORMAT:
                raise Unsupported(f"format {raw['format']}")
            return Manifest(raw["version"], raw["sequence"], tuple(Segment(**s) for s in raw["segments"]), raw["format"])
        raise Corrupt("no readable manifest")

    # --- writing ---

    def put(self, key, json_text: str) -> None:
        """One document, held until flush() or until many are held; visible to this object's reads from then on."""
        self._hold(key, json_text)

    def delete(self, key) -> None:
        """A tombstone; deleting an absent key is legal."""
        self._hold(key, None)

    def _hold(self, key, json_text: str | None) -> None:
        self._pending[as_key(key)] = json_text
        if len(self._pending) >= self.options.pending_writes:
            self.flush()

    def write(self, batch: WriteBatch) -> None:
        """All of a batch in one commit; an empty batch does nothing."""
        if batch.ops:
            self.flush()
            self._pending |= dict(batch.ops)
            self.flush()

    def _pending_rows(self) -> DataFrame:
        """Pending writes (key, text); at most Options.pending_writes of them."""
        return self.spark.createDataFrame([(bytearray(k), t) for k, t in sorted(self._pending.items())], "key binary, text string")

    def flush(self) -> None:
        """Pending writes as one sorted segment."""
        if not self._pending:
            return
        made = self._pending_rows().withColumn("ok", F.col("text").isNull() | V.strict_json(F.col("text")).isNotNull())
        if bad := made.filter("not ok").select("key").first():
            raise ValueError(f"not a JSON document under key {bytes(bad.key)!r}")
        self.append(made.select("key", V.fast_json(F.col("text")).alias("doc")), unique=True)
        self._pending.clear()

    def append(self, docs: DataFrame, unique: bool = False) -> Segment | None:
        """Rows (key, doc) as one commit, null docs being deletes. ValueError for null or repeated keys; nothing is committed then.

        Text keys become UTF-8 bytes. The rows are written as they are partitioned, sorted within each file. That keys are
        unique is checked on the written keys alone (documents aren't shuffled); `unique` says that the caller knows it.
        """
        m = self.manifest()
        seq = m.sequence + 1
        rows = docs.select(F.col("key").cast("binary").alias("key"), F.lit(seq).cast("long").alias("seq"), F.col("doc"))
        made = self._write_segment(rows.sortWithinPartitions("key"), 0)
        if made is None:
            return None
        if not unique:
            again = self.read_segments([made.name]).groupBy("key").count().filter("key is null or count > 1").select("key").first()
            if again is not None:
                self._fs.delete(self._path("data", made.name), True)
                raise ValueError(f"key {None if again.key is None else bytes(again.key)!r} is null or stands twice")
        self._write_manifest(replace(m, version=self._next(), sequence=seq, segments=(*m.segments, made)))
        self._observe(made)
        return made

    def _write_segment(self, rows: DataFrame, level: int, versions: bool = False) -> Segment | None:
        name = f"segment-{uuid.uuid4().hex}"
        seen = Observation()
        rows = rows.observe(
            seen, F.count("*").alias("n"), F.min(F.hex("key")).alias("a"), F.max(F.hex("key")).alias("b"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_if(F.col("doc").isNull()).alias("dead")
        )
        rows.write.parquet(f"{self.path}/data/{name}")
        r = Row(**seen.get)
        if not r.n:
            self._fs.delete(self._path("data", name), True)
            return None
        ends = [base64.b64encode(bytes.fromhex(x)).decode() for x in (r.a, r.b)]
        return Segment(name, r.n, *ends, r.lo, r.hi, r.dead, level, versions)

    def _observe(self, segment: Segment) -> None:
        for o in self.options.observers:
            try:
                o(self, segment)
            except Exception as e:  # an observer's failure is its own
                self.problems.append(f"observer {getattr(o, '__name__', o)}: {e}")

    def delete_where(self, live: DataFrame) -> int:
        keys = live.select("key").withColumn("doc", F.expr("cast(null as variant)"))
        made = self.append(keys, unique=True)
        return made.rows if made else 0

    def delete_range(self, first=None, last=None) -> int:
        """Tombstones for the live keys from `first` to `last`, both included; how many. Crossed bounds: none."""
        self.flush()
        return self.delete_where(self.scan(first, last, ordered=False))

    def delete_prefix(self, prefix) -> int:
        self.flush()
        return self.delete_where(self.scan_prefix(prefix, ordered=False))

    # --- reading ---

    def read_segments(self, names: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/data/{n}" for n in names]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def snapshot(self) -> Snapshot:
        m = self.manifest()
        return Snapshot(m, m.sequence)

    def versions(self, snapshot: Snapshot | None = None, first: bytes | None = None, last: bytes | None = None) -> tuple[DataFrame, bool]:
        """All versions up to a snapshot in the segments that may hold the range, and whether a key may stand twice."""
        snap = snapshot or self.snapshot()
        parts = [s for s in snap.manifest.segments if s.may_hold(first, last) and s.low_seq <= snap.sequence]
        rows = self.read_segments([s.name for s in parts])
        if any(s.high_seq > snap.sequence for s in parts):
            rows = rows.filter(F.col("seq") <= snap.sequence)
        spans = sorted((base64.b64decode(s.first), base64.b64decode(s.last)) for s in parts)
        apart = all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        return rows, not apart or any(s.versions for s in parts)

    def scan(self, first=None, last=None, snapshot: Snapshot | None = None, ordered: bool = True) -> DataFrame:
        """(key, doc) of every live key in a range, both ends included; in key order unless `ordered` is False.

        Segments outside the range aren't opened; where the others don't overlap, no version is looked for elsewhere and
        nothing is shuffled, else the newest version per key wins by a max aggregate combined before its shuffle. Without a
        snapshot, writes that this object still holds are merged in.
        """
        a, b = None if first is None else as_key(first), None if last is None else as_key(last)
        rows, twice = self.versions(snapshot, a, b)
        rows = in_range(rows, None if a is None else bytearray(a), None if b is None else bytearray(b))
        live = newest(rows) if twice else rows
        live = live.filter(F.col("doc").isNotNull()).select("key", "doc")
        if snapshot is None and self._pending:
            held = in_range(self._pending_rows(), None if a is None else bytearray(a), None if b is None else bytearray(b))
            live = live.join(F.broadcast(held.select("key")), "key", "left_anti").unionByName(held.filter("text is not null").select("key", V.fast_json(F.col("text")).alias("doc")))
        return live.orderBy("key") if ordered else live

    def scan_prefix(self, prefix, snapshot: Snapshot | None = None, ordered: bool = True) -> DataFrame:
        found = with_prefix(self.scan(snapshot=snapshot, ordered=False), bytearray(as_key(prefix)))
        return found.orderBy("key") if ordered else found

    def scan_segments(self, names: Iterable[str], snapshot: Snapshot | None = None) -> DataFrame:
        """Candidates of some segments only: live versions there, which newer ones elsewhere may shadow."""
        snap = snapshot or self.snapshot()
        return newest(self.read_segments(names).filter(F.col("seq") <= snap.sequence)).filter(F.col("doc").isNotNull()).select("key", "doc")

    def get(self, key, snapshot: Snapshot | None = None) -> str | None:
        """JSON text of the newest visible version, or None."""
        k = as_key(key)
        if snapshot is None and k in self._pending:
            return self._pending[k]
        rows = self.scan(k, k, snapshot, ordered=False).select(F.to_json("doc")).take(1)
        return rows[0][0] if rows else None

    # --- upkeep ---

    def compact(self, oldest: Snapshot | None = None) -> Manifest:
        """All segments as one, range-partitioned by key: shadowed versions go, and tombstones, but for what `oldest` still sees."""
        self.flush()
        m = self.manifest()
        if not m.segments:
            return m
        rows = self.read_segments([s.name for s in m.segments])
        pinned = oldest is not None and oldest.sequence < m.sequence
        keep = _still_seen(rows, oldest.sequence) if pinned else newest(rows).filter(F.col("doc").isNotNull())
        parts = max(1, -(-sum(s.rows for s in m.segments) // self.options.target_rows))
        return self._replace(m, m.segments, keep, parts, pinned)

    def _replace(self, m: Manifest, old: tuple[Segment, ...], keep: DataFrame, parts: int, pinned: bool) -> Manifest:
        made = self._write_segment(keep.select("key", "seq", "doc").repartitionByRange(parts, "key").sortWithinPartitions("key", F.col("seq").desc()), 1, pinned)
        new = replace(m, version=self._next(), segments=(*(s for s in m.segments if s not in old), *([made] if made else [])))
        self._write_manifest(new)
        if made:
            self._observe(made)
        return new

    def maintain(self) -> Manifest:
        """Where enough level-0 segments have come up, merges them with the level-1 segments whose keys they overlap.

        Level-1 segments elsewhere stay as they are, so what is rewritten grows with what was written, not with the store.
        All versions of a key in the merged range take part, hence tombstones may go.
        """
        m = self.manifest()
        fresh = [s for s in m.segments if s.level == 0]
        if len(fresh) <= self.options.level0_segments:
            return m
        taken = list(fresh)
        for s in m.segments:  # ranges of level 1 don't overlap one another
            if s.level and any(s.may_hold(base64.b64decode(f.first), base64.b64decode(f.last)) for f in fresh):
                taken.append(s)
        rows = newest(self.read_segments([s.name for s in taken])).filter(F.col("doc").isNotNull())
        return self._replace(m, tuple(taken), rows, max(1, -(-sum(s.rows for s in taken) // self.options.target_rows)), False)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes data that none of the newest manifests lists; how many directories. Older snapshots stop working."""
        versions = self._versions()[-keep_versions:]
        listed = {s.name for v in versions for s in self.manifest(v).segments}
        gone = [s.getPath() for s in self._fs.listStatus(self._path("data")) if s.getPath().getName() not in listed] if self._fs.exists(self._path("data")) else []
        for p in gone:
            self._fs.delete(p, True)
        for v in self._versions()[:-keep_versions]:
            self._fs.delete(self._path("manifests", f"{v:012d}.json"), False)
        return len(gone)

    def checkpoint(self, target: str) -> "DocumentStore":
        """A consistent copy with side tables and registry, in an empty place."""
        self.flush()
        jvm = self.spark._jvm
        to = jvm.org.apache.hadoop.fs.Path(target)
        fs = to.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(to) and len(fs.listStatus(to)):
            raise StoreError("the target isn't empty")
        conf = self.spark._jsc.hadoopConfiguration()
        copy = jvm.org.apache.hadoop.fs.FileUtil.copy
        for s in self.manifest().segments:
            copy(self._fs, self._path("data", s.name), fs, jvm.org.apache.hadoop.fs.Path(f"{target}/data/{s.name}"), False, conf)
        for extra in ("indexes", "registry", "manifests"):
            if self._fs.exists(self._path(extra)):
                copy(self._fs, self._path(extra), fs, jvm.org.apache.hadoop.fs.Path(f"{target}/{extra}"), False, conf)
        return DocumentStore(self.spark, target, self.options)

    def stats(self) -> dict:
        m = self.manifest()
        size = sum(self._fs.getContentSummary(self._path("data", s.name)).getLength() for s in m.segments)
        return {
            "version": m.version, "sequence": m.sequence, "segments": len(m.segments), "rows": sum(s.rows for s in m.segments),
            "tombstones": sum(s.tombstones for s in m.segments), "bytes": size, "pending": len(self._pending),
            "levels": {n: sum(s.level == n for s in m.segments) for n in sorted({s.level for s in m.segments})},
        }

    def close(self) -> None:
        self.flush()
        self._open = False

    def __enter__(self) -> "DocumentStore":
        return self

    def __exit__(self, *_) -> None:
        if self._open:
            self.close()


def newest(rows: DataFrame) -> DataFrame:
    """The row of the greatest sequence for each key, tombstones included (a merge of any number of sorted sources)."""
    return rows.groupBy("key").agg(F.max_by(F.struct("seq", "doc"), "seq").alias("v")).select("key", "v.seq", "v.doc")


def _still_seen(rows: DataFrame, oldest: int) -> DataFrame:
    """Versions that a snapshot at `oldest` or later can see: those after it, and the newest of those up to it."""
    old = newest(rows.filter(F.col("seq") <= oldest))
    return rows.filter(F.col("seq") > oldest).unionByName(old)
