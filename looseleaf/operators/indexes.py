"""Retroactive indexes as side tables: they may change how fast a query runs, never what it returns.

Per indexed segment a side table is written: inverted (term -> key), column (key with a typed value) or composite (tuple of
an element's fields -> key). Index rows carry key and sequence; candidates from them are rechecked against the newest
visible document, and segments without a side table are scanned, so answers are those of a plain scan.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.paths import CatalogPath
from ..sources.store import Corrupt, DocumentStore, Segment, Snapshot, StoreError
from .predicates import And, Compare, In, Predicate, nodes
from .schema import signature

MAX_TERM_BYTES = 512
#: Segments of fewer rows are indexed in the one task that reads them.
SMALL = 10_000


def term_of(value) -> tuple[int, str]:
    """Tag and text of a literal, as signature() gives them for values."""
    if isinstance(value, bool):
        return 0, "true" if value else "false"
    if isinstance(value, str):
        return 2, value
    s = signature("DECIMAL", V.number(value))
    return 1, s[1:].decode()


@dataclass(frozen=True)
class Definition:
    kind: str  # inverted, column, composite
    path: str
    fields: tuple[str, ...] = ()

    def __post_init__(self):
        CatalogPath.parse(self.path)
        if self.kind not in ("inverted", "column", "composite"):
            raise ValueError(f"no index kind {self.kind}")
        if (self.kind == "composite") != bool(self.fields) or len(self.fields) > 16 or any(CatalogPath.parse(f).multiple for f in self.fields):
            raise ValueError("a composite index, and no other, names 1 to 16 single-valued fields")


def inverted(path: str) -> Definition:
    return Definition("inverted", path)


def column(path: str) -> Definition:
    return Definition("column", path)


def composite(path: str, *fields: str) -> Definition:
    return Definition("composite", path, tuple(fields))


def side_table(rows: DataFrame, d: Definition) -> DataFrame:
    """Index rows of (key, seq, doc) rows; terms longer than MAX_TERM_BYTES, and JSON null, are presence only (tag -1)."""
    path = CatalogPath.parse(d.path)
    if d.kind == "composite":
        def tuple_of(e: Column) -> Column:
            return V.let(F.array(*[V.signature(F.try_variant_get(e, _spark(f), "variant")) for f in d.fields]), whole)

        def whole(parts: Column) -> Column:
            spelled = F.transform(parts, lambda p: F.concat_ws("\x1e", p["tag"].cast("string"), p["text"]))
            return F.when(~F.exists(parts, lambda p: p.isNull()), F.struct(F.lit(9).alias("tag"), F.concat_ws("\x1f", spelled).alias("text")))

        found = F.filter(F.transform(nodes(F.col("doc"), path), tuple_of), lambda t: t.isNotNull())
        return rows.select("key", "seq", F.explode(F.array_distinct(found)).alias("t")).select("key", "seq", F.col("t.tag").alias("tag"), F.col("t.text").alias("term"))
    if d.kind == "inverted":
        def term(v: Column) -> Column:
            none = F.struct(F.lit(-1).alias("tag"), F.lit("").alias("text"))
            return V.let(V.signature(v), lambda s: F.when(F.octet_length(s["text"]) <= MAX_TERM_BYTES, s).otherwise(none))

        scalars = F.filter(nodes(F.col("doc"), path), V.is_scalar)
        return rows.select("key", "seq", F.explode(F.array_distinct(F.transform(scalars, term))).alias("t")).select("key", "seq", F.col("t.tag").alias("tag"), F.col("t.text").alias("term"))
    typed = rows.select("key", "seq", F.explode(F.filter(nodes(F.col("doc"), path), V.is_scalar)).alias("v"))
    scale = F.regexp_extract(V.type_text(F.col("v")), r",(\d+)\)", 1)
    exact = V.decimal_value(F.col("v")).isNotNull() & ((scale == "") | (scale.cast("int") <= 18))  # `num` is the value itself
    return typed.select("key", "seq", exact.alias("exact"), V.decimal_value(F.col("v")).alias("num"), V.double_value(F.col("v")).alias("dbl"), V.string_value(F.col("v")).alias("txt"), V.boolean_value(F.col("v")).alias("bool"), V.is_json_null(F.col("v")).alias("is_null"), F.col("v"))


def _spark(f: str) -> str:
    from ..functions.paths import _spark_name

    return "$" + "".join(_spark_name(s.name) for s in CatalogPath.parse(f).steps)


@dataclass
class Build:
    """A build in the background: its state, how far it is, and how to stop or await it."""

    state: str = "RUNNING"
    done: int = 0
    total: int = 0
    error: str | None = None
    _stop: bool = False
    _thread: threading.Thread | None = field(default=None, repr=False)

    def cancel(self) -> None:
        self._stop = True

    def wait(self, seconds: float | None = None) -> str:
        if self._thread:
            self._thread.join(seconds)
        return self.state


class IndexRegistry:
    """The indexes of a store: a registry file and, per index and segment, one side table."""

    def __init__(self, store: DocumentStore):
        self.store = store
        self._read: tuple[int, str] = (-1, "")
        self.problems: list[str] = []

    def _load(self) -> dict:
        """The newest registry; Corrupt if it can't be read (a store without one has no indexes yet)."""
        known = self.store._versions("registry")
        if not known:
            return {"next": 1, "indexes": {}}
        try:
            if self._read[0] != known[-1]:  # a numbered file never changes
                self._read = known[-1], self.store._read_text("registry", f"{known[-1]:012d}.json")
            return json.loads(self._read[1])
        except ValueError as e:
            raise Corrupt(f"registry {known[-1]}: {e}") from None

    def _save(self, state: dict) -> None:
        """The next registry; Locked if another writer was first."""
        self.store.commit_file("registry", max(self.store._versions("registry"), default=0) + 1, json.dumps(state))

    def indexes(self) -> dict[int, Definition]:
        return {int(k): Definition(v["kind"], v["path"], tuple(v["fields"])) for k, v in self._load()["indexes"].items()}

    def create(self, d: Definition, build: bool = True) -> int:
        """The id of the index, built for all live segments; one that is defined already is found again. Ids are never reused."""
        state = self._load()
        for k, v in state["indexes"].items():
            if (v["kind"], v["path"], tuple(v["fields"])) == (d.kind, d.path, d.fields):
                found = int(k)
                break
        else:
            found = state["next"]
            state["next"] += 1
            state["indexes"][str(found)] = {"kind": d.kind, "path": d.path, "fields": list(d.fields)}
            self._save(state)
        if build:
            self.backfill(found)
        return found

    def drop(self, index: int) -> None:
        state = self._load()
        state["indexes"].pop(str(index), None)
        self._save(state)
        self.store._fs.delete(self.store._path("indexes", str(index)), True)

    def coverage(self, index: int, snapshot: Snapshot | None = None) -> tuple[list[Segment], list[Segment]]:
        """Live segments with a side table, and those without; side tables get their names only when they are whole."""
        parts = (snapshot or self.store.snapshot()).manifest.segments
        names = set(self.store.names("indexes", str(index)))
        return [s for s in parts if s.name in names], [s for s in parts if s.name not in names]

    def build_segment(self, index: int, s: Segment) -> None:
        """One segment's side table, range-partitioned by term or value, so a lookup's rows lie in few files and row groups.

        It is written beside and renamed, so a table that is there is whole.
        """
        d = self.indexes()[index]
        rows = side_table(self.store.read_segments([s.name]).filter(F.col("doc").isNotNull()), d)
        by = ["tag", "term", "key"] if d.kind != "column" else ["num", "txt", "key"]
        parts = max(1, -(-s.rows // self.store.options.target_rows))
        ranged = rows.repartitionByRange(parts, *by) if parts > 1 else rows.coalesce(1) if s.rows < SMALL else rows.repartition(1)
        beside = f"{index}/.{s.name}-{uuid.uuid4().hex}"
        ranged.sortWithinPartitions(*by).write.parquet(f"{self.store.path}/indexes/{beside}")
        fs, final = self.store._fs, self.store._path("indexes", str(index), s.name)
        if fs.exists(final):
            fs.delete(final, True)
        if not fs.rename(self.store._path("indexes", *beside.split("/")), final):
            raise StoreError(f"the side table {index}/{s.name} can't be put in place")

    def backfill(self, index: int) -> None:
        """Side tables for segments that have none yet."""
        for s in self.coverage(index)[1]:
            self.build_segment(index, s)

    def rebuild(self, index: int) -> None:
        for s in self.store.snapshot().manifest.segments:
            self.build_segment(index, s)

    def create_in_background(self, d: Definition, progress: Callable[[Build], None] | None = None) -> tuple[int, Build]:
        index = self.create(d, build=False)
        todo = self.coverage(index)[1]
        b = Build(total=len(todo))

        def run() -> None:
            try:
                for s in todo:
                    if b._stop:
                        b.state = "CANCELLED"
                        return
                    self.build_segment(index, s)
                    b.done += 1
                    if progress:
                        progress(b)
                b.state = "COMPLETED"
            except Exception as e:
                b.state, b.error = "FAILED", str(e)

        b._thread = threading.Thread(target=run, daemon=True)
        b._thread.start()
        return index, b

    def observer(self) -> Callable[[DocumentStore, Segment], None]:
        """A store observer that builds every index for each new segment."""

        def on_segment(store: DocumentStore, s: Segment) -> None:
            for k in self.indexes():
                self.build_segment(k, s)

        return on_segment

    def table(self, index: int, segments: list[Segment]) -> DataFrame:
        good = [f"{self.store.path}/indexes/{index}/{s.name}" for s in segments]
        d = self.indexes()[index]
        if not good:
            empty = self.store.spark.createDataFrame([], "key binary, seq long, doc variant")
            return side_table(empty, d)
        return self.store.spark.read.parquet(*good)

    # --- lookups: candidate keys ---

    def lookup(self, index: int, op: str, values: tuple = (), snapshot: Snapshot | None = None, distinct: bool = True) -> DataFrame:
        """Candidate keys of the covered segments: EQ, IN, EXISTS by the side table, ABSENT by its complement there.

        Without `distinct` a key may stand more than once, and nothing is shuffled but for ABSENT.
        """
        have, _ = self.coverage(index, snapshot)
        rows = self.table(index, have)
        if op in ("EQ", "IN"):
            test = F.lit(False)
            for v in values:
                if v is None:
                    test = test | (F.col("tag") == -1)
                else:
                    tag, text = term_of(v)
                    long = len(text.encode()) > MAX_TERM_BYTES
                    test = test | ((F.col("tag") == -1) if long else (F.col("tag") == tag) & (F.col("term") == text))
            found = rows.filter(test).select("key")
            return found.distinct() if distinct else found
        if op == "EXISTS":
            return rows.select("key").distinct() if distinct else rows.select("key")
        if op == "ABSENT":
            every = self.store.read_segments([s.name for s in have]).filter(F.col("doc").isNotNull()).select("key", "seq").distinct()
            return every.join(rows.select("key", "seq").distinct(), ["key", "seq"], "left_anti").select("key").distinct()
        raise ValueError(op)

    def lookup_tuple(self, index: int, values: dict[str, object], snapshot: Snapshot | None = None, distinct: bool = True) -> DataFrame:
        """Candidate keys of documents with an element whose declared fields have these values."""
        d = self.indexes()[index]
        text = "\x1f".join("\x1e".join((str(t), x)) for t, x in (term_of(values[f]) for f in d.fields))
        found = self.table(index, self.coverage(index, snapshot)[0]).filter((F.col("tag") == 9) & (F.col("term") == text)).select("key")
        return found.distinct() if distinct else found

    def evaluate(self, index: int, leaf: Predicate, snapshot: Snapshot | None = None, distinct: bool = True) -> DataFrame:
        """Candidate keys of a comparison over a column index, or of several that one value meets (an And over a single-valued path).

        Typed columns prune, and decide where they hold the value itself; else the stored value does.
        """
        rows = self.table(index, self.coverage(index, snapshot)[0])
        for part in leaf.parts if isinstance(leaf, And) else (leaf,):
            rows = rows.filter(self._value_filter(part))
        found = rows.select("key")
        return found.distinct() if distinct else found

    def _value_filter(self, leaf: Predicate) -> Column:
        from .predicates import value_test

        op, values = ("=", leaf.values) if isinstance(leaf, In) else (leaf.op, (leaf.value,))
        test = F.lit(False)
        for v in values:
            exact = value_test(op, v)(F.col("v"))
            if isinstance(v, str):
                test = test | ({"=": F.col("txt") == v, "<": F.col("txt") < v, "<=": F.col("txt") <= v, ">": F.col("txt") > v, ">=": F.col("txt") >= v}[op])
            elif isinstance(v, bool):
                test = test | (F.col("bool") == v)
            elif v is None:
                test = test | F.col("is_null")
            else:
                near = F.lit(v).cast("decimal(38,18)") if abs(v) < 10**20 and -v.as_tuple().exponent <= 18 else None
                prune = F.lit(True) if near is None else ({"=": F.col("num") == near, "<": F.col("num") <= near, "<=": F.col("num") <= near, ">": F.col("num") >= near, ">=": F.col("num") >= near}[op])
                # The first part alone can be pushed down to the files.
                sure = F.lit(False) if near is None else {"=": F.col("num") == near, "<": F.col("num") < near, "<=": F.col("num") <= near, ">": F.col("num") > near, ">=": F.col("num") >= near}[op]
                decided = F.lit(False) if near is None else F.coalesce("exact", F.lit(False))
                test = test | ((F.col("num").isNull() | prune) & F.when(decided, sure).otherwise(exact))
        return test


def short(value) -> bool:
    """Whether a literal's term is kept in inverted indexes as it is."""
    return len(term_of(value)[1].encode()) <= MAX_TERM_BYTES


def indexable(leaf: Predicate, d: Definition) -> bool:
    """Whether an index answers a leaf: equality by an inverted one or a column, ranges by a column only."""
    if not isinstance(leaf, (Compare, In)) or str(leaf.path) != str(CatalogPath.parse(d.path)):
        return False
    return d.kind == "column" or d.kind == "inverted" and (isinstance(leaf, In) or leaf.op == "=")
