"""Planning and explaining: which indexes narrow a query down, in what order, with what is left to scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.paths import CatalogPath
from ..operators.indexes import Definition, IndexRegistry, indexable, short
from ..operators.predicates import TRUE, And, Compare, ElemMatch, Exists, In, IsNull, Not, Or, Predicate, normalise
from ..operators.query import KEYS, Query
from ..operators.schema import NUMERIC, Schema, selectivity
from ..sources.store import DocumentStore, Snapshot, as_key


@dataclass
class Source:
    """One index lookup of a plan."""

    leaf: Predicate
    index: int
    definition: Definition
    keys: DataFrame
    certain: bool = False  # whether the lookup's keys are the leaf's answer, not just candidates for it
    once: bool = False  # whether no key stands twice among a segment's
    leaves: int = 1  # conjuncts that it answers
    candidates: int | None = None
    estimate: float | None = None


@dataclass
class Plan:
    query: Query
    predicate: Predicate
    sources: list[Source] = field(default_factory=list)
    indexed: list[str] = field(default_factory=list)
    scanned: list[str] = field(default_factory=list)
    skipped: int = 0
    notes: list[str] = field(default_factory=list)

    def text(self) -> str:
        lines = [f"predicate {self.predicate}"]
        for s in self.sources:
            measured = "" if s.candidates is None else f" candidates {s.candidates}"
            guess = "" if s.estimate is None else f" estimate {s.estimate:.3f}"
            lines.append(f"  {s.definition.kind} {s.definition.path} {list(s.definition.fields) or ''}: {s.leaf}{measured}{guess}")
        lines.append(f"  segments indexed {len(self.indexed)}, scanned {len(self.scanned)}, skipped {self.skipped}")
        return "\n".join(lines + [f"  note: {n}" for n in self.notes])


def _tuple_values(p: ElemMatch) -> dict[str, object]:
    """Fields that an elemMatch fixes to one value each."""
    parts = p.operand.parts if isinstance(p.operand, And) else (p.operand,)
    return {str(x.path): x.value for x in parts if isinstance(x, Compare) and x.op == "=" and not x.path.multiple and x.value is not None}


class Engine:
    """Queries over a store with its indexes."""

    def __init__(self, store: DocumentStore, indexes: IndexRegistry | None = None, schema: Schema | None = None):
        self.store, self.indexes, self.schema = store, indexes or IndexRegistry(store), schema

    def plan(self, query: Query, snapshot: Snapshot | None = None, measure: bool = False) -> Plan:
        snap = snapshot or self.store.snapshot()
        p = normalise(query.predicate)
        first, last = (None if k is None else as_key(k) for k in (query.first, query.last))
        live = [s for s in snap.manifest.segments if s.may_hold(first, last)]
        plan = Plan(query, p, skipped=len(snap.manifest.segments) - len(live))
        defined = self.indexes.indexes()
        for leaf in p.parts if isinstance(p, And) else (p,):
            best = None
            for k, d in sorted(defined.items()):
                if isinstance(leaf, ElemMatch) and d.kind == "composite" and str(leaf.path) == str(CatalogPath.parse(d.path)):
                    values = _tuple_values(leaf)
                    fields = {f: values.get(str(CatalogPath.parse(f))) for f in d.fields}
                    if all(v is not None for v in fields.values()):
                        parts = leaf.operand.parts if isinstance(leaf.operand, And) else (leaf.operand,)
                        best = Source(leaf, k, d, self.indexes.lookup_tuple(k, fields, snap, False), len(parts) == len(fields))
                        break
                elif indexable(leaf, d) and (best is None or d.kind == "inverted"):
                    op = "IN" if isinstance(leaf, In) else "EQ"
                    values = leaf.values if isinstance(leaf, In) else (leaf.value,)
                    keys = self.indexes.lookup(k, op, values, snap, False) if d.kind == "inverted" else self.indexes.evaluate(k, leaf, snap, False)
                    # An inverted index holds a term once a key and segment; a column holds a value a node.
                    once = op == "EQ" if d.kind == "inverted" else not CatalogPath.parse(d.path).multiple
                    best = Source(leaf, k, d, keys, d.kind == "column" or all(v is not None and short(v) for v in values), once)
                elif isinstance(leaf, (Exists, IsNull)) and d.kind == "inverted" and str(leaf.path) == str(CatalogPath.parse(d.path)):
                    best = best or Source(leaf, k, d, self.indexes.lookup(k, "EXISTS", (), snap, False), isinstance(leaf, Exists))
                elif isinstance(leaf, Not) and isinstance(leaf.part, Exists) and d.kind == "inverted" and str(leaf.part.path) == str(CatalogPath.parse(d.path)):
                    best = best or Source(leaf, k, d, self.indexes.lookup(k, "ABSENT", (), snap), True)
            if best is not None:
                best.estimate = self._estimate(leaf)
                plan.sources.append(best)
        plan.sources = self._together(plan.sources, snap)
        covered = None
        for s in plan.sources:
            have = {x.name for x in self.indexes.coverage(s.index, snap)[0]}
            covered = have if covered is None else covered & have
        plan.indexed = [s.name for s in live if covered is not None and s.name in covered]
        plan.scanned = [s.name for s in live if s.name not in plan.indexed]
        if measure:
            for s in plan.sources:
                s.candidates = s.keys.distinct().count()
            plan.sources.sort(key=lambda s: s.candidates)
        else:
            plan.sources.sort(key=lambda s: 1.0 if s.estimate is None else s.estimate)
        if self.schema:
            plan.notes += type_notes(p, self.schema)
        return plan

    def _together(self, sources: list[Source], snap: Snapshot) -> list[Source]:
        """Comparisons over one column of a single-valued path as one lookup, so that a range reads its rows once."""
        out: dict[object, list[Source]] = {}
        for i, s in enumerate(sources):
            single = s.definition.kind == "column" and s.once and isinstance(s.leaf, (Compare, In))
            out.setdefault(s.index if single else ("own", i), []).append(s)
        made = []
        for group in out.values():
            if len(group) == 1:
                made += group
                continue
            leaf = And(tuple(s.leaf for s in group))
            guesses = [s.estimate for s in group if s.estimate is not None]
            made.append(Source(leaf, group[0].index, group[0].definition, self.indexes.evaluate(group[0].index, leaf, snap, False), True, True, len(group), None, min(guesses) if guesses else None))
        return made

    def _estimate(self, leaf: Predicate) -> float | None:
        if self.schema is None:
            return None
        if isinstance(leaf, Not):
            return 1 - (self._estimate(leaf.part) or 0.0)
        if isinstance(leaf, ElemMatch):
            return None
        kind = "EXISTS" if isinstance(leaf, Exists) else "IS_NULL" if isinstance(leaf, IsNull) else "EQ" if isinstance(leaf, In) or leaf.op == "=" else "RANGE"
        return selectivity(self.schema, kind, leaf.path, len(leaf.values) if isinstance(leaf, In) else 1)

    def run(self, query: Query, snapshot: Snapshot | None = None, ordered: bool = True) -> DataFrame:
        """The answer: candidates by semi-joins on key, the most selective first, then the document's own recheck.

        Where the lookups answer all conjuncts for certain, all segments have side tables, no key stands in two of them, and keys
        are all that is asked for, no document is read.
        """
        snap = snapshot or self.store.snapshot()
        plan = self.plan(query, snap)
        leaves = len(plan.predicate.parts) if isinstance(plan.predicate, And) else 1
        if query.projection == KEYS and plan.sources and not plan.scanned and leaves == sum(s.leaves for s in plan.sources) and all(s.certain for s in plan.sources):
            first, last = (None if k is None else as_key(k) for k in (query.first, query.last))
            if not self.store.versions(snap, first, last)[1]:
                keys = plan.sources[0].keys if plan.sources[0].once else plan.sources[0].keys.distinct()
                for s in plan.sources[1:]:
                    keys = keys.join(s.keys, "key", "left_semi")
                bounds = (None if k is None else bytearray(k) for k in (first, last))
                return Query(TRUE, KEYS, *bounds, query.limit).on(keys, ordered=ordered)
        docs = self.store.scan(query.first, query.last, snap, ordered=False)
        if plan.sources and plan.indexed:
            keys = plan.sources[0].keys
            for s in plan.sources[1:]:
                keys = keys.join(s.keys, "key", "left_semi")
            if plan.scanned:  # keys of segments without side tables are all candidates
                keys = keys.unionByName(self.store.read_segments(plan.scanned).select("key")).distinct()
            docs = docs.join(keys, "key", "left_semi")
        return query.on(docs, ordered=ordered) if query.first is None and query.last is None else Query(query.predicate, query.projection, None, None, query.limit).on(docs, ordered=ordered)

    def explain(self, query: Query, snapshot: Snapshot | None = None) -> str:
        return self.plan(query, snapshot, measure=True).text()

    def stats(self, query: Query, snapshot: Snapshot | None = None) -> dict:
        """Counters of a query: rows returned, candidate keys, segments indexed, scanned and skipped."""
        plan = self.plan(query, snapshot, measure=True)
        return {
            "rows_returned": self.run(query, snapshot, ordered=False).count(), "candidate_keys": plan.sources[0].candidates if plan.sources else None,
            "segments_indexed": len(plan.indexed), "segments_scanned": len(plan.scanned), "segments_skipped": plan.skipped,
        }


def type_notes(p: Predicate, schema: Schema) -> list[str]:
    """Where at least 1 % of a path's values are of another family than the literal compared with them."""
    out: list[str] = []

    def walk(q: Predicate) -> None:
        if isinstance(q, (And, Or)):
            for x in q.parts:
                walk(x)
        elif isinstance(q, Not):
            walk(q.part)
        elif isinstance(q, (Compare, In)):
            model = schema.get(q.path) if not q.path.descends else None
            for v in q.values if isinstance(q, In) else (q.value,):
                if model is None or v is None:
                    continue
                family = ["BOOLEAN"] if isinstance(v, bool) else ["STRING"] if isinstance(v, str) else NUMERIC
                values = sum(n for k, n in model.kinds.items() if k not in ("NULL", "ARRAY", "OBJECT"))
                other = sum(n for k, n in model.kinds.items() if k not in ("NULL", "ARRAY", "OBJECT", *family))
                if values and other >= 0.01 * values:
                    out.append(f"{q.path}: {other} of {values} values are not {family[0].lower()}")

    walk(p)
    return list(dict.fromkeys(out))


