import json
import random

import pytest
from pyspark.sql import functions as F

from looseleaf.functions import variants as V
from looseleaf.operators import indexes
from looseleaf.operators.predicates import path
from looseleaf.operators.query import Projection, Query, successor
from looseleaf.plans.planner import Engine
from looseleaf.sources.store import Closed, Corrupt, DocumentStore, Locked, Options, StoreError, WriteBatch, as_key
from looseleaf.streaming.ingest import drain, ingest_lines


def live(store, **kw):
    return {bytes(r.key).decode(): json.loads(r.t) for r in store.scan(ordered=False, **kw).select("key", F.to_json("doc").alias("t")).collect()}


def test_model_of_random_steps(spark, tmp_path):
    rng, model = random.Random(3), {}
    store = DocumentStore(spark, str(tmp_path / "s"))
    snaps = []
    for step in range(14):
        what = rng.randrange(6)
        keys = [f"k{rng.randrange(20):02d}" for _ in range(4)]
        if what < 2:
            for k in keys:
                store.put(k, json.dumps({"v": step}))
                model[k] = {"v": step}
            store.flush()
        elif what == 2:
            batch = WriteBatch()
            for k in keys:
                batch.delete(k)
                model.pop(k, None)
            store.write(batch)
        elif what == 3:
            a, b = sorted(keys[:2])
            gone = [k for k in model if a <= k <= b]
            assert store.delete_range(a, b) == len(gone)
            for k in gone:
                del model[k]
        elif what == 4:
            snaps.append((store.snapshot(), dict(model)))
        else:
            store.compact(snaps[0][0] if snaps else None)
        assert live(store) == model
    for snap, then in snaps[:1]:
        assert live(store, snapshot=snap) == then
    assert store.delete_range("z", "a") == 0 and store.delete_prefix("k0") == sum(k.startswith("k0") for k in model)
    store.close()
    with pytest.raises(Closed):
        store.manifest()


def test_gets_order_and_recovery(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"))
    store.write(WriteBatch())
    assert store.manifest().version == 0 and store.get("a") is None
    store.put("b", "[1]")
    assert store.get("b") == "[1]"  # pending writes are seen by their writer
    store.write(WriteBatch().put("é", '"x"').put("a", "1").put("a", "2").delete("none"))
    assert [bytes(r.key).decode() for r in store.scan().collect()] == ["a", "b", "é"] and store.get("a") == "2"
    assert store.scan("b", "b").count() == 1 and store.scan_prefix("").count() == 3
    with pytest.raises(ValueError):
        store.write(WriteBatch().put("x", "{bad"))
    store._pending.clear()
    with pytest.raises(UnicodeEncodeError):
        as_key("\ud800")
    # a writer that died before its commit, and a torn manifest, leave the last good version
    spark.createDataFrame([(bytearray(b"x"), 9)], "key binary, seq long").write.parquet(str(tmp_path / "s/data/segment-lost"))
    version = store.manifest().version
    (tmp_path / f"s/manifests/{version + 1:012d}.json").write_text("{")
    again = DocumentStore(spark, str(tmp_path / "s"))
    assert again.manifest().version == version and again.problems and "x" not in live(again)
    again.append(spark.sql("select 'q' as key, parse_json('1') as doc"))  # writing goes on after it
    assert again.manifest().version == version + 2 and "q" in live(again)
    again.delete("q")
    assert "q" not in live(again)  # before its flush
    again.flush()
    with pytest.raises(Locked):
        again.commit_file("manifests", version + 2, "{}")
    for keys in (["u", "u"], ["u", None]):
        before = again.manifest()
        with pytest.raises(ValueError):
            again.append(spark.createDataFrame([(k, "1") for k in keys], "key string, t string").select("key", V.fast_json(F.col("t")).alias("doc")))
        assert again.manifest() == before
    copy = store.checkpoint(str(tmp_path / "copy"))
    assert live(copy) == live(store)
    with pytest.raises(StoreError):
        store.checkpoint(str(tmp_path / "copy"))
    assert successor(b"a") == b"a\0"


def test_segments_outside_a_range_arent_read(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"))
    store.write(WriteBatch().put("a", "1").put("b", "2"))
    store.write(WriteBatch().put("x", "3"))
    part = store.scan("a", "b", ordered=False)
    assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()
    assert {f.split("/")[-2] for f in part.inputFiles()} == {store.manifest().segments[0].name}
    assert live(store) == {"a": 1, "b": 2, "x": 3}
    seen = []
    watched = DocumentStore(spark, str(tmp_path / "w"), Options(observers=(lambda s, x: seen.append(x.rows), lambda s, x: 1 / 0)))
    watched.write(WriteBatch().put("a", "1"))
    assert seen == [1] and watched.problems


def test_indexes_never_change_answers(spark, tmp_path):
    V.configure(spark)
    rows = [(f"key:{i:06d}", json.dumps({"team": f"team-{i % 7}", "score": i % 50, "price": i % 90 + i % 100 / 100, "tags": [f"t{i % 5}", f"t{i % 3}"], "live": i % 3 == 0, **({} if i % 3 == 1 else {"note": None if i % 6 == 2 else f"n{i}"}), "items": [{"sku": f"s{i % 4}", "qty": i % 3}, {"sku": f"s{(i + 1) % 4}", "qty": (i + 2) % 3}], "long": "x" * (600 + i % 2)})) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, text string").select("key", V.fast_json(F.col("text")).alias("doc"))
    store = DocumentStore(spark, str(tmp_path / "s"))
    store.append(df.filter("key < 'key:000060'"))
    reg = indexes.IndexRegistry(store)
    queries = [
        path("$.team").eq("team-3"), path("$.team").one_of("team-1", "nope", None), path("$.score").between(10, 20) & path("$.live").eq(True), path("$.note").is_null(), ~path("$.note").exists() & path("$.team").eq("team-1"),
        path("$.tags[*]").eq("t1") & path("$.score").lt(9.5), path("$.items[*]").elem_match(path("$.sku").eq("s1") & path("$.qty").eq(1)), path("$.long").eq("x" * 601), path("$.score").eq(7) | path("$.team").eq("team-2"), path("$.note").eq("n3"),
    ]
    plain = [sorted(r[0] for r in df.filter(__import__("looseleaf.operators.predicates", fromlist=["x"]).compile_predicate(q, "doc")).select("key").collect()) for q in queries]

    def same(upto):
        engine = Engine(store, reg)
        for q, want in zip(queries, plain):
            got = sorted(bytes(r.key).decode() for r in engine.run(Query.where(q), ordered=False).collect())
            assert got == [k for k in want if k < upto], q

    same("key:000060")
    ids = [reg.create(d) for d in (indexes.inverted("$.team"), indexes.inverted("$.note"), indexes.column("$.score"), indexes.composite("$.items[*]", "$.sku", "$.qty"), indexes.inverted("$.tags[*]"), indexes.inverted("$.long"))]
    same("key:000060")
    store.append(df.filter("key >= 'key:000060'"))
    same("key:999999")  # half of it indexed
    for k in ids[:3]:
        reg.backfill(k)
    same("key:999999")
    store.write(WriteBatch().delete("key:000003").put("key:000010", '{"team":"team-9"}'))
    engine = Engine(store, reg)
    assert sorted(bytes(r.key).decode() for r in engine.run(Query.where(path("$.team").eq("team-3"))).collect()) == [k for k in plain[0] if k not in ("key:000003", "key:000010")]
    assert "inverted $.team" in engine.explain(Query.where(path("$.team").eq("team-3") & path("$.score").gt(3)))
    assert engine.stats(Query.where(path("$.team").eq("team-3")))["segments_scanned"] == 1
    for bad in (("inverted", "$.a", ("$.b",)), ("composite", "$.a", ()), ("other", "$.a", ())):
        with pytest.raises(ValueError):
            indexes.Definition(*bad)
    assert reg.create(indexes.inverted("$.team"), build=False) == ids[0]
    reg.drop(ids[0])
    (tmp_path / f"s/registry/{max(store._versions('registry')):012d}.json").rename(tmp_path / "aside")
    (tmp_path / f"s/registry/{max(store._versions('registry')) + 1:012d}.json").write_text("{")
    with pytest.raises(Corrupt):  # no id is handed out again
        indexes.IndexRegistry(store).create(indexes.inverted("$.other"))
    (tmp_path / "aside").replace(tmp_path / f"s/registry/{max(store._versions('registry')):012d}.json")
    assert ids[0] not in reg.indexes() and reg.create(indexes.inverted("$.team"), build=False) > max(ids)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"a":1}\n\nnot json\n{"a":2}\n')
    store = DocumentStore(spark, str(tmp_path / "s"))
    counts = ingest_lines(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"))
    assert sum(c["documents"] for c in counts) == 2 and sum(c["blank"] for c in counts) == 1 and sum(c["rejected"] for c in counts) == 1
    assert [bytes(r.key).decode()[-20:] for r in store.scan().collect()] == ["a.jsonl:" + f"{i:012d}" for i in (0, 3)]
    (tmp_path / "in/b.jsonl").write_text('{"a":3}\n')
    counts = ingest_lines(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"))
    assert sum(c["documents"] for c in counts) == 1 and store.scan(ordered=False).count() == 3
    shipped = []
    drain(store, lambda part: shipped.extend(bytes(r.key) for r in part.collect()), rows=2)
    assert len(shipped) == 3 and shipped == sorted(shipped) and store.scan(ordered=False).count() == 0
    assert Query().project(Projection.of("$.a")).on(store.scan(ordered=False)).count() == 0
