"""Headline queries over order documents and corpus operators; prints one JSON line."""

import json
import os
import shutil
import tempfile
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import functions as F

    from looseleaf import queries as engine
    from looseleaf.functions import variants as V
    from looseleaf.functions.jsonpath import JsonPath
    from looseleaf.operators import indexes
    from looseleaf.operators import schema as S
    from looseleaf.operators.predicates import path
    from looseleaf.operators.query import DOCUMENT, Projection, Query
    from looseleaf.plans.planner import Engine
    from looseleaf.sources.store import DocumentStore

    root = tempfile.mkdtemp(prefix="looseleaf-bench-")
    spark = V.session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": f"{root}/warehouse", "spark.checkpoint.dir": f"file://{root}/shared"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, run, times=2):
        best = None
        for _ in range(times):
            began = time.perf_counter()
            run()
            spent = time.perf_counter() - began
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 3)

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    # The same documents twice: one store is only scanned, the other has side tables.
    plain, full = DocumentStore(spark, f"{root}/plain"), DocumentStore(spark, f"{root}/indexed")
    timed("ingest_orders", lambda: plain.append(engine.order_docs(spark, SF)), 1)
    full.append(plain.scan(ordered=False))
    reg = indexes.IndexRegistry(full)
    wanted = [indexes.inverted("$.priority"), indexes.inverted("$.score"), indexes.column("$.total"), indexes.composite("$.items[*]", "$.flag", "$.qty")]
    timed("build_indexes", lambda: [reg.create(d) for d in wanted], 1)
    scan, index = Engine(plain), Engine(full, reg)
    p = path
    cases = {
        "equality": p("$.priority").eq("1-URGENT"),
        "conjunction": p("$.priority").eq("1-URGENT") & p("$.total").ge(300000),
        "range": p("$.total").between(100000, 110000),
        "elem_match": p("$.items[*]").elem_match(p("$.flag").eq("R") & p("$.qty").eq(7)),
    }
    for name, q in cases.items():
        a, b = scan.run(Query.where(q), ordered=False).count(), index.run(Query.where(q), ordered=False).count()
        assert a == b, name
        timed(f"{name}_scan_keys", lambda q=q: drain(scan.run(Query.where(q), ordered=False)))
        timed(f"{name}_index_keys", lambda q=q: drain(index.run(Query.where(q), ordered=False)))
    project = Query.where(cases["equality"]).project(Projection.of("$.status", "$.total"))
    timed("equality_scan_fields", lambda: drain(scan.run(project, ordered=False)))
    timed("equality_index_documents", lambda: drain(index.run(Query.where(cases["equality"]).project(DOCUMENT), ordered=False)))
    docs = plain.scan(ordered=False)
    timed("descendant", lambda: drain(Query.where(p("$..name").eq("leaf-3")).on(docs, ordered=False)))
    timed("jsonpath_native", lambda: drain(docs.select(JsonPath.compile("$.items[0].qty").column("doc"))))
    timed("jsonpath_filter", lambda: drain(docs.select(JsonPath.compile("$.items[?@.qty > 45].price").nodes_column("doc"))))
    timed("infer_schema", lambda: S.infer_schema(docs), 1)
    timed("point_get", lambda: plain.get("0000000100"))
    timed("key_range", lambda: drain(plain.scan("0000000100", "0000000900", ordered=False).select("key", F.to_json("doc"))))
    try:
        from looseleaf.llm import queries as corpus

        for name, run in corpus.queries().items():
            timed(name, lambda run=run: drain(run(spark, SF)), 1)
    except ImportError:
        pass
    spark.stop()
    shutil.rmtree(root, ignore_errors=True)
    print(json.dumps({"metric": "looseleaf_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
