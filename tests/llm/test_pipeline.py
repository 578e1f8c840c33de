"""The pipeline against a plain version of its stages, and the one query that SQL can state."""

import os

import duckdb
import pytest

import corpus_pipeline
from looseleaf.llm import decontaminate, license_scan, secret_scan
from looseleaf.llm import queries as corpus

from . import brute
from .test_shingle_dedup import plain_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_stage_by_stage(spark, duck):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    made = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{len(made)}")
        docs = spark.read.parquet(path)
        made.append(docs)
    assert all(d.columns == columns for d in made[:-1])
    kept = {r[0] for r in duck.sql(corpus.OP1_SQL).filter("kept").project("doc_id").fetchall()}
    first = {r.doc_id: r.text for r in made[0].collect()}
    assert set(first) == kept and all(t == texts[i] for i, t in first.items())  # few documents a host: no line is boilerplate here
    groups = plain_groups(sorted(first.items()))
    second = {r.doc_id for r in made[1].collect()}
    assert second == {i for i in groups if groups[i] == i}
    items = [license_scan.words_of(t.encode()) for (t,) in duck.sql("select text from benchmark").fetchall()]
    text_words = {i: b" " + b" ".join(license_scan.words_of(texts[i].encode())) + b" " for i in second}
    leaked = {i for i in second if any(b" " + b" ".join(w) + b" " in text_words[i] for w in items)}
    third = {r.doc_id for r in made[2].collect()}
    assert third <= second - leaked
    index = decontaminate.ItemIndex([(i, t.encode()) for i, t in duck.sql("select item_id, text from benchmark").fetchall()])
    assert third == {i for i in second if not index.hits(texts[i].encode(), 0.8)}
    fourth = {r.doc_id: r for r in made[3].collect()}
    assert set(fourth) == third and all(not secret_scan.base_spans(r.text) and r.n_chars == len(r.text) for r in fourth.values())
    assert all(r.text == texts[i] for i, r in fourth.items() if not secret_scan.scan_text(texts[i]))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=corpus.piece_model())
    for r in made[4].collect():
        ids = sp.encode(fourth[r.doc_id].text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == brute.sha(",".join(map(str, ids)))
    assert corpus_pipeline.run(spark, SF).count() == len(third)


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_sql(spark, duck, name):
    df = corpus.queries()[name](spark, SF)
    order = sorted(df.columns)
    want = duck.sql(corpus.oracle_sql()[name])
    assert sorted(want.columns) == order
    got = sorted(tuple(r[c] for c in order) for r in df.collect())
    assert got == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(corpus.queries()))
def test_every_query_runs(spark, name):
    df = corpus.queries()[name](spark, SF)
    n = df.count()
    if not name.startswith(("op8", "op9")):  # those give a row per place
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()
    df.write.format("noop").mode("overwrite").save()
