"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from looseleaf import queries as engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    return round(float(v), 6)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(norm(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in engine.SQL:
        assert got
        return
    want = duck.sql(engine.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['looseleaf.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 90 and 'pipeline' not in e.queries() and not any(k.startswith('op') for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
