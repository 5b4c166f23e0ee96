"""Every query beside its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from leafpress.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(df, columns):
    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry_point():
    import __spark_entry__ as entry

    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_alone():
    """Nothing outside the llm subpackage imports it."""
    root = os.path.join(os.path.dirname(__file__), "..", "leafpress")
    for p in glob.glob(f"{root}/**/*.py", recursive=True):
        if "/llm/" not in p:
            assert "leafpress.llm" not in open(p).read(), p
