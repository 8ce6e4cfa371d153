"""Every registered query with SQL is compared with DuckDB on the smallest tables; the others must run."""

import importlib.util

import duckdb
import pytest
from lodestone import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = []
    for r in frame.itertuples(index=False):
        clean.append(tuple("" if v is None or v != v else f"{float(v):.5g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r))
    return sorted(clean)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = db.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_imports():
    assert importlib.util.find_spec("__spark_entry__")
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
