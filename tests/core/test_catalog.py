"""Every query with an SQL twin against DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from evidentia import catalog

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0) if v != int(v) else str(int(v))
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_answers(spark, sf_dir):
    rows = catalog.grounded_answers(spark, sf_dir).collect()
    assert rows and all(r.citation_status == "ok" and r.cited == "1" for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
