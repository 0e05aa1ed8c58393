"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime

import duckdb
import pytest

from leadweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else str(v) if isinstance(v, datetime.date) else v


def rows(cols, found):
    return sorted((tuple(plain(r[c]) for c in cols) for r in found), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sql, name):
    d = registry.QUERIES[name](spark, SF)
    cols = sorted(d.columns)
    r = sql.execute(registry.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    kinds = {x[0]: str(x[1]) for x in r.description}
    assert {c: kinds[c] for c, k in d.dtypes if k in TYPES} == {c: TYPES[k] for c, k in d.dtypes if k in TYPES}
    assert rows(cols, (dict(zip(names, x)) for x in r.fetchall())) == rows(cols, (x.asDict() for x in d.collect()))
