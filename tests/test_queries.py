"""Every query with SQL against DuckDB on the smallest tables; the others run, and have typed columns of different names.

Their values are tested in test_pipelines.py, test_operators.py and test_search.py.
"""

import os
from collections import Counter

import duckdb
import pytest

from anamnesis.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    assert len(set(c.lower() for c in cols)) == len(cols) and "void" not in df.schema.simpleString()
    rows = Counter(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if sql := registry.oracle_sql().get(name):
        res = duck.execute(sql)
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        assert rows == Counter(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in res.fetchall())
