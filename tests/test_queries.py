"""Every registered query runs; those with SQL equal DuckDB's result."""

import math
import os

import duckdb
import pytest

from frameloom.catalogue import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return tuple(map(norm, x)) if isinstance(x, (list, tuple)) else x


def rows(data):
    return sorted((tuple(map(norm, r)) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    data = [tuple(r) for r in got.select(*names).collect()]
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == names
        assert rows(data) == rows(rel.select(*[f'"{n}"' for n in names]).fetchall())
    else:
        assert len(data) > 0
