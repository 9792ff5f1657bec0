import math

import duckdb
import pytest

from __spark_entry__ import entry
from scorelake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") + 0.0 if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr([plain(row[names.index(c)]) for c in sorted(names)]) for row in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in got.collect()) == want


def test_entry(spark):
    assert entry(spark).count() == 10
