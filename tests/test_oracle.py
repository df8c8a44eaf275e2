"""Every query with a DuckDB equivalent gives the same rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from registra import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(round(v, 6)) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def _rows(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_same_rows(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = df.collect()
    cursor = duck.execute(plans.oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, got) == _rows(names, cursor.fetchall())
