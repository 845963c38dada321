"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from loamgrid.plans import catalog
from tests.conftest import SF

TABLES = "documents labels benchmark pages embeddings events part conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    if name in catalog.ORACLE:
        rel = duck.execute(catalog.ORACLE[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
        assert got == want
