"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tarnlake.plans import catalog
from tarnlake.sources.tables import TABLES

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def tidy(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(tidy, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    rows = sorted(str(tuple(tidy(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name in ORACLES:
        found = con.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert rows == sorted(str(tuple(tidy(r[i]) for i in order)) for r in found.fetchall())
