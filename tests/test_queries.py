"""Every query of the core with SQL against DuckDB over whole tables; the rest runs and is not empty."""

import math
from collections import Counter

import duckdb
import pytest

from spindrift.plans import extraction, fusion, nested, quality, scoring, texts, validation

MODULES = [nested, validation, fusion, quality, texts, extraction, scoring]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings triples raw_triples chunks entities match_pairs provenance mitre eval_items ref_values".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    res = duck.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
