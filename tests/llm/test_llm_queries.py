"""The training-data queries that SQL can express against DuckDB; all others run and are not empty."""

import math
from collections import Counter

import duckdb
import pytest

from spindrift.llm.queries import QUERIES, SQL

TABLES = "documents triples raw_triples chunks entities match_pairs provenance mitre eval_items ref_values".split()


def plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    got = Counter(tuple(plain(r[x]) for x in sorted(df.columns)) for r in df.collect())
    res = c.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == sorted(df.columns)
    assert got == Counter(tuple(plain(row[names.index(x)]) for x in sorted(names)) for row in res.fetchall())


COLUMNS = {
    "p1_found": ["event_id", "confidence_seq", "evidence_seq", "status_seq"], "p3_found": ["first_seq", "seq"], "p4_found": ["doc_id", "char_start", "char_end"], "p5_found": ["group_node_id", "node_id"],
    "p6_found": ["field", "record_key", "written", "entry"], "p7_found": ["name_1", "name_2"], "p8_ids": ["doc_id", "ids"], "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    # The smallest tables hold no leak, as the SQL of p9_found says too.
    assert df.count() > 0 or name == "p9_leaks" and QUERIES["p9_found"](spark, data).count() == 0
