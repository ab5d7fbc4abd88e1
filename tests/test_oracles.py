"""Every query that has SQL against DuckDB on the smallest tables, those with rounded means on larger ones too."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from strataweave.plans import registry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
MEANS = ("usage_discovery", "rollup_s2s", "rollup_s2db", "rollup_s2broker", "contributors_by_type", "contributors_by_source", "contributors_by_target", "domain_list", "validation_counts", "evidence_chain", "incremental_s2s", "domain_profile")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def duck():
    return {sf: connected(sf) for sf in (SF, LARGER)}


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("sf, name", [(SF, n) for n in sorted(registry.oracle_sql())] + [(LARGER, n) for n in MEANS if n in registry.oracle_sql()])
def test_query_equals_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck[sf].sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
