"""The registered relational queries against the oracle, and the fixtures' shape."""

import math

import duckdb
import pytest

from taskloom.plans import catalog
from taskloom.sources import fixtures


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in fixtures.TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in got.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in df.collect()) == want


def test_expand_names_each_view_once():
    text = fixtures.expand("select count(*) from f_job_stats s join f_events e on true")
    assert text.count("f_events as (") == 1 and text.index("f_events as (") < text.index("f_job_stats as (")


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
