"""Every registered query against its DuckDB oracle, and the driver contract."""

import datetime as dt
import math
import os
from collections import Counter

import pytest

from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, dt.date):
        return v.isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


def _names():
    import __spark_entry__ as e
    return sorted(e.queries())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as e
    df = e.queries()[name](spark, SF_SMALL)
    cols, rows = df.columns, df.collect()
    sql = e.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no SQL oracle")
    cur = duck.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    order = sorted(cols)
    a = Counter(tuple(_norm(r[cols.index(c)]) for c in order) for r in rows)
    b = Counter(tuple(_norm(r[ocols.index(c)]) for c in order) for r in orows)
    assert a == b


def test_every_query_of_the_domain_has_an_oracle():
    import __spark_entry__ as e
    from opsloss.plans import catalog
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["event_date", "operation_name", "role_name", "event_count", "avg_duration_sec",
                          "norm_seconds", "hourly_rate", "delta_sec", "total_loss", "z_score"]


def test_plan_pushes_filter_and_broadcasts(spark):
    """The raw report: time predicate reaches the Parquet scan, dims are broadcast."""
    import __spark_entry__ as e
    df = e.queries()["daily_losses_raw_lineitem"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
