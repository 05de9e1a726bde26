"""Driver contract: entry, and every oracle-checked query against DuckDB at sf0.001."""

from __future__ import annotations

import pytest

import __spark_entry__ as E

from .conftest import SF001
from .oracle_check import column_type_diff, digest, duck


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["user_id", "mode", "slot", "item_id", "fallback"]


def test_every_query_documented_and_oracles_known():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    for name, fn in qs.items():
        assert fn.__doc__, name


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
    assert not column_type_diff(df.columns, srows, dcols, drows)
