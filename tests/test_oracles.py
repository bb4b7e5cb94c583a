"""Every query with a statement gives the rows that DuckDB gives for it."""

from __future__ import annotations

import warnings

import duckdb
import pytest

from choicekit.plans import queries as q

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted([tuple("" if v is None else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df = q.QUERIES[name](spark, SF)
        rows = df.collect()
    if name not in q.ORACLE_SQL:
        assert rows
        return
    found = duck.sql(q.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert sorted(found.columns) == order
    assert plain([tuple(r[c] for c in order) for r in rows]) == plain([tuple(r[found.columns.index(c)] for c in order) for r in found.fetchall()])
