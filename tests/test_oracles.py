"""Every query with an oracle against DuckDB, on the small tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pytest

from obsmill import registry
from obsmill.plans.surrogate import TABLES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def rows(table) -> list[tuple[str, ...]]:
    def plain(x):
        if isinstance(x, float):
            return "None" if x != x else f"{x:.9g}"
        return str(x.replace(tzinfo=None)) if isinstance(x, datetime.datetime) else str(x)

    names = sorted(table.column_names)
    return sorted(tuple(plain(r[c]) for c in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, name):
    got = registry.queries()[name](spark, SF).toArrow()
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = db.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_every_query_is_named_once():
    assert len(registry.queries()) >= 80
    assert set(registry.oracle_sql()) <= set(registry.queries())
