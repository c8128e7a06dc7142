"""Queries read whole tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from obsmill import registry
from obsmill.operators import match
from obsmill.plans.surrogate import TABLES
from tests.test_oracles import SF, rows

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def wanted(sql: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db.sql(sql).to_arrow_table()


def test_photo_evidence_has_all_neighbouring_owners(spark):
    want = wanted("WITH o AS (SELECT DISTINCT vec_id % 100 AS owner FROM embeddings) SELECT a.owner AS a, b.owner AS b FROM o a JOIN o b ON b.owner = a.owner + 1")
    got = registry.queries()["photo_evidence"](spark, SF).select("a", "b").toArrow()
    assert rows(got) == rows(want)


def test_reconcile_names_a_villa_for_every_cluster(spark):
    want = wanted("SELECT DISTINCT CAST((o_orderkey + o_custkey % 2) // 3 AS VARCHAR) AS key FROM orders")
    got = registry.queries()["reconcile_ids"](spark, SF).where("what = 'villa'").toArrow()
    assert rows(got.select(["key"])) == rows(want)
    assert len(set(got["villa"].to_pylist())) == got.num_rows


def test_display_ranges_in_kilometres(spark):
    got = {r["id"]: r["metres"] for r in registry.queries()["display_ranges"](spark, SF).collect()}
    assert len(got) == wanted("SELECT * FROM part").num_rows
    assert got[303] == "۹۰۰ تا ۱٬۰۰۰ متر"
    assert got[304] == "۰٫۹ تا ۱٫۱ کیلومتر" and got[500] == "۱٫۵ تا ۱٫۶ کیلومتر" and got[1000] == "۳ تا ۳٫۱ کیلومتر"


def test_blocks_count_every_pair_once(spark):
    v = spark.range(23).select("id", (F.col("id") % 3).alias("label"), F.array(*(F.sin(F.col("id") * k).cast("float") for k in (1, 2, 5))).alias("v"))
    v = v.where("id > 0")
    one, many = (sorted(tuple(r) for r in match.cosine_counts(v, block).collect()) for block in (2048, 4))
    assert one == many and sum(r[2] for r in one) == 22 * 21 // 2
