"""Results that a larger or differently laid out table must not change."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from obsmill import registry
from obsmill.operators import blocks, graph, match
from obsmill.plans.surrogate import TABLES
from tests.test_oracles import SF, rows

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def tables(folder: Path, **made: str) -> str:
    """A folder with the test tables, some of them made by SQL over the others."""
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        if t not in made:
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    for t, sql in made.items():
        db.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


def agrees(spark, name: str, folder: str) -> None:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        files = f"{folder}/{t}.parquet" + "/*.parquet" * Path(folder, f"{t}.parquet").is_dir()
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    want = db.sql(registry.oracle_sql()[name]).to_arrow_table()
    got = registry.queries()[name](spark, folder).toArrow()
    assert rows(got) == rows(want)


def test_wait_queue_has_one_place_for_each_waiting_row(spark, tmp_path):
    # ids 15,600 apart are the same pair
    folder = tables(tmp_path, part="SELECT * FROM part UNION ALL SELECT * REPLACE (p_partkey + 15600 AS p_partkey) FROM part")
    got = registry.queries()["wait_queue"](spark, folder).toArrow().to_pydict()
    assert len(set(got["id"])) == len(got["id"]) == len(set(got["position"]))


def test_frontier_over_files_in_any_order(spark, tmp_path):
    folder = tables(tmp_path, events="SELECT * FROM events WHERE false")
    (tmp_path / "events.parquet").unlink()
    (tmp_path / "events.parquet").mkdir()
    for k, part in enumerate(("ts >= TIMESTAMP '2024-01-12'", "ts < TIMESTAMP '2024-01-12' AND event_id % 2 = 0", "ts < TIMESTAMP '2024-01-12' AND event_id % 2 = 1")):
        duckdb.sql(f"COPY (SELECT * FROM read_parquet('{SF}/events.parquet') WHERE {part}) TO '{tmp_path}/events.parquet/{k}.parquet' (FORMAT parquet)")
    agrees(spark, "stream_frontier", folder)


def test_copies_of_points_and_places_meet_once(spark):
    points = spark.createDataFrame([(k, 36.0, 51.0) for k in range(300)] + [(300, 36.005, 51.0)], "id long, lat double, lon double")
    places = spark.createDataFrame([("k0", f"p{k:03}", 36.0, 51.0) for k in range(300)], "kind string, name string, lat double, lon double")
    asks = points.selectExpr("lat AS la", "lon AS oa").distinct()
    assert match._reached(asks, places.groupBy("kind", "lat", "lon").agg(F.min("name")), 2000.0).count() == 2
    got = match.nearest(points, places, 2000.0).collect()
    assert len(got) == 301 and {r["name"] for r in got} == {"p000"}
    pairs = match.near_pairs(points.withColumn("r", F.col("id") % 2), 2000.0, lambda m, a, b: a["r"] + b["r"]).groupBy("metres").count().collect()
    assert {r["metres"]: r["count"] for r in pairs} == {0: 151 * 150 // 2, 1: 151 * 150, 2: 150 * 149 // 2}


def photos(spark, n: int):
    """Vectors of which some are copies of others."""
    return spark.range(n).select("id", (F.col("id") % 7).alias("owner"), F.array(*(F.sin(F.floor(F.col("id") / 3) * k + 1).cast("float") for k in range(2, 18))).alias("v"))


def test_top_of_blocks_is_the_top_of_all(spark):
    v = photos(spark, 400)
    one, many = (sorted(tuple(r) for r in match.cosine_topk(v, 5, block=block).collect()) for block in (2048, 50))
    assert one == many and len(one) == 2000


def test_links_have_the_closure_of_pairs_and_fewer_rows(spark):
    h = spark.range(600).select("id", F.shiftrightunsigned(F.xxhash64(F.floor(F.col("id") / 2)), 40).alias("h"))
    pairs, links = match.hamming_pairs(h, 5, 40).select("a", "b"), match.hamming_links(h, 5, 40)
    closure = lambda x: sorted(tuple(r) for r in graph.components(x).collect())
    assert closure(pairs) == closure(links)
    big = match.hamming_links(h, 12).count()
    assert big < 600 < match.hamming_pairs(h, 12).count()


def test_pairs_within_owners_in_blocks(spark):
    one, many = (sorted(tuple(r) for r in match.cosines_within(photos(spark, 150), block).collect()) for block in (1024, 5))
    assert one == many and len({(a, b) for a, b, _ in one}) == len(one) == sum(n * (n - 1) // 2 for n in (22, 22, 22, 21, 21, 21, 21))


@pytest.mark.parametrize("pairs", [1 << 22, 200, 7])
def test_matching_in_turns_is_greedy(monkeypatch, pairs):
    monkeypatch.setattr(blocks, "SLICE", pairs)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(14, 16)).repeat(4, axis=0)[rng.permutation(56)]
    h = [int("".join("01"[int(x > 0)] for x in r), 2) for r in v]
    side = lambda s: pa.table({"a": [1] * 28, "b": [2] * 28, "id": range(s.start, s.stop), "v": list(v[s]), "h": h[s], "df": [k % 3 for k in range(28)]})
    got = blocks.matched(0, 0.55)(side(slice(0, 28)), side(slice(28, 56))).to_pylist()[0]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    order = []
    for i in range(28):
        for j in range(28, 56):
            c, d = round(float(unit[i] @ unit[j]) + 0.55, 4), (h[i] ^ h[j]).bit_count()
            order.append((-1.0 if d <= 6 or c >= 0.92 else -0.5 if d <= 10 or c >= 0.85 else 0.0, -c, d, i, j))
    left, right, taken = set(), set(), []
    for s, _, _, i, j in sorted(order):
        if s and i not in left and j not in right:
            left.add(i), right.add(j), taken.append((-s, i))
    assert (got["strong"], got["weak"]) == (sum(s == 1 for s, _ in taken), sum(s < 1 for s, _ in taken))
    assert got["weighted"] == round(sum(s / max(1, i % 3) for s, i in taken), 4)
    assert (got["best_cosine"], got["best_hamming"]) == (-min(o[1] for o in order), min(o[2] for o in order))


def test_counts_of_one_task_are_added_up():
    n = np.zeros(blocks.PACK + 5, dtype=np.int64)
    n[[3, blocks.PACK + 1]] = 2, 7
    batches = [blocks._packed({True: n}).to_batches()[0]] * 3
    rows_ = pa.Table.from_batches(list(blocks.add_up(iter(batches))))
    assert rows_.num_rows == 2
    got = [blocks.unpacked(rows_.slice(k, 1)).to_pylist()[0] for k in (0, 1)]
    assert [(r["c"] + blocks.PLACES + 1, r["n"]) for r in got] == [(3, 6), (blocks.PACK + 1, 21)]


def test_reconcile_assigns_once(spark):
    old = spark.range(900).select(F.concat(F.lit("v"), (F.col("id") / 3).cast("int").cast("string")).alias("villa"), "id")
    new = spark.range(900).select(F.floor((F.col("id") + F.col("id") % 7 % 2) / 3).alias("cluster"), "id")
    villas, events = match.reconcile(old, new)
    for df in (villas, events):  # the assignment and the overlaps are tables, not plans that each reader runs again
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    got = villas.toArrow()
    assert got.num_rows == new.select("cluster").distinct().count() == len(set(got["villa"].to_pylist()))
