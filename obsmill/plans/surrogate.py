"""The test tables shaped like listings, observations and so on, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "listing": """
        SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS platform, o_orderkey AS listing, o_custkey AS villa,
            CAST(nullif(2 + o_orderkey % 5, 6) AS INT) AS base_capacity, CAST(nullif(o_orderkey % 4, 3) AS INT) AS extra_capacity,
            CAST(nullif(1 + o_orderkey % 3, 3) AS INT) AS min_nights, o_orderkey % 7 <> 0 AS fees_known,
            nullif(o_orderkey % 9, 0) * 100000 AS base, nullif(o_orderkey % 11, 0) * 120000 AS weekend, nullif(o_orderkey % 6, 0) * 150000 AS holiday,
            nullif(o_orderkey % 5, 0) * 10000 AS extra_base, nullif(o_orderkey % 4, 0) * 12000 AS extra_weekend, nullif(o_orderkey % 3, 0) * 15000 AS extra_holiday,
            CAST(nullif(o_custkey % 6, 0) AS INT) AS bedrooms, CAST(nullif(o_custkey % 13, 0) * 25 AS INT) AS area,
            1 + (o_orderkey % 400) / CAST(100 AS DOUBLE) AS rating, o_orderkey % 50 AS rating_count, o_orderdate AS seen_at
        FROM {orders}""",
    "observation": """
        SELECT l_orderkey AS listing, DATE '2024-01-01' + l_linenumber AS night, l_shipdate AS observed_at,
            CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'booked' ELSE 'unknown' END ELSE 'available' END AS availability,
            CASE WHEN l_discount = 0 THEN NULL ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS price,
            CASE WHEN l_tax < 0.03 THEN NULL ELSE CAST(round(l_tax * 1000000) AS BIGINT) END AS extra_price,
            CAST(nullif(l_suppkey % 3, 0) AS INT) AS min_nights,
            CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_holiday,
            l_partkey AS tie1, l_suppkey AS tie2, l_extendedprice AS tie3, l_quantity AS tie4
        FROM {lineitem}""",
    "snapshot": """
        SELECT event_id AS id, concat('https://h', user_id % 7, '.example.org/', user_id) AS url, CAST(user_id AS VARCHAR(20)) AS request_key, user_id % 3 AS run_id,
            event_type AS kind, CASE WHEN value < 20 THEN 404 WHEN value < 30 THEN 429 ELSE 200 END AS status, concat('b', event_id % 500) AS blob, event_id % 500 * 10 AS size, ts AS fetched_at
        FROM {events}""",
    "call": """
        SELECT event_id AS id, event_type AS task, concat('m', user_id % 3) AS model, concat('j', user_id % 5) AS job, ts AS called_at,
            event_id % 2000 AS input_tokens, event_id % 700 AS cached_tokens, event_id % 300 AS output_tokens,
            CASE WHEN value < 15 THEN 'error' WHEN value < 50 THEN 'cached' ELSE 'ok' END AS status, CAST(round(value * 1000) AS BIGINT) AS micros
        FROM {events}""",
    "photo": """
        SELECT vec_id AS photo, vec_id % 100 AS owner, embedding AS v FROM {embeddings}""",
    "facet": """
        SELECT p_partkey AS listing, p_partkey % 700 AS villa, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS platform, p_partkey % 5 = 0 AS multi_platform,
            CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(round(p_retailprice * 10000) AS BIGINT) END AS total, CAST(1 + p_partkey % 4 AS INT) AS nights, nullif(p_size % 6, 0) AS bedrooms,
            CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 12 END AS max_capacity, p_type AS property_type, p_partkey % 3 = 0 AS instant,
            CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1 + p_partkey % 41 / CAST(10 AS DOUBLE) END AS rating, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey * 7 % 5000 / CAST(1 AS DOUBLE) END AS coast_low_m
        FROM {part}""",
    "spot": """
        SELECT c_custkey AS id, 36 + (c_custkey * 7919 % 1000) / CAST(1000 AS DOUBLE) AS lat, 51 + (c_custkey * 104729 % 1000) / CAST(1000 AS DOUBLE) AS lon,
            CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 9 * 100 AS INT) END AS radius FROM {customer}""",
    "place": """
        SELECT concat('k', s_suppkey % 4) AS kind, s_name AS name, 36 + (s_suppkey * 6007 % 1000) / CAST(1000 AS DOUBLE) AS lat, 51 + (s_suppkey * 7001 % 1000) / CAST(1000 AS DOUBLE) AS lon FROM {supplier}""",
    "gold": """
        SELECT p_partkey AS id, (p_partkey * 37 % 2000) / CAST(256 AS DOUBLE) - 3 AS score, p_partkey % 9 <> 0 AS blocked, concat('s', p_partkey % 4) AS stratum, CAST(100 * (1 + p_partkey % 4) AS BIGINT) AS size,
            CASE WHEN p_partkey % 10 = 3 THEN 'unsure' WHEN (p_partkey * 37 % 2000 + p_partkey * 13 % 900) > 1500 THEN 'match' ELSE 'non_match' END AS label
        FROM {part}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a view over one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{t: frame(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


def with_views(*names: str, recursive: bool = False) -> str:
    """The views as leading CTEs for an oracle."""
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)


def as_text(sql: str, *columns: str) -> str:
    """An oracle with some columns as text."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}) FROM ({sql})" if columns else sql
