"""Structured Streaming over event tables: windows, dedupe, newest wins, stream-static joins, a frontier."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with event time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    one_file = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    source = stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, one_file) else stream.parquet(one_file)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def replay(stream: DataFrame, mode: str = "append", schema_of: DataFrame | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote.

    The sink is a Parquet table for append mode, so results don't pass the driver; update and complete
    modes keep their rows in a memory table, for results of bounded size.
    """
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/obsmill-streams"
    at = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    name = f"stream_{uuid.uuid4().hex}"
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def windowed(stream: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type, once a window is closed."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = stream.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    agg = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_of(stream: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """One row of each key within the watermark: a frontier's enqueue."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def newest_wins(stream: DataFrame, key: str) -> DataFrame:
    """The newest row of each key so far, whatever the order of arrival (update or complete mode)."""
    others = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max(F.struct("ts", *(c for c in others if c != "ts"))).alias("m")).select(key, "m.*")


def upsert_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each micro-batch to an idempotent upsert, exactly once for each batch number."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


BASE_S, MOST_S, ATTEMPTS = 120.0, 3600.0, 5


def frontier_step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State machine of one request: pending until it is done, skipped or failed for good, with backoff.

    Files need not arrive in the order of time. The state holds what decides whatever comes later: the
    first outcome that ends the request and the first ``ATTEMPTS`` errors, as (ts, event) each.
    """
    seen, ended, at, errors = state.get if state.exists else (0, "", [], [])
    errors = list(zip(errors[::2], errors[1::2], strict=True))
    for rows in batches:
        seen += len(rows)
        when = list(zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["event"].tolist(), strict=True))
        outcomes = rows["outcome"].tolist()
        errors = sorted(errors + [w for w, o in zip(when, outcomes, strict=True) if o not in ("ok", "gone")])[:ATTEMPTS]
        ends = [(w, o) for w, o in zip(when, outcomes, strict=True) if o in ("ok", "gone")] + ([(tuple(at), ended)] if ended else [])
        if ends:
            at, ended = min(ends)
    state.update((seen, ended, list(at), [x for e in errors for x in e]))
    attempts = sum(not ended or e < tuple(at) for e in errors)
    status = "failed" if attempts >= ATTEMPTS else {"ok": "done", "gone": "skipped"}.get(ended, "pending")
    wait = min(MOST_S, BASE_S * 2 ** (attempts - 1)) if status == "pending" and attempts else 0.0
    yield pd.DataFrame({"request": [key[0]], "status": [status], "attempts": [attempts], "wait_s": [wait], "seen": [seen]})


def frontier(stream: DataFrame) -> DataFrame:
    """Outcomes (request, ts, event, outcome: ok, gone or error) to each request's state, a row of it for every batch with news.

    ``event`` orders outcomes of one time; ``seen`` counts the outcomes that a row rests on.
    """
    return stream.groupBy("request").applyInPandasWithState(
        frontier_step, "request long, status string, attempts int, wait_s double, seen long", "seen long, ended string, at array<long>, errors array<long>", "append", "NoTimeout"
    )


def latest(states: DataFrame) -> DataFrame:
    """Of a replayed frontier the last state of each request."""
    return states.groupBy("request").agg(F.max_by(F.struct("status", "attempts", "wait_s"), "seen").alias("m")).select("request", "m.*")
