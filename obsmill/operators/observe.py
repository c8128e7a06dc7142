"""Append-only observations: newest wins, guarded upserts, replaced partitions, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by the order, which should be total."""
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rn = 1").drop("__rn")


def latest_by(df: DataFrame, keys: Sequence[str], at: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Newest row of each key as a map-side combined aggregate; of equal times the least tie wins.

    For hot keys: rows of a key never meet in one task before they are reduced.
    """
    picked = F.max_by(F.struct(*columns), F.struct(F.col(at), -F.col(tie)))
    return df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, "__row.*")


def upsert_newest(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], at: str, tie: Sequence[Column]) -> DataFrame:
    """Stored rows with newer or equally old incoming ones in their place, and new keys."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return latest(both, keys, [F.col(at).desc(), F.col("__new").desc(), *tie]).drop("__new")


def append_new(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key isn't stored, once each."""
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def replace_where(stored: DataFrame, rows: DataFrame, column: str, value) -> DataFrame:
    """Rows of one value of a column replaced by others."""
    return stored.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(rows)


def gaps(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Seconds since the previous row of the key."""
    before = F.lag(at).over(W.partitionBy(*keys).orderBy(at))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return df.withColumn("gap", (micros(F.col(at)) - micros(before)) / 1_000_000)


def host_traffic(df: DataFrame, run: str, host: str, at: str, blob: str, size: str, limit_s: float = 600.0) -> DataFrame:
    """Responses, stored bytes of distinct blobs, first, last, least and median gap under the limit, by host."""
    gapped = gaps(df, [run, host], at)
    close = F.when(F.col("gap") < limit_s, F.col("gap"))
    seen = gapped.groupBy(host).agg(F.count("*").alias("responses"), F.min(at).alias("first"), F.max(at).alias("last"), F.min(close).alias("min_gap"), F.percentile(close, 0.5).alias("median_gap"))
    stored = df.groupBy(host, blob).agg(F.max(size).alias("s")).groupBy(host).agg(F.sum("s").alias("stored"))
    return seen.join(stored, host)


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], bad: Column) -> DataFrame:
    """Runs of consecutive bad rows: first, last and length, by key (gaps and islands)."""
    spec = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__bad", bad).withColumn("__good", F.sum(F.when(F.col("__bad"), 0).otherwise(1)).over(spec))
    return marked.where("__bad").groupBy(*keys, "__good").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length")).drop("__good")


def frontier_due(frontier: DataFrame, now: Column, stale_after: str = "INTERVAL 10 MINUTES") -> DataFrame:
    """Items to fetch next, in order: pending ones that are due, and claims that went stale."""
    ready = (F.col("status") == "pending") & (F.col("next_attempt_at") <= now)
    stale = (F.col("status") == "in_progress") & (F.col("claimed_at") < now - F.expr(stale_after))
    return frontier.where(ready | stale).orderBy("next_attempt_at", "id")


def frontier_after(status: Column, attempts: Column, ok: Column, permanent: Column, most: int = 5) -> Column:
    """An item's status after an attempt."""
    return F.when(ok, "done").when(permanent, "skipped").when(attempts >= most, "failed").otherwise("pending")
