"""What several operators share: Arrow text access, word and shingle hashes, scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bytes of text that the vectorised passes hold at a time; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000
#: Rows up to which a key set may be broadcast (about 64 bytes a row once hashed); above, joins shuffle.
BROADCAST_ROWS = 500_000

#: A key of more than 1 / HOT of a table's rows is hot, so there are HOT at most; what a sketch tracks to find them.
HOT, TRACKED = 256, 4096
#: Tasks that share a hot key's rows in a join.
SPREAD = 32

U64 = np.uint64
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
#: Words over this many bytes are hashed one by one.
_LONG_WORD = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- scratch tables


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or f"file://{tempfile.gettempdir()}/obsmill-shared").rstrip("/")


class Scratch:
    """Tables written to the cluster's shared folder to cut lineage.

    The folder is ``spark.checkpoint.dir`` of the session. Only in local mode, where all tasks share
    the driver's disk, a folder of our own stands in for it; a cluster without the setting is an error.
    Tables go when the driver ends or with ``drop``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/obsmill-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._remove, self.base)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._remove(df._scratch_path)

    def _remove(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:  # the session has ended; what is local can still go
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """The hint only for a key set that was counted and is within the bound; else Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# ---------------------------------------------------------------- hot keys


def hot_keys(rows: DataFrame, key: str) -> list[int]:
    """The keys (longs) of about 1 / HOT of the rows or more, by a mergeable sketch; there are at most HOT.

    Only how rows are spread depends on them, never what comes out.
    """
    found = rows.agg(F.expr(f"approx_top_k({key}, {HOT}, {TRACKED})").alias("top"), F.count(key).alias("n")).first()
    return [x["item"] for x in found["top"] or () if x["item"] is not None and x["count"] * HOT > found["n"]]


def with_groups(rows: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Each row with narrow aggregates over the rows of its key.

    Hot keys are reduced before the shuffle and their values, HOT rows at most, are broadcast; the
    others meet in windows. ``rows`` is read several times, so it should be a table.
    """
    names, hot = rows.columns, hot_keys(rows, key)
    some = F.coalesce(F.col(key).isin(hot), F.lit(False))
    out = rows.where(~some).select("*", *(a.over(W.partitionBy(key)).alias(n) for n, a in aggregates.items()))
    if hot:
        few = rows.where(some).groupBy(key).agg(*(a.alias(n) for n, a in aggregates.items()))
        out = out.unionByName(rows.where(some).join(F.broadcast(few), key).select(*names, *aggregates))
    return out


def join_split(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot: list[int] | None = None) -> DataFrame:
    """A shuffled join whose hot keys on the side of ``rows`` are dealt out to SPREAD tasks each.

    ``table``'s rows of those keys are repeated for each. how: inner, left, left_semi. ``rows`` is
    read twice, so it should be a table, or its hot keys be known.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(table, key, how)
    some = F.coalesce(F.col(key).isin(hot), F.lit(False))
    of = [f"`{f.name}`" for f in rows.schema.fields if f.dataType.typeName() not in ("array", "map")]
    dealt = rows.withColumn("__salt", F.when(some, F.pmod(F.xxhash64(*of), F.lit(SPREAD)).cast("int")).otherwise(0))
    copies = table.withColumn("__salt", F.explode(F.when(some, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


# ---------------------------------------------------------------- memory of Python workers


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; a task that ends gives what it has freed back to the system.

    A worker stays for other tasks, of later stages too, and allocators would keep a task's peak for it.
    """

    def held(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return held


# ---------------------------------------------------------------- texts in Arrow batches


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is empty, bytes that aren't UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        data, at = raw(column)
        return [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts(column: pa.Array, limit: int = 8_000_000) -> Iterator[tuple[int, list[str]]]:
    """A column's texts as strings, some MB at a time, with the row they begin at."""
    _, at = raw(column)
    for i, j in slices(at, limit):
        yield i, texts(column.slice(i, j - i))


# ---------------------------------------------------------------- hashes


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * _C2
    h = (h ^ (h >> U64(27))) * _C3
    return h ^ (h >> U64(31))


def hash_spans(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step; ``low`` has 16 spare bytes at its end."""
    view = np.ndarray((len(low) - 7,), "<u8", low.data, strides=(1,))
    h = size.astype(np.uint64) * _C1
    live, at_byte, left = None, start, size
    while len(left):
        lane = view[at_byte] & _KEEP[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ lane)
        else:
            h[live] = mix(h[live] * _C1 ^ lane)
        more = np.flatnonzero((left > 8) & (left <= _LONG_WORD if live is None else True))
        live = more if live is None else live[more]
        at_byte, left = at_byte[more] + 8, left[more] - 8
    if size.size and size.max() > _LONG_WORD:
        from xxhash import xxh3_64_intdigest

        for k in np.flatnonzero(size > _LONG_WORD):
            h[k] = U64(xxh3_64_intdigest(low[start[k] : start[k] + size[k]].tobytes()))
    return h


def spans(data: np.ndarray, at: np.ndarray, i: int, j: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of rows i..j begin and end.

    Returns the rows' bytes (A-Z lower-cased if ``fold``; 16 spare bytes follow), each word's first
    and end byte, and for each row the number of its first word (one more at the end).
    """
    lo = at[i]
    low = np.zeros(at[j] - lo + 16, np.uint8)
    if fold:
        np.take(_LOWER, data[lo : at[j]], out=low[:-16])
    else:
        low[:-16] = data[lo : at[j]]
    solid = ~_SPACE[low[:-16]]
    n = len(solid)
    cut = at[i : j + 1] - lo
    if not n:
        e = np.zeros(0, np.int64)
        return low, e, e, np.zeros(j - i + 1, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before[cut[:-1][cut[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    after[cut[(cut > 0) & (cut < n)] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return low, start, end, np.searchsorted(start, cut)


def words(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of rows i..j (see ``spans``), and the rows' first words."""
    low, start, end, first = spans(data, at, i, j)
    return hash_spans(low, start, end - start), start, end, first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words, in order; a row of 1 to k - 1 words has its whole run.

    Returns the hashes and for each row the number of its first one (one more at the end).
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(to[-1], np.uint64)
    if not len(out):
        return out, to
    at = np.arange(len(out)) - np.repeat(to[:-1], n) + np.repeat(first[:-1], n)
    size = np.repeat(np.minimum(count, k), n)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    out[:] = size.astype(np.uint64)
    for x in range(k):
        step = mix(out * _C1 + padded[at + x])
        out = step if x == 0 else np.where(size > x, step, out)
    return out, to


def distinct_by_row(tokens: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct tokens, rising, and the rows' new starts. Row i has tokens[to[i] : to[i + 1]]."""
    n = len(to) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(to))
    bits = max(1, n.bit_length())
    # one sort by row and the token's leading bits
    key = (row << U64(64 - bits)) | (tokens >> U64(bits))
    order = np.argsort(key)
    key, tokens, row = key[order], tokens[order], row[order]
    near = key[1:] == key[:-1]
    if (near & (tokens[1:] != tokens[:-1])).any():  # tokens that differ in their last bits only
        order = np.lexsort((tokens, row))
        tokens, row = tokens[order], row[order]
        near = row[1:] == row[:-1]
    keep = np.ones(len(tokens), bool)
    keep[1:] = ~(near & (tokens[1:] == tokens[:-1]))
    return tokens[keep], np.searchsorted(row[keep], np.arange(n + 1, dtype=np.uint64))


def sums_by_row(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Wrapping sums of unsigned values by row."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[to[1:]] - total[to[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def offsets_list(values: np.ndarray, to: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and row starts."""
    return pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(values))
