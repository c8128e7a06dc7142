"""What the vector operators share: which vectors count, and Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, all components finite numbers, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a double matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each length that occurs, and their matrix."""
    sizes = np.asarray(pa.compute.list_value_length(column))
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, matrix(column if len(rows) == len(column) else column.take(pa.array(rows)))


def common_lengths(vectors: DataFrame, vector_col: str, most: int) -> dict[int, int]:
    """The commonest lengths, at most ``most`` of them, and their numbers of rows."""
    found = vectors.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").limit(most).collect()
    return {r["d"]: r["count"] for r in found}


#: Bytes of a sample at most.
SAMPLE_BYTES = 64_000_000


def sample_rows(vectors: DataFrame, id_col: str, vector_col: str, n: int, dim: int) -> np.ndarray:
    """At most n vectors of length dim, and at most SAMPLE_BYTES, those of the least hashed ids, to fit a model on."""
    n = max(1, min(n, SAMPLE_BYTES // (8 * dim)))
    rows = vectors.select(F.xxhash64(id_col).alias("h"), F.col(vector_col).alias("v")).orderBy("h", "v").limit(n).collect()
    return np.array([r["v"] for r in rows], np.float64) if rows else np.zeros((0, 0))
