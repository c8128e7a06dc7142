"""Approximate nearest neighbours: inverted lists scanned with adaptive dimension tests.

Centres are fitted by k-means on a bounded sample, every vector goes to the list of its nearest
centre, and a query probes the lists of its nearest centres; how many is found on the sample, where
brute force is cheap, as the fewest that reach the wanted recall. Lists grow with the square root of
the table. Within a list all vectors are rotated by one random orthogonal matrix, so that the leading
columns are a fair sample of a distance, and held in blocks of columns, scanned one after another: a
candidate whose partial distance is, by a hypothesis test, too large for the k-th best found so far is
abandoned. Candidates come some at a time, and the k-th best tightens with each. What is left is ranked
by exact distance on the original vectors in double precision, ties by the smaller id.

Lists are cut into chunks, and a list's queries into blocks, of bounded size; each meeting of both is
one task. A list that no query probes isn't moved.

A query's candidates are the vectors of its length. Lengths other than the commonest, and very great
ones, are one list each, scanned whole. A query probes more lists where those hold fewer than k others. Vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows without an id. A repeated row is a candidate of its own; a query's own id never is. Other
columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsmill.llm.common import Scratch, checked_broadcast
from obsmill.llm.vectors import by_length, common_lengths, matrix, sample_rows, usable

SAMPLE, SEED = 8192, 7
#: Lists of a length: the square root of its vectors, from and to.
LISTS = (16, 1024)
#: Lengths that are cut into lists, and the greatest that is (a rotation has the square of it).
LENGTHS, LONGEST = 4, 2048
#: Columns in a block; the test's slack (larger: fewer wrong abandonments).
COLUMNS, SLACK = 16, 2.1
#: Candidates that a scan takes at a time.
STRIDE = 1024
#: Vectors in a chunk of a list, queries in a block.
CHUNK, QUERIES = 8192, 2048
#: Recall wanted on the sample; above what is asked for, as the sample is smaller than the table.
RECALL = 0.97


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fit(sample: np.ndarray, k: int, lists: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """Centres, rotation, and how many lists to probe for k neighbours."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(12):
        own = _square(sample, centres).argmin(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = sample[own == c].mean(0)
    own = _square(sample, centres).argmin(1)
    asked = sample[: min(256, len(sample))]
    near = np.argsort(_square(asked, sample), axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(_square(asked, centres), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centres))[None].repeat(len(asked), 0), 1)
    needed = np.take_along_axis(rank, own[near], 1)
    share = [(needed < n).mean() for n in range(1, len(centres) + 1)]
    return centres, rotation, next(n for n, s in enumerate(share, 1) if s >= RECALL)


class Columns:
    """Rotated vectors in blocks of columns."""

    def __init__(self, x: np.ndarray, columns: int = COLUMNS):
        self.ends = list(range(columns, x.shape[1], columns)) + [x.shape[1]]
        self.blocks = [np.ascontiguousarray(x[:, a:b]) for a, b in zip([0, *self.ends], self.ends, strict=False)]
        self.n, self.dim = x.shape


def scan(query: np.ndarray, rows: Columns, k: int, slack: float = SLACK, stride: int = STRIDE) -> np.ndarray:
    """Rows that may be among the k nearest to a rotated query; ties of the k-th stay."""
    kept, parts, best = np.zeros(0, np.int64), np.zeros(0), np.inf
    at, step = 0, 4 * k + 64
    while at < rows.n:
        alive, part, begin = np.arange(at, min(rows.n, at + step)), np.zeros(min(rows.n, at + step) - at), 0
        for end, block in zip(rows.ends, rows.blocks, strict=True):
            part = part + ((block[alive] - query[begin:end]) ** 2).sum(1)
            begin = end
            if np.isfinite(best):
                limit = best * (end / rows.dim) * (1 + slack / np.sqrt(end)) ** 2 if end < rows.dim else best
                stay = part <= limit * (1 + 1e-9) + 1e-12
                alive, part = alive[stay], part[stay]
        kept, parts = np.concatenate([kept, alive]), np.concatenate([parts, part])
        if len(parts) >= k:
            best = np.partition(parts, k - 1)[k - 1]
            stay = parts <= best * (1 + 1e-9) + 1e-12
            kept, parts = kept[stay], parts[stay]
        at, step = at + step, stride
    return kept


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """Per query and rank: query_id, rank, id_col, score (distance)."""
    scratch = scratch or Scratch(vectors.sparkSession)
    take = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    base, asked = take(vectors), take(queries)
    models, first = {}, 0
    for dim, n in common_lengths(base.where(F.size("v") <= LONGEST), "v", LENGTHS).items():
        lists = int(min(LISTS[1], max(LISTS[0], n**0.5)))
        models[dim] = (*fit(sample_rows(base.where(F.size("v") == dim), "id", "v", SAMPLE, dim), k, lists), first)
        first += lists

    def assign(sizes: np.ndarray | None = None):
        def run(batches):
            for b in batches:
                for rows, x in by_length(b.column(1)):
                    # a length without lists is one, named by it
                    row, near = rows, np.full(len(rows), -x.shape[1])
                    if model := models.get(x.shape[1]):
                        centres, _, probes, begin = model
                        order = begin + np.argsort(_square(x, centres), axis=1, kind="stable")
                        use = np.arange(order.shape[1])[None] < (1 if sizes is None else probes)
                        if sizes is not None:  # and as many as hold enough candidates
                            held = np.cumsum(sizes[order], axis=1) - sizes[order]
                            use = use | (held < k + most)
                        row, near = rows[np.nonzero(np.broadcast_to(use, order.shape))[0]], order[np.broadcast_to(use, order.shape)]
                    row = pa.array(row)
                    yield pa.record_batch([b.column(0).take(row), b.column(1).take(row), pa.array(near.astype(np.int32))], ["id", "v", "list"])

        return run

    listed = scratch.save(base.mapInArrow(assign(), "id long, v array<double>, list int"))
    sizes = np.zeros(first, np.int64)
    for r in listed.where("list >= 0").groupBy("list").count().collect():  # LENGTHS * LISTS[1] rows at most
        sizes[r["list"]] = r["count"]
    # rows of one id, which its own query leaves out
    most = listed.groupBy("id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    probed = scratch.save(asked.mapInArrow(assign(sizes), "id long, v array<double>, list int"))
    # of each list that is probed how many chunks and blocks it has; without rare lengths LENGTHS * LISTS[1] rows at most
    parts = lambda rows, size, name: rows.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    layout = scratch.save(parts(listed, CHUNK, "chunks").join(parts(probed, QUERIES, "blocks"), "list"))
    layout = checked_broadcast(layout, layout.count())
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = listed.join(layout, "list").select("id", "v", "list", deal("chunks", 1).alias("chunk"), every("blocks").alias("block"))
    right = probed.join(layout, "list").select("id", "v", "list", every("chunks").alias("chunk"), deal("blocks", 2).alias("block"))

    def meet(rows: pa.Table, questions: pa.Table) -> pa.Table:
        out = [[], [], []]
        if rows.num_rows and questions.num_rows:
            x, ids = matrix(rows.column("v").combine_chunks()), rows.column("id").to_numpy()
            q, of = matrix(questions.column("v").combine_chunks()), questions.column("id").to_numpy()
            rotation = models[x.shape[1]][1] if x.shape[1] in models else np.eye(x.shape[1])
            rotated, turned = Columns(x @ rotation), q @ rotation
            for n in range(len(q)):
                own = np.flatnonzero(ids == of[n])
                found = scan(turned[n], rotated, k + len(own))
                found = found[ids[found] != of[n]]
                d = np.sqrt(((x[found] - q[n]) ** 2).sum(1))
                first = np.lexsort((ids[found], d))[:k]
                out[0].append(np.full(len(first), of[n]))
                out[1].append(ids[found][first])
                out[2].append(d[first])
        a, b, c = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"q": pa.array(a.astype(np.int64)), "id": pa.array(b.astype(np.int64)), "d": pa.array(c.astype(np.float64))})

    keys = ["list", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "q long, id long, d double")
    ranked = found.select("q", "id", "d", F.row_number().over(W.partitionBy("q").orderBy("d", "id")).alias("rank")).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), F.col("d").alias("score"))
