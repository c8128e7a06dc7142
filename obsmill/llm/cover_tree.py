"""Embedding near-dedup: all pairs within a label at a cosine bound, by dual traversal of cover trees.

Vectors are compared on the unit sphere, where a cosine bound is a distance bound. Equal vectors of
a label are one point with a weight. Points go to the cell of their nearest centre (centres lie far
apart in a bounded sample; each length has its own), and each cell of a label has a covering radius.
The points of a label's cells, in order, are cut into blocks of bounded size. Pairs of blocks of which
some cells' centres are nearer than both radii and the bound are joined, each by one task: it builds a
cover tree for each side (nested levels, radii halving) and goes down both at once, dropping pairs of
nodes farther apart than their covering radii and the bound allow; the cosines of what is left decide.
Tasks return counts and a spanning forest of the links, never the pairs themselves.

Vectors of one length are compared with each other. Those that are null, empty, zero or hold null or
non-finite components link with nothing, nor do those without a label; they keep their row with no
links. Repeated rows are equal vectors. A null id keeps its row; it counts as a link but names no
component that has another id. Other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsmill.llm.common import Scratch
from obsmill.llm.components import components
from obsmill.llm.vectors import by_length, common_lengths, matrix, sample_rows, usable

#: Points in a block; cells for a block's worth of points, and cells and sample rows at most.
BLOCK, CELLS, CENTRES, SAMPLE = 2048, 4, 256, 4096
#: Lengths with centres of their own; the vectors of rarer lengths are one cell each.
LENGTHS = 4
#: Nodes of at most this radius aren't cut further.
LEAF = 0.125
_BATCH = 256
_ROUND = 1e-9


@dataclass
class Node:
    """Points of a tree within ``radius`` of a centre; ``radius`` is their true reach."""

    centre: np.ndarray
    points: np.ndarray
    radius: float
    children: list[Node]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def build(x: np.ndarray, points: np.ndarray, radius: float = 2.0) -> Node:
    """The tree over rows ``points`` of unit vectors, around the first of them."""
    centre = x[points[0]]
    node = Node(centre, points, float(_distances(centre[None], x[points]).max()), [])
    if len(points) == 1 or node.radius <= LEAF:
        return node
    radius = radius / 2
    while radius >= node.radius:  # levels that would hold this node alone
        radius /= 2
    left = points
    while len(left):
        some = left[:_BATCH]
        d = _distances(x[some], x[left])
        chosen: list[int] = []
        owner = np.full(len(left), -1)
        for k in range(len(some)):
            if owner[k] < 0:
                owner[(owner < 0) & (d[k] <= radius)] = k
                chosen.append(k)
        for k in chosen:
            own = left[owner == k]
            node.children.append(build(x, own, radius) if len(own) > 1 else Node(x[own[0]], own, 0.0, []))
        left = left[owner < 0]
    return node


def dual(a: Node, b: Node, bound: float):
    """Pairs of point sets that may hold pairs within ``bound``."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not a.children and not b.children:
            yield a.points, b.points
            continue
        left, right = a.children or [a], b.children or [b]
        cr, rr = np.stack([n.centre for n in right]), np.array([n.radius for n in right])
        singles_r = np.array([not n.children and len(n.points) == 1 for n in right])
        for at in range(0, len(left), _BATCH):
            part = left[at : at + _BATCH]
            d = _distances(np.stack([n.centre for n in part]), cr)
            near = d <= np.array([n.radius for n in part])[:, None] + rr[None] + bound + _ROUND
            for i, j in zip(*np.nonzero(near), strict=True):
                if singles_r[j] and not part[i].children:
                    yield part[i].points, right[j].points
                else:
                    todo.append((part[i], right[j]))


def link_blocks(xa: np.ndarray, xb: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows (i of a, j of b), or i < j of a alone; vectors as they are, in double precision."""
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    ua = unit(xa)
    ub = ua if xb is None else unit(xb)
    ta = build(ua, np.arange(len(ua)))
    tb = ta if xb is None else build(ub, np.arange(len(ub)))
    other = xa if xb is None else xb
    out = [np.zeros((2, 0), np.int64)]
    bound = math.sqrt(max(0.0, 2 - 2 * cosine)) + _ROUND
    for pa_, pb in dual(ta, tb, bound):
        i, j = np.nonzero((xa[pa_] @ other[pb].T) / np.outer(np.linalg.norm(xa[pa_], axis=1), np.linalg.norm(other[pb], axis=1)) >= cosine)
        i, j = pa_[i], pb[j]
        out.append(np.stack([i, j])[:, i < j] if xb is None else np.stack([i, j]))
    i, j = np.concatenate(out, axis=1)
    return i, j


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """At most n of the unit vectors, each the farthest from those before it, in an order in which neighbours follow one another.

    Each hangs on the nearest one before it; the order goes down that tree.
    """
    chosen, children = [0], [[]]
    near, owner = _distances(x[:1], x)[0], np.zeros(len(x), np.int64)
    while len(chosen) < min(n, len(x)) and near.max() > _ROUND:
        at = int(near.argmax())
        children[owner[at]].append(len(chosen))
        d = _distances(x[at : at + 1], x)[0]
        owner[d < near] = len(chosen)
        near = np.minimum(near, d)
        chosen.append(at)
        children.append([])
    order, todo = [], [0]
    while todo:
        k = todo.pop()
        order.append(chosen[k])
        todo += children[k]
    return x[order]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links between ids: each id and the least of its part."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in up]


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scratch: Scratch | None = None) -> DataFrame:
    """Per row: id_col, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = rows.where(usable(F.col("v")) & F.col("label").isNotNull())
    # equal vectors are one point; its number is a hash of label and vector
    point = F.xxhash64("label", F.size("v"), "v")
    points = scratch.save(good.groupBy(point.alias("p")).agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("m"), F.min("id").alias("id")))

    centres: dict[int, np.ndarray] = {}
    for dim, n in common_lengths(points, "v", LENGTHS).items():
        sample = sample_rows(points.where(F.size("v") == dim), "p", "v", SAMPLE, dim)
        centres[dim] = far_apart(sample / np.linalg.norm(sample, axis=1)[:, None], min(CENTRES, -(-CELLS * n // BLOCK)))

    def place(batches):
        for b in batches:
            cell, far = np.zeros(len(b), np.int32), np.full(len(b), 2.0)
            for rows, x in by_length(b.column(3)):
                if (c := centres.get(x.shape[1])) is not None:
                    d = _distances(x / np.linalg.norm(x, axis=1)[:, None], c)
                    cell[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
            yield pa.record_batch([*b.columns, pa.array(cell), pa.array(far)], ["p", "label", "m", "v", "cell", "far"])

    label_type = points.schema["label"].dataType.simpleString()
    placed = points.select("p", "label", "m", "v").mapInArrow(place, f"p long, label {label_type}, m long, v array<double>, cell int, far double")
    placed = scratch.save(placed.select("p", "label", "m", "v", "cell", "far", F.size("v").alias("dim")))
    # the cells of a label, in order, share blocks or take several
    key = ["label", "dim"]
    cells = scratch.save(placed.groupBy(*key, "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")))
    before = F.sum("n").over(W.partitionBy(*key).orderBy("cell")) - F.col("n")
    layout = cells.select(*key, "cell", before.alias("before"), "n")
    spread = F.expr(f"cast(floor((before + pmod(xxhash64(p, 7), n)) / {BLOCK}) as int)")
    blocked = scratch.save(placed.join(layout, [*key, "cell"]).select("p", *key, "m", "v", "cell", spread.alias("block")))
    # LENGTHS * CENTRES * CENTRES rows at most
    apart = [(d, i, j, float(x)) for d, c in centres.items() for i, row in enumerate(_distances(c, c)) for j, x in enumerate(row)]
    apart = F.broadcast(spark.createDataFrame(apart, "dim int, i int, j int, apart double"))
    limit = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    x, y = cells.select(*key, F.col("cell").alias("i"), F.col("radius").alias("ri")), cells.select(*key, F.col("cell").alias("j"), F.col("radius").alias("rj"))
    met = x.join(y, key).join(apart, ["dim", "i", "j"], "left").where(F.coalesce("apart", F.lit(0.0)) <= F.col("ri") + F.col("rj") + limit).select(*key, "i", "j")
    blocks = scratch.save(blocked.select(*key, "cell", "block").distinct())
    a, b = blocks.select(*key, F.col("cell").alias("i"), F.col("block").alias("a")), blocks.select(*key, F.col("cell").alias("j"), F.col("block").alias("b"))
    pairs = scratch.save(met.join(a, [*key, "i"]).join(b, [*key, "j"]).where("a <= b").select(*key, "a", "b").distinct())
    sides = pairs.select(*key, "a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).union(pairs.where("a < b").select(*key, "a", "b", F.col("b").alias("block"), F.lit(1).alias("side")))

    def join(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        some = [table.filter(pa.array(side == s)).combine_chunks() for s in (0, 1)]
        x = [matrix(t.column("v").combine_chunks()) for t in some]
        p, m = ([t.column(c).to_numpy() for t in some] for c in "pm")
        alone = not len(x[1])
        i, j = link_blocks(x[0], None if alone else x[1], cosine)
        other = 0 if alone else 1
        pi, pj = p[0][i], p[other][j]
        who, add = np.concatenate([pi, pj]), np.concatenate([m[other][j], m[0][i]])
        ids, at = np.unique(who, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, add)
        root = dict(_forest(pi, pj))
        return _result(ids, total, [root[k] for k in ids.tolist()])

    found = scratch.save(blocked.drop("cell").join(sides, [*key, "block"]).groupBy(*key, "a", "b").applyInArrow(join, "p long, n long, root long"))
    links = found.groupBy("p").agg(F.sum("n").alias("n"))
    group = components(found.select(F.col("p").alias("a"), F.col("root").alias("b")), scratch)
    named = points.select("p", "m", "id").join(links, "p", "left").join(group.withColumnRenamed("id", "p"), "p", "left").withColumn("component", F.coalesce("component", "p"))
    named = scratch.save(named)
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("p", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.select("id", F.when(usable(F.col("v")) & F.col("label").isNotNull(), point).alias("p")).join(named, "p", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _result(p, n, root) -> pa.Table:
    return pa.table({"p": pa.array(p, pa.int64()), "n": pa.array(n, pa.int64()), "root": pa.array(root, pa.int64())})
