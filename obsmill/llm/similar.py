"""Links between similar token sets: signatures, stars, and a token-group matrix for what stars leave.

1. Signatures. Sets that may be similar share a signature. From ``EXACT`` on they come from the
   pigeonhole principle and miss nothing: two sets of Jaccard similarity t or more differ in so few
   tokens that, with tokens dealt into one part more than that by hash, one part is equal; sizes are
   grouped so that similar sets are in one group or in neighbours. Below, from MinHash bands.
2. Stars. Under each signature the sets are compared with one of them only, that which shares most
   signatures with others, so a signature with n sets gives n pairs. Verified pairs make
   components; these are the groups.
3. Token-group matrix. Where a signature still holds several groups, each group's tokens are stored
   once (the union over its sets). Queries meet groups over the rarest tokens alone (a set's first
   tokens by rising frequency, of which similar sets share one), with bounds by size and position;
   the overlap of a query with a group's union bounds that with each of its sets, and only groups
   within the bound are opened, set by set, for exact comparison.

Pairs within a group are never made, so a group of any size costs what its tokens cost.

``band_links`` is the other way, for the sets of paragraphs: the sets under a band's signature meet in
one task, which compares them in NumPy. Signatures that hold the same sets are one bucket. Buckets of
more than ``MEET`` tokens are compared by stars first; what these leave open is dealt out in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsmill.llm.common import U64, Scratch, hot_keys, join_split, mix, tidy, with_groups
from obsmill.llm.components import components

#: Least similarity for signatures by parts; below, parts are too small to tell sets apart.
EXACT = 0.9
#: Least probability that MinHash bands find a pair right at the threshold.
RECALL = 0.9998
#: What a false candidate costs against a band's row, at half the threshold's similarity.
FALSE_COST = 40
#: Tokens of a group's union that are held in one row at most.
UNION = 65_536
#: Sets of a group that a query is compared with without looking for a shared rare token first.
FEW = 4
#: Rarest tokens by which a query looks for one set of its largest group, and holders of one that it looks at.
RAREST, HOLDERS = 4, 32
#: Rarest tokens that a query looks up in another group when it tries one set there. A pair of groups that
#: this doesn't link is compared in full, so the bound is on work only.
ASKED = 8
#: Tokens of the sets that meet in one task, and of a block of a larger bucket, about.
MEET = 1 << 20
_SALT = U64(0xD6E8FEB86659FD93)


def percent(threshold: float) -> int:
    """Thresholds are whole percents, so that comparisons are exact."""
    p = round(threshold * 100)
    if not 0 < p <= 100 or abs(p - threshold * 100) > 1e-9:
        raise ValueError("a threshold is a whole number of percents")
    return p


# ---------------------------------------------------------------- signatures, in numpy


def part_signatures(sets: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """Signatures of sets of distinct tokens by parts; a set that only its equal can match has none."""
    p = percent(threshold)
    edges = [1]
    biggest = max((len(s) for s in sets), default=0)
    while edges[-1] <= biggest:
        edges.append(edges[-1] * 100 // p + 1)
    out = []
    for s in sets:
        if not len(s):
            out.append(np.zeros(0, np.uint64))
            continue
        level = int(np.searchsorted(edges, len(s), side="right")) - 1
        mixed, some = mix(s ^ _SALT), []
        for x in (level, level - 1):
            if x < 0 or (n_parts := (edges[x + 1] - 1) * (100 - p) // p + 1) == 1:
                continue
            part = (s % U64(n_parts)).astype(np.int64)
            total = np.zeros(n_parts, np.uint64)
            np.add.at(total, part, mixed)
            some.append(mix(total + mix(np.arange(n_parts, dtype=np.uint64) + U64(x << 32))))
        out.append(np.concatenate(some) if some else np.zeros(0, np.uint64))
    return out


def tune(threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows of a band: of those that reach the recall at the threshold the cheapest by rows made and false candidates."""
    found = []
    for rows in range(1, 9):
        bands = 1 if threshold == 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        found.append((bands + bands * rows / 8 + FALSE_COST * (1 - (1 - (threshold / 2) ** rows) ** bands), bands, rows))
    return min(found)[1:]


def band_signatures(tokens: np.ndarray, to: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash band signatures (sets x bands) of consecutive runs of hashed tokens, none empty."""
    state = np.arange(bands * rows, dtype=np.uint64)
    odd = mix(state + U64(77)) | U64(1)
    out = np.zeros((len(to) - 1, bands), np.uint64)
    for b in range(bands):
        h = np.full(len(to) - 1, U64(b + 1))
        for r in range(rows):
            h = mix(h * _SALT + np.minimum.reduceat(tokens * odd[b * rows + r], to[:-1]))
        out[:, b] = h
    return out


# ---------------------------------------------------------------- links


def _similar(p: int, a: str, b: str) -> str:
    """SQL: Jaccard similarity of two arrays of distinct tokens is p percent or more."""
    inter = f"size(array_intersect({a}, {b}))"
    return f"{100 + p} * {inter} >= {p} * (size({a}) + size({b}))"


def _verify(pairs: DataFrame, sets: DataFrame, p: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are similar. A set that is in many of them is dealt out."""
    pairs = scratch.save(pairs)
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = join_split(join_split(pairs, left, "a"), right, "b", hot=hot_keys(pairs, "b"))
    return both.where(_similar(p, "ta", "tb")).select("a", "b")


def _stars(shared: DataFrame, sets: DataFrame, p: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of each key's sets with one of them, their components, and each set's weight (id, w). shared: (key, id, c)."""
    # the set that shares most signatures with most others is the middle of its neighbourhood
    central = shared.groupBy("id").agg(F.sum("c").alias("w"))
    weighed = scratch.save(shared.select("key", "id").join(central, "id"))
    stars = with_groups(weighed, "key", lead=F.max_by("id", F.struct("w", "id"))).where("id <> lead").select(F.greatest("id", "lead").alias("a"), F.least("id", "lead").alias("b"))
    stars = scratch.save(_verify(stars.distinct(), sets, p, scratch))
    return stars, scratch.save(components(stars, scratch)), central


def links(signatures: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: float, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect all sets that links connect; every edge is a verified link.

    signatures: (key, id), read several times. fetch: from (id) to (id, tokens: distinct 64-bit
    hashes) for those ids.
    """
    p = percent(threshold)
    ends = with_groups(signatures, "key", lo=F.min("id"), hi=F.max("id"), c=F.count("*")).where("lo <> hi")
    shared = scratch.save(ends.select("key", "id", "c"))
    sets = scratch.save(fetch(shared.select("id").distinct()))
    stars, groups, central = _stars(shared, sets, p, scratch)
    grouped = scratch.save(shared.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("g")))
    open_ids = with_groups(grouped, "key", lo=F.min("g"), hi=F.max("g")).where("lo <> hi").select("id", "g").distinct()
    rest = scratch.save(sets.join(open_ids, "id").select("id", "g", "tokens"))
    centres = open_ids.join(central, "id").groupBy(F.col("g").alias("other")).agg(F.max_by("id", F.struct("w", "id")).alias("b"))
    return stars.unionByName(_across_groups(rest, sets, centres, p, scratch))


def _across_groups(rest: DataFrame, sets: DataFrame, centres: DataFrame, p: int, scratch: Scratch) -> DataFrame:
    """Links between sets of different groups. rest: (id, g, tokens); centres: (other, b), a group's most central set."""
    tokens = rest.select("id", "g", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = join_split(tokens, often, "token")
    by_id = W.partitionBy("id")
    nth = F.row_number().over(by_id.orderBy("df", "token"))
    ranked = known.select("token", "id", "g", "n", nth.alias("nth"), (F.col("n") - F.count("*").over(by_id) + nth - 1).alias("at"))
    # of n tokens in one order, the first n - ceil(t n) + 1 hold one that a similar set shares
    prefix = scratch.save(ranked.where(f"at < n - cast(ceil({p} * n / 100.0D) as int) + 1"))

    matrix = prefix.select("token", "g", "n", "at").distinct()
    within = f"""100 * least(x.n, y.n) >= {p} * greatest(x.n, y.n)
        AND {100 + p} * (1 + least(x.n - x.at - 1, y.n - y.at - 1)) >= {p} * (x.n + y.n)"""
    near = matrix.alias("x").join(matrix.alias("y"), F.expr(f"x.token = y.token AND x.g < y.g AND {within}")).select(F.col("x.g").alias("ga"), F.col("y.g").alias("gb")).distinct()
    # the sets of the smaller group ask the other one
    sizes = scratch.save(rest.groupBy("g").agg(F.count("*").alias("c")))
    near = scratch.save(near)
    near = join_split(join_split(near, sizes.toDF("ga", "ca"), "ga"), sizes.toDF("gb", "cb"), "gb", hot=hot_keys(near, "gb")).select(F.expr("if(ca <= cb, ga, gb)").alias("g"), F.expr("if(ca <= cb, gb, ga)").alias("other"))
    asked = scratch.save(join_split(rest.select("id", "g"), near, "g").select("id", "other"))
    wanted = asked.select(F.col("other").alias("g")).distinct()
    union = join_split(tokens.select("g", "token"), wanted, "g", "left_semi", hot=hot_keys(rest, "g")).distinct()
    # a union of more tokens than a row should hold doesn't bound; its group is opened
    held = scratch.save(union)
    fits = held.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") <= UNION)
    unions = join_split(held, fits, "g", "left_semi").groupBy(F.col("g").alias("other")).agg(F.collect_list("token").alias("union"))
    asking = asked.join(rest.select("id", "tokens"), "id")
    bound = join_split(asking, unions, "other", "left", hot=hot_keys(asked, "other"))
    opened = scratch.save(bound.where(f"union IS NULL OR 100 * size(array_intersect(tokens, union)) >= {p} * size(tokens)").select("id", "other"))
    opened = scratch.save(join_split(opened, sizes.toDF("other", "c"), "other"))

    def pairs_of(some: DataFrame) -> DataFrame:
        # the few sets of a small group are all compared; of a large one those that share a rare token
        few = some.where(F.col("c") <= FEW).join(rest.select(F.col("g").alias("other"), F.col("id").alias("b")), "other").select(F.col("id").alias("a"), "b")
        many = some.where(F.col("c") > FEW).alias("o").join(prefix.alias("x"), F.expr("o.id = x.id")).join(prefix.alias("y"), F.expr(f"x.token = y.token AND o.other = y.g AND {within}")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        return few.union(many).distinct()

    held_by = prefix.groupBy("token", F.col("g").alias("other")).agg(F.count("*").alias("k"), F.min("id").alias("stand"))
    of = rest.select("id", "g")

    def tried(some: DataFrame) -> DataFrame:
        # two sets of the group: the most central one, and of those that hold the query's rarest tokens
        # there (of a token that many hold one stands for all) the one that shares most of them
        some = scratch.save(some)
        told = some.join(prefix.where(F.col("nth") <= ASKED).select("id", "token"), "id").join(held_by, ["token", "other"])
        told = scratch.save(told.withColumn("r", F.row_number().over(W.partitionBy("id", "other").orderBy("k", "token"))).where(F.col("r") <= RAREST))
        each = told.where(F.col("k") <= HOLDERS).select(F.col("id").alias("a"), "other", "token").join(prefix.select("token", F.col("g").alias("other"), F.col("id").alias("b")), ["token", "other"])
        shared = each.select("a", "other", "b").unionAll(told.where(F.col("k") > HOLDERS).select("id", "other", "stand"))
        best = shared.groupBy("a", "other", "b").agg(F.count("*").alias("n")).groupBy("a", "other").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
        middle = join_split(some, centres, "other").select(F.col("id").alias("a"), "b")
        return scratch.save(_verify(best.select("a", "b").union(middle).distinct(), sets, p, scratch))

    def apart(found: DataFrame) -> DataFrame:
        joined = found.join(of.toDF("a", "ga"), "a").join(of.toDF("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
        merged = scratch.save(components(joined, scratch))
        left = opened.join(of, "id").join(merged.toDF("g", "mg"), "g", "left").join(merged.toDF("other", "mo"), "other", "left")
        return left.where("coalesce(mg, g) <> coalesce(mo, other)").select("id", "other", "c")

    # each query tries its largest group first, then each that is still apart; most groups are linked by
    # then, and what isn't is compared in full
    largest = opened.groupBy("id").agg(F.max_by(F.struct("other", "c"), F.struct("c", "other")).alias("m")).select("id", "m.other", "m.c")
    found = tried(largest)
    found = found.unionByName(tried(apart(found)))
    return found.unionByName(_verify(pairs_of(apart(found)), sets, p, scratch))


# ---------------------------------------------------------------- links of sets that meet in a task


def bucket_links(tokens: np.ndarray, to: np.ndarray, p: int) -> list[tuple[int, int]]:
    """Links (numbers of sets) that connect all sets which links connect. Set i has tokens[to[i] : to[i + 1]], distinct."""
    size = np.diff(to)
    n = len(size)
    if n == 2:
        both = len(np.intersect1d(tokens[: to[1]], tokens[to[1] :], assume_unique=True))
        return [(0, 1)] if (100 + p) * both >= p * len(tokens) else []
    _, token, often = np.unique(tokens, return_inverse=True, return_counts=True)
    group, mark, found = np.arange(n), np.zeros(len(often), np.int32), []

    def compare(x: int, others: np.ndarray) -> None:
        others = others[(group[others] != group[x]) & (100 * np.minimum(size[others], size[x]) >= p * np.maximum(size[others], size[x]))]
        if not len(others):
            return
        own, ends = token[to[x] : to[x + 1]], np.cumsum(size[others])
        at = np.arange(ends[-1]) + np.repeat(to[others] - ends + size[others], size[others])
        mark[own] = 1
        both = np.add.reduceat(mark[token[at]], ends - size[others])
        mark[own] = 0
        like = others[(100 + p) * both.astype(np.int64) >= p * (size[others] + size[x])]
        if len(like):
            names, first = np.unique(group[like], return_index=True)
            found.extend((x, int(y)) for y in like[first])
            group[np.isin(group, names)] = group[x]

    # a star around the set of the commonest tokens; the others ask by their rarest tokens, of which similar sets share one
    lead = int((np.add.reduceat(often[token], to[:-1]) / size).argmax())
    compare(lead, np.arange(n))
    rest = group != group[lead]
    if not rest.any():
        return found
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    row = np.repeat(np.arange(n), size)
    order = np.lexsort((rank[token], row))
    asks = np.arange(len(token)) - np.repeat(to[:-1], size) < np.repeat(size - -(-p * size // 100) + 1, size)
    asks &= often[token[order]] > 1
    word, holder = rank[token[order][asks]], row[asks]
    begin = np.searchsorted(holder, np.arange(n + 1))
    by_word = np.argsort(word, kind="stable")
    held, sets = word[by_word], holder[by_word]
    low, high = np.searchsorted(held, word), np.searchsorted(held, word, side="right")
    for x in np.flatnonzero(rest).tolist():
        if a := [sets[low[k] : high[k]] for k in range(begin[x], begin[x + 1])]:
            others = np.unique(np.concatenate(a))
            compare(x, others[(others > x) | ~rest[others]])
    return found


def _meet(p: int):
    """From rows (bucket, id, tokens), by bucket, to links (a, b)."""

    def links_of(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        if sum(map(len, rows)) < 2:
            return []
        ids = np.concatenate([np.asarray(r.column(1)) for r in rows])
        flat = [np.asarray(r.column(2).flatten()) for r in rows]
        size = np.concatenate([np.diff(np.asarray(r.column(2).offsets)) for r in rows])
        found = bucket_links(np.concatenate(flat), np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), p)
        return [(int(ids[x]), int(ids[y])) for x, y in found]

    def run(batches):
        rows, of = [], None
        for batch in batches:
            bucket, out = np.asarray(batch.column(0)), []
            cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i == j:
                    continue
                if of != bucket[i]:
                    out += links_of(rows)
                    rows, of = [], bucket[i]
                rows.append(batch.slice(i, j - i))
            yield _pairs(out)
        yield _pairs(links_of(rows))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def band_links(signatures: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: float, scratch: Scratch, meet: int = MEET) -> DataFrame:
    """As ``links``, of all sets that share a signature. signatures: (key, id, n: the set's size), read several times."""
    p = percent(threshold)
    h = F.xxhash64("id")
    ends = with_groups(signatures, "key", lo=F.min("id"), hi=F.max("id"), c=F.count("*"), w=F.sum("n"), s=F.sum(F.shiftrightunsigned(h, 32)), t=F.sum(h.bitwiseAND(0xFFFFFFFF))).where("lo <> hi")
    # a bucket is named by its members, so signatures that hold the same sets are one
    shared = scratch.save(ends.select(F.xxhash64("s", "t").alias("key"), "id", "n", "c", "w").distinct())
    sets = scratch.save(fetch(shared.select("id").distinct()))
    met = shared.where(F.col("w") <= meet).select("key", "id")
    large = shared.where(F.col("w") > meet)
    stars = None
    if not large.isEmpty():
        large = scratch.save(large)
        stars, groups, _ = _stars(large, sets, p, scratch)
        met = met.unionByName(_blocks(large, groups, meet, scratch))
    rows = met.join(sets, "id").select("key", "id", "tokens").repartition("key").sortWithinPartitions("key")
    found = scratch.save(rows.mapInArrow(tidy(_meet(p)), "a long, b long"))
    return found if stars is None else found.unionByName(stars)


def _blocks(large: DataFrame, groups: DataFrame, meet: int, scratch: Scratch) -> DataFrame:
    """Buckets (key, id) in which all sets of a large bucket meet that are in different groups.

    The sets outside a bucket's largest group, in blocks, meet one another and that group's blocks.
    """
    grouped = scratch.save(large.join(groups, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("g")))
    each = grouped.groupBy("key", "g").agg(F.sum("n").alias("w")).groupBy("key").agg(F.max_by("g", F.struct("w", "g")).alias("main"), F.max("w").alias("most"), F.sum("w").alias("w"), F.count("*").alias("c")).where("c > 1")
    count = lambda c: F.ceil(c / F.lit(meet)).cast("int")
    dealt = join_split(grouped, each.select("key", "main", count(F.col("most")).alias("p"), count(F.col("w") - F.col("most")).alias("q")), "key")
    dealt = dealt.withColumn("inside", F.col("g") == F.col("main")).withColumn("k", F.pmod(F.xxhash64("id"), F.expr("if(inside, p, q)")).cast("int"))
    to_main = F.expr("if(inside, transform(sequence(0, q - 1), x -> struct(0 AS kind, k AS i, x AS j)), transform(sequence(0, p - 1), x -> struct(0 AS kind, x AS i, k AS j)))")
    to_rest = F.expr("if(inside OR q = 1, array(), transform(sequence(0, q - 1), x -> struct(1 AS kind, least(k, x) AS i, greatest(k, x) AS j)))")
    return dealt.select("key", "id", F.explode(F.concat(to_main, to_rest)).alias("m")).select(F.xxhash64("key", "m.kind", "m.i", "m.j").alias("key"), "id")
