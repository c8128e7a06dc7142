"""Substring dedup against brute force, and what its parts promise."""

from __future__ import annotations

import random
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from obsmill.llm import common, similar, substring_dedup

SCHEMA = "doc_id long, text string, c0 string, marks string, doc string, __id string, __spans string"
LONG = "long " * 40_000 + "x" * 3_000


def table(spark, rows):
    """Extra columns with names that the operator uses inside."""
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA)


def words(text):
    return text.lower().split()


def gone_words(text, spans):
    """Numbers of the words inside spans."""
    out, at = set(), 0
    for k, w in enumerate(text.split()):
        at = text.index(w, at)
        if any(a <= at and at + len(w) <= z for a, z in spans):
            out.add(k)
        at += len(w)
    return out


def brute(texts):
    """By document the words of common runs of 50 words or more with a smaller one, and those that may go at most."""
    must, may = {}, {}
    lines = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in texts.items()}
    shingles = lambda x: {tuple(words(x)[k : k + 5]) for k in range(max(1, len(words(x)) - 4))}
    for i, t in texts.items():
        w = words(t)
        must[i], may[i] = set(), set()
        for j, other in texts.items():
            v = words(other)
            runs = np.zeros((len(w) + 1, len(v) + 1), int)
            for a in range(len(w) - 1, -1, -1):
                for b in range(len(v) - 1, -1, -1):
                    runs[a, b] = runs[a + 1, b + 1] + 1 if w[a] == v[b] else 0
            if j < i:
                for a in range(len(w)):
                    n = int(runs[a].max())
                    must[i] |= set(range(a, a + n)) if n >= 50 else set()
                    may[i] |= set(range(a, a + n)) if n >= substring_dedup.SIZE else set()
            if j != i:
                at = 0
                for _, x in lines[i]:
                    s = shingles(x)
                    if any(100 * len(s & shingles(y)) >= 80 * len(s | shingles(y)) for _, y in lines[j]):
                        may[i] |= set(range(at, at + len(words(x))))
                    at += len(words(x))
    return must, may


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 70, 120)]
    texts = {}
    for i in range(16):
        part = [*fresh(rng.randrange(5, 40)), *(rng.choice(shared) if rng.random() < 0.8 else []), *fresh(rng.randrange(5, 40))]
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] += "\n"
        texts[i + 1] = " ".join(part)
    line = fresh(60)
    near = [*line[:30], "changed", *line[31:]]
    texts |= {30: "a\n" + " ".join(line), 31: " ".join(near) + "\nb c", 32: " ".join(fresh(80))}
    must, may = brute(texts)
    got = substring_dedup.repeated_spans(table(spark, texts.items())).collect()
    for i, t in texts.items():
        removed = gone_words(t, [(r["start"], r["end"]) for r in got if r["doc_id"] == i and r["removed"]])
        assert must[i] <= removed <= may[i], i
    assert not any(r["doc_id"] == 32 for r in got)
    assert {(r["doc_id"], r["removed"], r["by"]) for r in got if r["doc_id"] in (30, 31)} == {(30, False, "paragraph"), (31, True, "paragraph")}
    assert all(r["component_id"] <= r["doc_id"] for r in got)


def test_runs_end_where_the_passage_does(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"é{rng.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(n) for n in range(50, 80, 3)]
    rows = [(100 * d + k, " ".join([*fresh(40), *s, *fresh(40)])) for d in range(3) for k, s in enumerate(shared)]
    got = substring_dedup.repeated_spans(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["by"] == "passage" for r in got)
    for r in got:
        assert dict(rows)[r["doc_id"]][r["start"] : r["end"]].split() == shared[r["doc_id"] % 100]
        assert r["component_id"] == r["doc_id"] % 100 and r["removed"] == (r["doc_id"] >= 100)


def test_short_lines_count_only_together(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    some = [fresh(12) for _ in range(5)]
    rows = [(1, "\n".join([fresh(20), *some[:1], fresh(20)])), (2, "\n".join([fresh(9), *some])), (3, "\n".join([*some, fresh(9)])), (4, "\n".join([some[0], fresh(30), some[1]]))]
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(table(spark, rows)).collect()}
    assert [left[k] for k in (1, 2, 4)] == [rows[0][1], rows[1][1], rows[3][1]]
    assert left[3].split() == rows[2][1].split()[60:]


def test_edges(spark):
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    p, q, tail, head = fresh(60), fresh(60), fresh(30), fresh(30)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, p), (6, f"{p} {tail}"), (7, f"{head} {p}"), (7, q), (8, q), (9, LONG), (9, LONG), (None, p), (10, LONG + " " + p)]
    got = substring_dedup.remove_repeats(table(spark, rows))
    assert got.columns == table(spark, []).columns
    left = sorted(((r["doc_id"] or 0, r["text"]) for r in got.collect()), key=str)
    # each row of id 7 loses what is its own, the second one nothing, as its text is first there
    want = [(0, p), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, p), (6, f" {tail}"), (7, f"{head} "), (7, q), (9, LONG), (9, LONG)]
    assert [x for x in left if x[0] not in (10,)] == sorted(want, key=str)
    assert p not in dict(left)[10] if 10 in dict(left) else True
    assert substring_dedup.repeated_spans(table(spark, [])).count() == 0 and substring_dedup.remove_repeats(table(spark, [])).count() == 0


def test_hot_keys_are_the_same_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), "id")
    assert common.hot_keys(rows, "k") == [7]
    got = {r["id"]: (r["n"], r["least"]) for r in common.with_groups(rows, "k", n=F.count("k"), least=F.min("id")).collect()}
    want = rows.groupBy("k").agg(F.count("k").alias("n"), F.min("id").alias("least")).withColumnRenamed("k", "j")
    assert got == {r["id"]: (r["n"], r["least"]) for r in rows.join(want, F.expr("k <=> j")).collect()}
    other = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi"):
        plain = rows.join(other.union(spark.createDataFrame([(7, 5)], "k long, v long")), "k", how)
        split = common.join_split(rows, other.union(spark.createDataFrame([(7, 5)], "k long, v long")), "k", how)
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)


def test_bands_are_tuned():
    for percent in (30, 50, 60, 80, 90):
        bands, rows = similar.tune(percent / 100)
        assert 1 - (1 - (percent / 100) ** rows) ** bands >= similar.RECALL
    assert similar.tune(0.8) == (12, 3)


def test_distinct_tokens_by_row():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 9, 400)
    to = np.concatenate([[0], np.cumsum(sizes)])
    tokens = rng.integers(0, 6, to[-1]).astype(np.uint64) + np.uint64(5 << 50) * rng.integers(0, 3, to[-1]).astype(np.uint64)
    got, at = common.distinct_by_row(tokens, to)
    for k, (a, b) in enumerate(pairwise(to)):
        assert got[at[k] : at[k + 1]].tolist() == sorted(set(tokens[a:b].tolist()))
    assert common.sums_by_row(got, at).tolist() == [sum(got[a:b].tolist()) % 2**64 for a, b in pairwise(at)]


def test_paragraph_places():
    b = pa.record_batch([pa.array([5, 6, 7]), pa.array(["a b\n\nc\n", None, "d e f"])], ["doc", "text"])
    found = [(ids.to_pylist(), column.to_pylist()) for ids, column in substring_dedup.paragraphs(b)]
    assert [(x["doc"], x["start"], x["end"]) for x in found[0][0]] == [(5, 0, 2), (5, 2, 3), (7, 0, 3)] and [t.strip() for t in found[0][1]] == ["a b", "c", "d e f"]


def test_sets_that_meet_in_a_task_are_linked_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [np.arange(k * 1000, k * 1000 + 40) for k in range(3)]
    sets = [np.union1d(b[rng.random(40) > rng.random() * 0.25], rng.choice(10**9, 3)) for b in base for _ in range(25)]
    want = [(x, y) for y in range(len(sets)) for x in range(y) if 180 * len(np.intersect1d(sets[x], sets[y])) >= 80 * (len(sets[x]) + len(sets[y]))]
    up = components_of(len(sets), want)
    assert 1 < len(set(up)) < len(sets)
    found = similar.bucket_links(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 80)
    assert {tuple(sorted(x)) for x in found} <= set(want) and components_of(len(sets), found) == up

    table = spark.createDataFrame([(k, [int(t) for t in s]) for k, s in enumerate(sets)], "id long, tokens array<long>")
    keys = table.select((F.col("id") / 25).cast("long").alias("key"), "id", F.size("tokens").alias("n"))
    for meet in (similar.MEET, 200):  # as one bucket each, and by stars and blocks
        edges = similar.band_links(keys, lambda ids: table.join(ids, "id"), 0.8, common.Scratch(spark), meet).collect()
        assert components_of(len(sets), [(r["a"], r["b"]) for r in edges]) == up


def components_of(n: int, links) -> list[int]:
    up = list(range(n))
    for _ in range(n):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_what_a_text_repeats_is_one_row(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(w for k in range(30) for w in [*words, f"g{k:02}"])), (3, " ".join([*(f"x{k}" for k in range(9)), *words[:55]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = docs.mapInArrow(substring_dedup._cut, "doc_id long, sig int, key long, at array<int>").collect()
    assert len({(r["doc_id"], r["key"]) for r in pieces}) == len(pieces) and any(len(r["at"]) == 30 for r in pieces)
    marks = substring_dedup._marks(substring_dedup._source(docs, "doc_id", "text"), 0.8, 50, common.Scratch(spark)).collect()
    runs = [m for r in marks for m in r["marks"] if m["before"] is not None]
    assert any(len(m["starts"]) == 30 for m in runs) and len(runs) < 30
    found = {(r["doc_id"], r["start"], r["end"]) for r in substring_dedup.repeated_spans(docs).where("removed").collect()}
    one = len(" ".join(words))
    assert found == {(2, k * (one + 5), k * (one + 5) + one) for k in range(30)} | {(3, 27, 27 + len(" ".join(words[:55])))}
