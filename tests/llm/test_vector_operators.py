"""Vector operators against brute force."""

from __future__ import annotations

import numpy as np

from obsmill.llm import ann, cover_tree

SCHEMA = "vec_id long, embedding array<float>, label int, p long, cell int"


def table(spark, ids, x, labels):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], l, 0, 0) for i, v, l in zip(ids, x, labels, strict=True)], SCHEMA)


def clustered(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, dim)) * rng.choice([0, 0.02, 0.1, 0.3], n - n // 2)[:, None]
    x[-20:] = x[0]
    return x.astype(np.float32), rng.integers(0, 3, n)


def odd(dim):
    return [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [float("inf")] * dim, [], [1.0, 2.0]]


def test_blocks_against_brute_force():
    x, _ = clustered(3, 500)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = set(zip(*np.nonzero(np.triu(u @ u.T >= 0.98, 1)), strict=True))
    assert set(zip(*cover_tree.link_blocks(x.astype(float), None, 0.98), strict=True)) == want
    i, j = cover_tree.link_blocks(x[:200].astype(float), x[200:].astype(float), 0.98)
    assert set(zip(i, j + 200, strict=True)) == {(a, b) for a, b in want if a < 200 <= b}


def test_tree_levels_cover():
    x, _ = clustered(4, 400)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]

    def check(node):
        d = np.linalg.norm(u[node.points] - node.centre, axis=1)
        assert d.max() <= node.radius + 1e-6
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            for c in node.children:
                assert c.radius < max(node.radius, 1e-12)
                check(c)

    check(cover_tree.build(u, np.arange(len(u))))


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    x, labels = clustered(5)
    ids = list(range(1000, 1000 + len(x)))
    extra = odd(x.shape[1])
    rows = ids + list(range(len(extra))) + [50, ids[3]]
    vecs = list(x) + extra + [x[0], x[3]]
    labs = [int(v) for v in labels] + [0] * len(extra) + [None, int(labels[3])]
    got = cover_tree.near_duplicates(table(spark, rows, vecs, labs)).collect()
    assert len(got) == len(rows)
    y = x.astype(float)
    u = y / np.linalg.norm(y, axis=1)[:, None]
    all_u, all_l, all_i = np.vstack([u, u[3:4]]), np.append(labels, labels[3]), [*ids, ids[3]]
    near = (all_u @ all_u.T >= 0.98) & (all_l[:, None] == all_l[None])
    np.fill_diagonal(near, False)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near), strict=True):
            m = min(comp[all_i[a]], comp[all_i[b]])
            if comp[all_i[a]] != m or comp[all_i[b]] != m:
                comp[all_i[a]] = comp[all_i[b]] = m
                changed = True
    links = dict(zip(all_i[:-1], near.sum(1)[:-1], strict=True))
    for r in got:
        i = r["vec_id"]
        want = (links[i], comp[i]) if i in comp else (0, i)
        assert (r["n_links"], r["component_id"], r["kept"]) == (*want, i == want[1]), i


def test_near_duplicates_of_nothing(spark):
    assert cover_tree.near_duplicates(table(spark, [], [], [])).count() == 0
    got = cover_tree.near_duplicates(table(spark, [1], [None], [1])).first()
    assert (got["n_links"], got["component_id"], got["kept"]) == (0, 1, True)


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(2)
    hit = total = 0
    for _ in range(60):
        x = rng.normal(size=(600, 64))
        q = rng.normal(size=64)
        d = ((x - q) ** 2).sum(1)
        found = set(ann.scan(q, ann.Columns(x), 10, stride=50).tolist())
        hit += len(found & set(np.argsort(d)[:10].tolist()))
        total += 10
    assert hit >= 0.99 * total
    same = np.zeros((50, 8))
    assert len(ann.scan(np.zeros(8), ann.Columns(same), 10)) == 50


def test_search_recall_and_form(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 100)
    monkeypatch.setattr(ann, "QUERIES", 16)
    x, _ = clustered(6, 900, 24)
    ids = np.arange(900) * 5
    rows = [*ids.tolist(), *range(1, 1 + len(odd(24))), None]
    vecs = [*x, *odd(24), x[1]]
    df = table(spark, rows, vecs, [0] * len(rows))
    got = ann.search(df, df.where("vec_id % 100 = 0"))
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], []).append(r)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        y = x.astype(float)
        d = np.sqrt(((y - y[q // 5]) ** 2).sum(1))
        want = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        assert all(abs(r["score"] - d[r["vec_id"] // 5]) < 1e-12 for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(want))
        total += 10
    assert hit >= 0.9 * total


def test_far_clusters_meet_only_themselves(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    rng = np.random.default_rng(9)
    centre = np.linalg.qr(rng.normal(size=(16, 16)))[0][:8]
    x = np.repeat(centre, 80, 0) + rng.normal(size=(640, 16)) * 0.002
    made = []
    keep = cover_tree.Scratch.save
    monkeypatch.setattr(cover_tree.Scratch, "save", lambda self, df: (out := keep(self, df), made.append(out))[0])
    got = cover_tree.near_duplicates(table(spark, list(range(640)), x, [1] * 640)).collect()
    assert {(r["component_id"], r["n_links"]) for r in got} == {(80 * k, 79) for k in range(8)}
    pairs = next(df for df in made if {"a", "b", "dim"} <= set(df.columns))
    assert pairs.count() <= 8 * 6  # of two or three blocks of each cluster, not all pairs of sixteen or more


def test_every_length_is_compared(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "LENGTHS", 1)
    monkeypatch.setattr(ann, "LENGTHS", 1)
    vecs = [[1.0, 0, 0], [1.0, 0.0001, 0], [0, 1.0, 0], [1.0, 0], [1.0, 0.0001], [0, 1.0], [2.0, 0, 0, 0], [3.0, 0, 0, 0]]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(table(spark, range(8), vecs, [1] * 8)).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6)}
    df = table(spark, range(8), vecs, [1] * 8)
    near = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(df, df).collect()}
    assert near == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 1, (2, 2): 0, (3, 1): 4, (3, 2): 5, (4, 1): 3, (4, 2): 5, (5, 1): 4, (5, 2): 3, (6, 1): 7, (7, 1): 6}


def test_ties_at_the_last_rank(spark):
    x = [[1.0, 0.0], *([2.0, 0.0] for _ in range(30))]
    df = table(spark, [100, *range(31, 1, -1)], x, [0] * 31)
    got = ann.search(df, df.where("vec_id % 100 = 0"), k=10).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(2, 12))


def test_very_long_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 5_000))
    x[3] = x[0] * 2 + 1e-6
    got = {r["vec_id"]: r["component_id"] for r in cover_tree.near_duplicates(table(spark, range(6), x, [1] * 6)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 5}
    df = table(spark, range(6), x, [1] * 6)
    want = min((np.linalg.norm(x[0].astype(np.float32) - x[k].astype(np.float32)), k) for k in range(1, 6))[1]
    assert ann.search(df, df.where("vec_id = 0"), k=1).first()["vec_id"] == want


def test_search_in_small_tables(spark):
    df = table(spark, [100, 1, 2], [[1.0, 0.0], [0.0, 1.0], [1.0, 0.1]], [0, 0, 0])
    got = ann.search(df, df.where("vec_id % 100 = 0")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(100, 1, 2), (100, 2, 1)]
    empty = table(spark, [], [], [])
    assert ann.search(empty, empty).count() == 0
