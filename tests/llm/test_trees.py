"""Cover trees (operator 11) and vantage-point clustering (operator 13) against brute force."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tallyho.llm import catalog, cover_tree, vantage_clusters

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=420, dims=64, seed=5):
    """(vec_id, embedding, label): loose clusters, copies, ties, other lengths and rows that take no part."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(7)]
    rows = []
    for i in range(n):
        m = middles[i % 7]
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in m], rng.randrange(4)))
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(40)]  # a group of copies
    rows += [(1100 + i, rows[4][1], i % 3) for i in range(6)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.5] * 3, 1), (2003, [0.25] * 3, 2), (2100, [0.125] * 3, 1), (2004, [NAN] + [0.1] * 63, 1),
             (2005, [INF] + [0.1] * 63, 1), (2006, [None] + [0.1] * 63, 1), (2007, [0.1] * 64, None), (None, [0.1] * 64, 1),
             (2008, [0.0] * 64, 1), (2200, [0.0] * 64, 1), (2300, [1e30] + [0.0] * 63, 2), (7, rows[7][1], rows[7][2])]
    return rows


def embeddings(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("id", "cls", "cell", "dim", "vec", "score", "part", "rank", "`a.b`", "wanted"):
            df = df.selectExpr("*", f"'clash' as {name}")
    return df


def whole(values, scale, most):
    return [max(-most, min(most, math.floor(x * scale))) for x in values]


def plain_negatives(rows):
    seen = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (lab, len(v), np.array(whole(v, 256, cover_tree.limit(len(v))), "<i4").tobytes())
        if i not in seen or key < seen[i][0]:
            seen[i] = (key, whole(v, 256, cover_tree.limit(len(v))), lab)
    out = []
    for a, (_, va, la) in seen.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, (_, v, lab) in seen.items()
                        if i != a and len(v) == len(va))
        for p, pid in [(-s, i) for s, i, lab in scored if lab == la][:5]:
            hard = [(i, -s) for s, i, lab in scored if lab != la and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(a, pid, r + 1, i, p, s) for r, (i, s) in enumerate(hard)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_equal_brute_force(spark):
    rows = vectors()
    out = cover_tree.mine(embeddings(spark, rows), catalog.F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, out.select(*COLUMNS).collect())) == plain_negatives(rows)


def test_negatives_over_cells_and_parts(spark, monkeypatch):
    """Small cells: several centres and parts, and lengths with and without centres."""
    monkeypatch.setattr(cover_tree, "CELL_ROWS", 16)
    rows = vectors(seed=9)
    out = cover_tree.mine(embeddings(spark, rows, extra=False), catalog.F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, out.select(*COLUMNS).collect())) == plain_negatives(rows)


def test_different_rows_of_one_id(spark):
    rows = vectors(120)
    rows += [(5, rows[60][1], 0), (5, rows[61][1], 3), (100, rows[3][1], 2), (100, rows[3][1], 2)]
    out = cover_tree.mine(embeddings(spark, rows), catalog.F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, out.select(*COLUMNS).collect())) == plain_negatives(rows)


@pytest.mark.parametrize("rows", [[], [(100, [0.5] * 4, 1), (101, [0.5] * 4, 2), (200, None, 1)]])
def test_no_negatives(spark, rows):
    out = cover_tree.mine(embeddings(spark, rows), catalog.F.col("vec_id") % 100 == 0)
    assert out.columns == COLUMNS and out.collect() == []


def test_cover_tree_bounds_and_skips():
    rng = np.random.default_rng(3)
    middles = rng.integers(-4000, 4000, (40, 16))
    x = (np.repeat(middles, 50, axis=0) + rng.integers(-60, 60, (2000, 16))).astype(np.int64)
    tree = cover_tree.build(x)
    points = cover_tree.lifted(x, tree.squared_norm)

    def members(node):
        own = [tree.centre[node], *tree.rows[node]]
        for kid in tree.kids[node]:
            own += members(kid)
        return own

    assert sorted(set(members(0))) == list(range(2000))
    for node in range(len(tree.centre)):
        far = np.linalg.norm(points[members(node)] - points[tree.centre[node]], axis=1).max()
        assert far <= tree.radius[node] + 1e-6
        centres = [tree.centre[k] for k in tree.kids[node]]
        assert not centres or centres[0] == tree.centre[node]
    label, name = rng.integers(0, 3, 2000), rng.permutation(2000)
    q = x[::40]
    ip = q @ x.T
    for same in (True, False):
        for lo, hi in ((-(1 << 62), 1 << 62), (int(ip.max() * 0.2), int(ip.max() * 0.5)), (10**15, 10**16)):
            search = cover_tree.Search(q, label[::40], np.full(50, lo), np.full(50, hi), same)
            s, row, score, measured = cover_tree.descend(tree, x, label, name, search, 7)
            got = {i: [] for i in range(50)}
            for i, r, v in zip(s, row, score, strict=True):
                got[i].append((-v, name[r]))
            for i in range(50):
                ok = (ip[i] >= lo) & (ip[i] <= hi) & ((label == label[40 * i]) == same)
                assert got[i] == sorted((-ip[i, r], name[r]) for r in np.flatnonzero(ok))[:7]
            assert measured < 0.35 * ip.size


def test_large_products_are_exact():
    q = np.array([[1 << 27, (1 << 27) - 1]], np.int64)
    assert cover_tree.products(q, q).tolist() == [[(1 << 54) + ((1 << 27) - 1) ** 2]]


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, whole(v, 1024, 1 << 27)) for i, v, _ in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda s: hashlib.sha256(s.encode()).hexdigest()
    begin = sorted((mark(f"3:{i}"), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    centres = [v for _, _, v in begin[:k]]
    if not centres:
        return []
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    top = (1 << 63) - 1
    total = sum(d for *_, d in out)
    return sorted(((i, c, d, min(top, sum(e for _, b, e in out if b == c)), min(top, total),
                    mark(",".join(map(str, centres[c])))) for i, c, d in out), key=str)


def test_clusters_equal_brute_force(spark):
    rows = vectors(150)
    out = vantage_clusters.cluster(embeddings(spark, rows)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(map(tuple, out.collect()), key=str) == plain_clusters(rows)


@pytest.mark.parametrize("rows", [[], [(None, [0.5] * 64, 0), (1, None, 0)],
                                  [(1, [0.5] * 64, 0), (1, [0.5] * 64, 0), (2, [0.25] * 64, 0), (3, [-0.3] * 64, None)]])
def test_few_vectors(spark, rows):
    out = vantage_clusters.cluster(embeddings(spark, rows))
    assert sorted(map(tuple, out.collect()), key=str) == plain_clusters(rows)


def test_search_in_the_tree_is_exact_and_skips():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (300, 8)).astype(np.int64)
    centres[200:] = centres[:100]  # ties go to the smaller number
    x = np.concatenate([centres[rng.integers(0, 300, 500)] + rng.integers(-20, 20, (500, 8)), centres])
    at, best, measured = vantage_clusters.nearest(x, centres, vantage_clusters.build(centres))
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (at == d.argmin(axis=1)).all()
    assert measured < 0.5 * d.size


@pytest.mark.parametrize("name", ["op11_cover_tree", "op13_vantage_clusters"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(catalog.LLM_ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, catalog.LLM_QUERIES[name](spark, sf).select(*columns).collect())) == sorted(want.fetchall())
