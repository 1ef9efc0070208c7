import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyho.llm import _hilbert, hash_forest, pivot_index

from .helpers import union_find

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec string, size string"


def vectors():
    """Clusters, copies, scaled copies, and vectors that take no part."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal((120, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    for i in range(60):  # cosines around the threshold
        v = base[i % 6] + rng.standard_normal(16) * (0.1 + 0.02 * (i % 10))
        rows.append((1000 + i, v.astype(np.float32).tolist()))
    rows += [(2000 + 50 * i, rows[3][1]) for i in range(9)] + [(2051 + i, rows[4][1]) for i in range(3)]
    rows += [(3000, [2 * x for x in rows[5][1]]), (3001, None), (3002, []), (3003, [0.0] * 16), (3004, [math.nan] + [1.0] * 15),
             (3050, [math.inf] + [1.0] * 15), (3006, [None] + [1.0] * 15), (3007, [1.0, 2.0]), (3100, [2.0, 4.0]),
             (None, rows[7][1]), (3008, rows[8][1]), (3008, rows[8][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) if len(a) == len(b) else -9.0


def test_many_vector_lengths(spark):
    """300 lengths, of which most take no pivots from the sample; links stay within a length."""
    rng = np.random.default_rng(12)
    rows = []
    for dim in range(2, 302):
        v = rng.standard_normal(dim)
        rows += [(3 * dim, v.astype(np.float32).tolist()), (3 * dim + 1, (v + 0.02 * rng.standard_normal(dim)).astype(np.float32).tolist()),
                 (3 * dim + 2, rng.standard_normal(dim).astype(np.float32).tolist())]
    got = {r.vec_id: r for r in pivot_index.near_duplicates(frame(spark, rows)).collect()}
    assert len(got) == 900
    found = pairs = 0
    for dim in range(2, 302):
        own = rows[3 * (dim - 2):3 * (dim - 1)]
        for a, (i, v) in enumerate(own):
            partners = [j for b, (j, w) in enumerate(own) if b != a and cosine(v, w) >= 0.95]
            pairs += len(partners)
            found += got[i].n_links
            assert got[i].n_links <= len(partners) and got[i].component_id in (i, *partners)
    assert pairs >= 600 and found >= 0.99 * pairs


def test_recall_does_not_fall_with_the_number_of_pivots():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + math.sqrt(1 - 0.951**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    for rows in (1000, 100_000, 10**9):
        pivots = pivot_index.random_pivots(64, pivot_index.pivot_count(rows))
        a, b = (pivot_index.nearest_pivots(v, pivots, pivot_index.NEAREST) for v in (x, y))
        shared = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
        assert (shared >= pivot_index.SHARED).mean() >= 0.99


@pytest.mark.parametrize("cell", [512, 3])
def test_pivot_index_matches_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(pivot_index, "CELL_ROWS", cell)
    rows = vectors()
    out = pivot_index.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    used = [(i, v) for i, v in rows if i is not None and good(v)]
    pairs = [(a, b) for x, (a, v) in enumerate(used) for b, w in used[:x] if cosine(v, w) >= 0.95]
    find = union_find(pairs + [(i, i) for i, _ in rows if i is not None])
    got = {r.vec_id: r for r in out if r.vec_id is not None}
    for i, v in rows:
        if i is None:
            continue
        want = sum(i in p for p in pairs) if i != 3008 else None
        if want is not None:
            assert got[i].n_links == want, i
        assert got[i].component_id == find(i) and got[i].kept == (find(i) == i)
    null = next(r for r in out if r.vec_id is None)
    assert (null.n_links, null.component_id, null.kept) == (0, None, True)


def test_pivot_index_of_nothing(spark):
    df = frame(spark, [])
    assert pivot_index.near_duplicates(df).count() == 0
    only = pivot_index.near_duplicates(frame(spark, [(5, None), (6, [0.0])])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in only] == [(5, 0, 5, True), (6, 0, 6, True)]


def test_forest_matches_brute_force(spark):
    rows = vectors()
    out = hash_forest.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    used = sorted({(i, tuple(v)) for i, v in rows if i is not None and good(v)})
    hit = total = 0
    for q, v in used:
        if q % 50:
            assert not [r for r in out if r.query_id == q]
            continue
        want = sorted(((-cosine(v, w), i) for i, w in used if i != q and len(w) == len(v)))[:5]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, len(want) + 1))
        assert q not in [r.vec_id for r in got]
        keys = [(-round(r.score, 12), r.vec_id) for r in got]
        assert keys == sorted(keys)
        by = dict(used)
        assert all(abs(r.score - cosine(v, by[r.vec_id])) < 1e-12 for r in got)
        hit += len({i for _, i in want} & {r.vec_id for r in got})
        total += len(want)
    assert hit / total >= 0.95
    copies = sorted((r for r in out if r.query_id == 2000), key=lambda r: r.rank)
    assert [r.vec_id for r in copies] == [3, 2050, 2100, 2150, 2200]


def test_forest_recall_without_any_near_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    out = hash_forest.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    near = x[::50] @ x.T
    near[np.arange(60), np.arange(0, 3000, 50)] = -9
    best = np.argsort(-near, axis=1)[:, :5]
    hit = sum(r.vec_id in best[r.query_id // 50] for r in out)
    assert hit / 300 >= 0.9 and len(out) == 300


def test_forest_keeps_what_descending_found(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 1, 48))
    x = (base + 0.1 * rng.standard_normal((60, 6, 48))).reshape(-1, 48)  # groups of six at cosine 0.99, nothing else in range
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    out = hash_forest.search(frame(spark, rows), F.lit(True)).collect()
    got = {q: set() for q in range(360)}
    for r in out:
        got[r.query_id].add(r.vec_id)
    assert all(len(g) == 5 for g in got.values())
    assert sum(g == set(range(q // 6 * 6, q // 6 * 6 + 6)) - {q} for q, g in got.items()) >= 358


def test_forest_of_nothing(spark):
    assert hash_forest.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert hash_forest.search(frame(spark, [(50, [1.0, 2.0])]), F.col("vec_id") % 50 == 0).count() == 0


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        index = _hilbert.hilbert_index(grid, bits).astype(np.int64)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
