"""Operator 13, centroid clustering with a vantage-point tree over the centroids.

Vectors are integers, so distances, sums and means are exact and every run agrees.  In each
round the driver builds a vantage-point tree over the centroids and broadcasts it.  A node holds
a centroid, the vantage point; the others are split at the median of their distances to it,
and each half keeps its nearest and farthest distance.  By the triangle inequality these bound the
distance of a vector to anything in the half.  Every vector searches best-first: it opens the node
of least bound, measures exactly what the node holds, and ends when no open bound is within its
best distance (inclusive, as an equally near centroid of a smaller number wins the tie).  All
vectors of a batch go on in step, each with open nodes of its own.

Tasks add up their vectors per cluster, so a round hands on one row of sums per cluster and task,
and the driver gets ``k`` centroids; a cluster that holds a third of all vectors is no group
anywhere.

Defined results
* Kept are the rows whose vector has exactly ``dims`` components, none null or not finite; others are
  left out.  Rows that repeat an id are vectors of their own; rows with a null id are assigned, but
  no centroid starts from them.
* A component x is floor(scale * x), held within +-2^27, so that all distances fit 64 bits.
* With fewer than k vectors that can start, there are as many centroids; equal hashes (repeated ids)
  are ordered by the vectors.  A centroid without vectors stays.  Equal distances go to the smaller number.
* Totals beyond 64 bits are held at the largest.  Other columns are not read.  Empty input, or one
  without a row that can start a centroid, gives empty output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho.session import Scratch, materialize

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Bound of a component: 64 * (2 * 2^27)^2 fits 64 bits.
LARGEST = 1 << 27
#: Centroids of a leaf, and vectors that search in step.
LEAF, BLOCK = 2, 2048
#: By how much bounds are loosened against rounding.
SLACK = 1e-9
_LONG = (1 << 63) - 1


@dataclass
class Tree:
    """Nodes by number, the root first: ``points[i]`` are the centroids measured at node i, the vantage point alone or a leaf's;
    ``kids[i]`` are (node, nearest, farthest distance of its centroids to the vantage point)."""

    points: list[np.ndarray]
    kids: list[list[tuple[int, float, float]]]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer points, (rows, points)."""
    out = np.empty((len(x), len(c)), np.int64)
    for i, point in enumerate(c):
        d = x - point
        out[:, i] = np.einsum("rd,rd->r", d, d)
    return out


def build(centroids: np.ndarray, leaf: int = LEAF) -> Tree:
    tree = Tree([], [])

    def grow(members: np.ndarray) -> int:
        node = len(tree.points)
        tree.points.append(members)
        tree.kids.append([])
        if len(members) > leaf:
            vantage, rest = members[:1], members[1:]
            d = np.sqrt(squared(centroids[rest], centroids[vantage])[:, 0].astype(np.float64))
            order = np.argsort(d, kind="stable")
            tree.points[node] = vantage
            for half in np.array_split(order, 2):
                if len(half):
                    tree.kids[node].append((grow(rest[half]), float(d[half].min()), float(d[half].max())))
        return node

    if len(centroids):
        grow(np.arange(len(centroids)))
    return tree


def nearest(x: np.ndarray, centroids: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, distances measured) of integer rows."""
    best, at = np.full(len(x), _LONG, np.int64), np.full(len(x), len(centroids), np.int64)
    bound = np.full((len(x), len(tree.points)), np.inf)
    bound[:, 0] = 0.0
    todo, measured = np.arange(len(x)), 0
    while len(todo):
        node = bound[todo].argmin(axis=1)
        low = bound[todo, node]
        go = low <= np.sqrt(best[todo].astype(np.float64)) * (1 + SLACK) + SLACK
        todo, node, low = todo[go], node[go], low[go]
        bound[todo, node] = np.inf
        for n in np.unique(node):
            own = node == n
            rows, points = todo[own], tree.points[n]
            d = squared(x[rows], centroids[points])
            measured += d.size
            for j, number in enumerate(points):
                better = (d[:, j] < best[rows]) | ((d[:, j] == best[rows]) & (number < at[rows]))
                best[rows[better]], at[rows[better]] = d[better, j], number
            if tree.kids[n]:
                far = np.sqrt(d[:, 0].astype(np.float64))
                for kid, lo, hi in tree.kids[n]:
                    gap = np.maximum(far - hi, lo - far) - SLACK * (far + hi)
                    bound[rows, kid] = np.maximum(low[own], np.maximum(gap, 0.0))
    return at, best, measured


def integers(df: DataFrame, vec_id: str, embedding: str, dims: int, scale: float) -> DataFrame:
    """(id, vec) of the kept rows; ``vec`` is the integers as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            good = np.isfinite(flat).all(axis=1)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(flat[good] * scale), -LARGEST, LARGEST).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)),
                                              pa.array([row.tobytes() for row in whole], pa.binary())], names=["id", "vec"])

    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where(F.size("v") == dims).mapInArrow(run, "id bigint, vec binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def starts(rows: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The first k vectors in the order of sha256 of ``seed:id``."""
    mark = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").orderBy(mark, "vec").limit(k).select("vec").collect()
    return np.frombuffer(b"".join(bytes(r.vec) for r in first), "<i4").reshape(-1, dims).astype(np.int64)


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of the mean of each one's vectors."""
    dims = centroids.shape[1]
    known = rows.sparkSession.sparkContext.broadcast((centroids, build(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, tree = known.value
        total, count = np.zeros((len(points), dims), object), np.zeros(len(points), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(lo, BLOCK), dims)
                at = nearest(x, points, tree)[0]
                for c in np.unique(at):
                    total[c] += x[at == c].sum(axis=0)  # 2^27 * BLOCK fits; Python integers beyond
                count += np.bincount(at, minlength=len(points))
        seen = np.flatnonzero(count)
        sums = [[Decimal(int(v)) for v in total[c]] for c in seen]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen]), pa.array(sums, pa.list_(pa.decimal128(38, 0)))],
                                         names=["c", "n", "s"])

    parts = rows.select("vec").mapInArrow(run, "c bigint, n bigint, s array<decimal(38,0)>")
    sums = parts.select("c", "n", F.posexplode("s").alias("j", "s")).groupBy("c", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # k * dims rows
        out[r.c, r.j] = int(r.s) // r.n
    known.destroy()
    return out


def cluster(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dims: int = DIMS, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.table(integers(df, vec_id, embedding, dims, scale))
        centroids = starts(rows, k, dims, seed)
        for _ in range(rounds if len(centroids) else 0):
            after = means(rows, centroids)
            if (after == centroids).all():
                break  # every further round would give the same
            centroids = after
        tree, points = build(centroids), centroids

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows if len(points) else 0, BLOCK):
                    part = batch.slice(lo, BLOCK)
                    at, best, _ = nearest(_matrix(part.column(1), dims), points, tree)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at.astype(np.int32)), pa.array(best)],
                                                     names=["vec_id", "cluster", "distance"])

        assigned = materialize(rows.select("id", "vec").mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"))
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = min(_LONG, sum(inertia.values()))
    facts = spark.createDataFrame([(c, min(_LONG, inertia.get(c, 0)), total, m) for c, m in enumerate(marks)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast
