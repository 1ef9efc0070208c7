"""Operator 9, near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest reference points (pivots), in order of
distance.  Near vectors rank the pivots alike.  The inverted lists are kept for every
choice of ``SHARED`` pivots out of a vector's nearest ones, so two vectors meet in a list
if, and only if, their shared-pivot count is ``SHARED`` at least.  What meets is verified
by cosine in double precision; a pair is counted only in the list of its smallest
shared pivots, so once.

Pivots are vectors out of a bounded sample, none near another; every vector is indexed.  Their number grows with the
square root of the vectors (``pivot_count``), so that lists do not grow in proportion to the table.  The ``LENGTHS``
vector lengths with most rows take pivots from the sample, any others seeded random directions.
Vectors that are equal are one class with its size.  A long list is
split into blocks, and each pair of blocks is a cell of bounded size.  Cells hand on
counts and a spanning forest of the links, never the pairs.

Defined results
* Every input row is returned once, also repeated rows.
* Vectors that are null, empty or zero or hold null, NaN or infinite components link with
  nothing: 0 links, their own id as component, kept.  Vectors of different dimensions do
  not link.
* Rows with a null id are returned with null component and 0 links and are kept.
* Added columns replace columns of these names.  Empty input gives empty output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyho.llm._cells import whole_groups
from tallyho.llm._components import components
from tallyho.llm._shared import shared_keys
from tallyho.llm._vectors import classes, matrix, unit, usable
from tallyho.session import Scratch, materialize

THRESHOLD = 0.95
#: Least and most pivots; they fit in 12 bits, so a list's three pivots and the dimension make one key.
PIVOTS, MOST_PIVOTS, NEAREST, SHARED = 256, 800, 8, 3
#: Rows up to which the least number of pivots serves.
PIVOT_ROWS = 10_000
#: Vectors of a length from which pivots are taken, for each pivot wanted, the most bytes of them, lengths with a sample, and
#: the greatest cosine between two pivots.
SAMPLE, SAMPLE_BYTES, LENGTHS, APART = 8, 64 << 20, 16, 0.6
CELL_ROWS = 512


def pivot_count(rows: int) -> int:
    return min(MOST_PIVOTS, max(PIVOTS, int(PIVOTS * math.sqrt(rows / PIVOT_ROWS))))


def spread(pool: np.ndarray, pivots: int) -> np.ndarray:
    """The first ``pivots`` rows of a pool, without those whose cosine with an earlier one exceeds ``APART``."""
    free, chosen = np.ones(len(pool), bool), []
    for i in range(len(pool)):
        if free[i] and len(chosen) < pivots:
            chosen.append(i)
            free &= pool @ pool[i] <= APART
    return pool[chosen]


def random_pool(dim: int, pivots: int) -> np.ndarray:
    return unit(np.random.default_rng([7, dim]).standard_normal((4 * pivots, dim)))


@lru_cache(maxsize=64)
def random_pivots(dim: int, pivots: int) -> np.ndarray:
    return spread(random_pool(dim, pivots), pivots)


def pick_pivots(vectors: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """``pivots`` unit vectors for each of the ``LENGTHS`` most frequent dimensions from distinct vectors, the first by hash.

    A vector whose cosine with an earlier pivot exceeds ``APART`` is passed over: pivots out of one
    cluster would stand at equal distance from its members, whose order of them would be noise.
    Seeded random directions fill up what the sample leaves.
    """
    dims = [r.dim for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()]
    most = F.least(F.lit(SAMPLE * pivots), F.greatest(F.lit(1), F.lit(SAMPLE_BYTES // LENGTHS // 8) / F.col("dim")))
    rank = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("vec"), "vec"))
    firsts = vectors.where(F.col("dim").isin(dims)).withColumn("r", rank).where(F.col("r") <= SAMPLE * pivots).where(F.col("r") <= most)
    sample = firsts.select("dim", "vec").toArrow()
    kinds = sample.column("dim").to_numpy()
    out = {}
    for dim in dims:
        own = sample.column("vec").combine_chunks().take(pa.array(np.flatnonzero(kinds == dim)))
        out[dim] = spread(np.concatenate([unit(matrix(own, dim)), random_pool(dim, pivots)]), pivots)
    return out


def nearest_pivots(units: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Indices of each row's nearest pivots, nearest first."""
    near = units @ pivots.T
    keep = min(nearest, len(pivots))
    part = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
    order = np.argsort(-np.take_along_axis(near, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def list_keys(near: np.ndarray, dim: int, shared: int) -> np.ndarray:
    """Keys of the inverted lists of each row: every choice of ``shared`` of its pivots, ascending, and the dimension."""
    ranked = np.sort(near, axis=1).astype(np.int64)
    keys = []
    for chosen in combinations(range(near.shape[1]), min(shared, near.shape[1])):
        key = np.full(len(near), dim, np.int64)
        for c in chosen:
            key = (key << 12) | ranked[:, c]
        keys.append(key)
    return np.stack(keys, axis=1)


def cell_links(x: np.ndarray, near: np.ndarray, side: np.ndarray, size: np.ndarray, last: int, shared: int,
               threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked size of each row, forest edges as row pairs) of one cell of the list whose greatest pivot is ``last``."""
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if side.any() else one
    below = np.zeros((len(x), last + 1), np.float32)  # pivots below the list's greatest
    rows, cols = np.nonzero(near < last)
    below[rows, near[rows, cols]] = 1
    linked = x[one] @ x[two].T >= threshold
    counted = linked & (below[one] @ below[two].T == min(shared, near.shape[1]) - 1)
    total = np.zeros(len(x), np.int64)
    if two is one:
        np.fill_diagonal(linked, False)
        np.fill_diagonal(counted, False)
        total[one] = counted @ size[one]
    else:
        total[one] = counted @ size[two]
        total[two] = size[one] @ counted
    label, edges = np.arange(len(x)), []
    todo = np.flatnonzero(linked.any(axis=1))
    while len(todo):  # each row of one side takes the smallest label it sees; rows that agree already go
        grown = []
        for r in todo:
            partners = two[linked[r]]
            other = np.unique(label[partners], return_index=True)[1]
            joined = [p for p in partners[other] if label[p] != label[one[r]]]
            for p in joined:
                edges.append((one[r], p))
                label[label == label[p]] = label[one[r]]
            grown.append(bool(joined))
        todo = todo[np.array(grown, bool)]
    return total, np.array(edges, np.int64).reshape(-1, 2)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
                    pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; without ``pivots`` their number follows that of the vectors."""
    if pivots is not None and not 0 < pivots <= 4096:
        raise ValueError("pivots must be 1 to 4096")
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.table(usable(df, vec_id, embedding))
        distinct = scratch.table(classes(rows))
        wanted = pivots or pivot_count(distinct.count())
        known = spark.sparkContext.broadcast(pick_pivots(distinct, wanted))

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(1).to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    own = known.value[int(dim)] if int(dim) in known.value else random_pivots(int(dim), wanted)
                    near = nearest_pivots(unit(matrix(part.column(2), int(dim))), own, nearest)
                    keys = list_keys(near, int(dim), shared)
                    as_list = lambda a: pa.ListArray.from_arrays(
                        pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), as_list(near.astype(np.int32)), as_list(keys)], names=["id", "near", "keys"])

        described = scratch.table(distinct.select("id", "dim", "vec").mapInArrow(
            describe, "id bigint, near array<int>, keys array<bigint>"))
        active = scratch.table(shared_keys(described.select("id", F.explode("keys").alias("key"))))
        count = active.groupBy("key").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        cells = (active.join(count, "key").withColumn("own", own)
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
                 .withColumn("side", (F.col("own") > F.col("lo")).cast("int")).drop("own", "other", "blocks"))
        member = distinct.join(described.select("id", "near"), "id")
        cells = (cells.join(member, "id").select("key", "lo", "hi", "side", "id", "dim", "vec", "size", "near")
                 .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi"))

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, edges in whole_groups(batches, 3):
                key, lo, hi, side, ident, dims, size = (table.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 5, 7))
                found: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    part = slice(a, b)
                    if lo[a] < hi[a] and not (side[part].any() and (side[part] == 0).any()):
                        continue  # one of the two blocks is empty
                    x = unit(matrix(table.column(6).slice(a, b - a), int(dims[a])))
                    near = np.array(table.column(8).slice(a, b - a).to_pylist())
                    total, pairs = cell_links(x, near, side[part], size[part], int(key[a] & 4095), shared, threshold)
                    some = np.flatnonzero(total)
                    found.append(np.stack([ident[part][some], ident[part][some], total[some]]))
                    found.append(np.stack([ident[part][pairs[:, 0]], ident[part][pairs[:, 1]], np.zeros(len(pairs), np.int64)]))
                flat = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat], names=["u", "v", "links"])

        links = scratch.table(cells.mapInArrow(link, "u bigint, v bigint, links bigint"))
        totals = links.groupBy("u").agg(F.sum("links").alias("links")).where("links > 0")
        same = rows.join(distinct.select("dim", "vec", F.col("id").alias("rep"), "size"), ["dim", "vec"]).select(
            "id", "rep", "size")
        same = scratch.table(same)
        edges = links.where("u <> v").select("u", "v").unionByName(
            same.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")))
        comp = components(edges, scratch)
        found = (same.groupBy("id").agg(F.min("rep").alias("rep"), F.max("size").alias("size"))
                 .join(totals.select(F.col("u").alias("rep"), "links"), "rep", "left")
                 .select("id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
                 .join(comp, "id", "left"))
        out = (df.select(F.col(vec_id).cast("long").alias("vec_id")).join(found, F.col("vec_id") == F.col("id"), "left")
               .withColumn("component_id", F.coalesce("component", "vec_id"))
               .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                       F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")))
        return materialize(out)
