"""Operator 10, approximate nearest neighbours by a hash-prefix forest.

In each tree a vector has a hash string of 64 bits, the signs of random projections.  A
tree is the sorted array of its strings; it is stored in cells by tree and leading bits,
and a cell with more rows than ``CELL_ROWS`` is dealt over salted parts.

A query descends in every tree to its longest-prefix matches: the ``DESCEND`` neighbours of
its string in the sorted array.  Their best cosines give the level to ascend to, the
same in all trees: a neighbour of cosine s agrees on a bit with probability
p = 1 - acos(s) / pi, so it shares the first x bits in one of L trees at least with
probability 1 - (1 - p^x)^L, and x is the greatest level at which that is 1 - ``MISS`` or more.
The query then meets every vector that shares x bits with it in some tree: a query with very
near neighbours stays in one small range a tree, one without ascends to short prefixes.
The neighbours found while descending stay candidates.  No range is cut off.  All cosines are computed on the original vectors in double
precision.

Defined results
* One row for each neighbour of each row that is a query, nearest first, ties to the
  smaller id; fewer than k where there are fewer candidates.
* Equal vectors are indexed once with their k + 1 smallest ids, so a vector of a third of
  all rows is one entry; the query's own row is never its neighbour, a copy of it is.
* Vectors that are null, empty or zero or hold null, NaN or infinite components, and rows
  with a null id, are neither queries nor candidates.  Vectors of different dimensions do
  not meet.  Rows that repeat an id and its vector count once.  Empty input gives empty output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyho.llm._cells import whole_groups
from tallyho.llm._join import attach
from tallyho.llm._vectors import matrix, unit, usable
from tallyho.session import Scratch, materialize

K, TREES, BITS, DESCEND, MISS = 5, 16, 64, 32, 0.06
SEED = 5
#: Rows of a cell's part, and most leading bits that name a cell (TREES << 16 cells at most).
CELL_ROWS, DEPTH = 4096, 16
#: Queries that meet a range at once.
BLOCK = 256


def hash_strings(units: np.ndarray, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """(rows, trees) of 64-bit strings, first bit highest."""
    out = np.empty((len(units), trees), np.uint64)
    for t in range(trees):
        planes = np.random.default_rng([seed, units.shape[1], t]).standard_normal((units.shape[1], BITS))
        out[:, t] = np.packbits(units @ planes > 0, axis=1).view(">u8").ravel()
    return out


def ascend_to(score: np.ndarray, trees: int = TREES, miss: float = MISS) -> np.ndarray:
    """Level x for the cosine of the worst neighbour found so far."""
    agree = 1 - np.arccos(np.clip(score, -1.0, 1.0)) / math.pi
    need = 1 - miss ** (1 / trees)
    with np.errstate(divide="ignore"):
        level = np.where(agree <= 0, 0, math.log(need) / np.log(np.clip(agree, 1e-9, 1 - 1e-12)))
    return np.clip(np.floor(level), 0, BITS).astype(np.int32)


def _best(query: np.ndarray, ident: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Best k rows of each query."""
    order = np.lexsort((ident, -score, query))
    q = query[order]
    start = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    keep = order[rank < k]
    return query[keep], ident[keep], score[keep]


def descend(strings: np.ndarray, x: np.ndarray, ident: np.ndarray, q_string: np.ndarray, q: np.ndarray, q_id: np.ndarray,
            k: int, reach: int = DESCEND) -> tuple[np.ndarray, ...]:
    """Best of the ``reach`` index rows around each query's place in the sorted array."""
    if not len(strings):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.clip(np.searchsorted(strings, q_string) - reach // 2, 0, max(0, len(strings) - reach))
    near = np.minimum(at[:, None] + np.arange(min(reach, len(strings))), len(strings) - 1)
    found = []
    for lo in range(0, len(q), BLOCK):
        rows = near[lo:lo + BLOCK]
        score = np.einsum("qcd,qd->qc", x[rows], q[lo:lo + BLOCK])
        found.append(_best(np.repeat(q_id[lo:lo + BLOCK], rows.shape[1]), ident[rows].ravel(), score.ravel(), k))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def ascend(strings: np.ndarray, x: np.ndarray, ident: np.ndarray, q_string: np.ndarray, q: np.ndarray, q_id: np.ndarray,
           level: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Best of all index rows that share a query's first ``level`` bits."""
    free = (BITS - level).astype(np.uint64)
    low = np.where(level == 0, np.uint64(0), np.left_shift(np.right_shift(q_string, np.minimum(free, np.uint64(63))),
                                                           np.minimum(free, np.uint64(63))))
    high = low | np.where(level == 0, ~np.uint64(0), np.left_shift(np.uint64(1), np.minimum(free, np.uint64(63))) - np.uint64(1))
    a, b = np.searchsorted(strings, low, "left"), np.searchsorted(strings, high, "right")
    found = []
    for lo, hi in np.unique(np.stack([a, b], axis=1), axis=0):
        mine = np.flatnonzero((a == lo) & (b == hi))
        if hi <= lo:
            continue
        for m in (mine[i:i + BLOCK] for i in range(0, len(mine), BLOCK)):
            score = q[m] @ x[lo:hi].T
            top = min(k, hi - lo)
            part = np.argpartition(-score, top - 1, axis=1)[:, :top]
            edge = np.take_along_axis(score, part, axis=1).min(axis=1, keepdims=True)
            r, c = np.nonzero(score >= edge)  # rows that tie with the last one stay
            found.append(_best(q_id[m][r], ident[lo:hi][c], score[r, c], k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _meet(rows: DataFrame, k: int, step: str) -> DataFrame:
    """(q, c, s): run ``descend`` or ``ascend`` in every cell part of (cell, part, id, dim, string, level, vec) rows.

    Index rows have level -1.  Rows are sorted by string inside a part.
    """
    rows = (rows.select("cell", "part", "dim", "id", "string", "level", "vec").repartition("cell", "part", "dim")
            .sortWithinPartitions("cell", "part", "dim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, 3):
            dims, ident, strings, level = (table.column(i).to_numpy() for i in range(2, 6))
            found = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                lv = level[a:b]
                if lv.max() < 0 or lv.min() >= 0:
                    continue
                x = unit(matrix(table.column(6).slice(a, b - a), int(dims[a])))
                s, i = strings[a:b].view(np.uint64), ident[a:b]
                index, query = np.flatnonzero(lv < 0), np.flatnonzero(lv >= 0)
                index = index[np.argsort(s[index], kind="stable")]
                args = (s[index], x[index], i[index], s[query], x[query], i[query])
                found.append(descend(*args, k) if step == "descend" else ascend(*args, lv[query], k))
            if found:
                q, c, score = (np.concatenate(v) for v in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(score)], names=["q", "c", "s"])

    met = rows.mapInArrow(run, "q bigint, c bigint, s double").groupBy("q", "c").agg(F.max("s").alias("s"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "c"))
    return met.withColumn("r", rank).where(F.col("r") <= k)


def search(df: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
           trees: int = TREES, miss: float = MISS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each row where ``is_query`` (over ``vec_id``) holds."""
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        named = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
        rows = usable(named, "vec_id", "embedding").withColumnRenamed("id", "vec_id")
        rows = scratch.table(rows.withColumn("wanted", F.coalesce(is_query, F.lit(False))).distinct())
        ranked = F.row_number().over(W.partitionBy("dim", "vec").orderBy("vec_id"))
        firsts = rows.withColumn("r", ranked).where(F.col("r") <= k + 1)
        names = firsts.groupBy("dim", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        asked = rows.groupBy("dim", "vec").agg(F.min("vec_id").alias("id"), F.max("wanted").alias("wanted"))
        vectors = scratch.table(asked.join(names, ["dim", "vec"]))
        total = vectors.count()
        depth = max(0, min(DEPTH, int(math.log2(max(1, total / (CELL_ROWS // 2))))))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(1).to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    strings = hash_strings(unit(matrix(part.column(2), int(dim))), trees).view(np.int64)
                    cells = pa.ListArray.from_arrays(
                        pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * trees), pa.array(strings.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), cells], names=["id", "strings"])

        strings = scratch.table(vectors.select("id", "dim", "vec").mapInArrow(hashed, "id bigint, strings array<bigint>"))
        tree = strings.select("id", F.posexplode("strings").alias("tree", "string"))
        lead = F.shiftrightunsigned("string", BITS - depth) if depth else F.lit(0).cast("long")
        tree = tree.withColumn("cell", F.col("tree").cast("long") * (1 << depth) + lead)
        parts = scratch.table(tree.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")))
        member = vectors.select("id", "dim", "vec")
        index = (attach(tree, parts, ["cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
                 .join(member, "id").withColumn("level", F.lit(-1)))
        every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        asking = tree.join(vectors.where("wanted").select("id"), "id")

        first = attach(asking, parts, ["cell"]).withColumn("part", every_part).join(member, "id").withColumn("level", F.lit(0))
        found = scratch.table(_meet(index.unionByName(first), k + 1, "descend"))
        worst = found.groupBy("q").agg(F.min("s").alias("s"), F.count("*").alias("n"))

        def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                level = ascend_to(batch.column(1).to_numpy(), trees, miss)
                level[batch.column(2).to_numpy() < k + 1] = 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level)], names=["id", "level"])

        level = scratch.table(worst.select("q", "s", "n").mapInArrow(levels, "id bigint, level int"))
        up = F.greatest(F.lit(0), F.lit(depth) - F.col("level"))  # prefixes shorter than a cell's name span 2^up cells
        begin = F.col("tree").cast("long") * (1 << depth) + F.expr(f"shiftleft(shiftright(cell - tree * {1 << depth}L, up), up)")
        second = (asking.join(level, "id").withColumn("up", up.cast("int")).withColumn("begin", begin)
                  .withColumn("cell", F.explode(F.expr("sequence(begin, begin + shiftleft(1L, up) - 1)"))).drop("up", "begin"))
        second = attach(second, parts, ["cell"]).withColumn("part", every_part).join(member, "id")
        met = _meet(index.unionByName(second.select(*index.columns)), k + 1, "ascend").select("q", "c")
        met = met.unionByName(found.select("q", "c")).distinct()  # what descending has found stays a candidate

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = [float(np.dot(unit(a[None])[0], unit(b[None])[0])) for a, b in (
                    (np.frombuffer(x.as_py(), np.float64), np.frombuffer(y.as_py(), np.float64))
                    for x, y in zip(batch.column(2), batch.column(3), strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())],
                                                 names=["q", "c", "score"])

        pairs = (met.join(member.select(F.col("id").alias("q"), F.col("vec").alias("qv")), "q")
                 .join(member.select(F.col("id").alias("c"), F.col("vec").alias("cv")), "c").select("q", "c", "qv", "cv"))
        scored = scratch.table(pairs.mapInArrow(exact, "q bigint, c bigint, score double"))
        near = scored.join(vectors.select(F.col("id").alias("c"), F.explode("ids").alias("vec_id")), "c")
        queries = rows.where("wanted").join(vectors.select("dim", "vec", F.col("id").alias("q")), ["dim", "vec"]).select(
            F.col("vec_id").alias("query_id"), "q")
        # a class of copies has one short list of neighbours, whatever the number of its queries
        order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        short = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
        lists = short.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
        others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        out = (queries.join(lists, "q").select("query_id", F.posexplode(others).alias("pos", "hit"))
               .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                       F.col("hit.score").alias("score")))
        return materialize(out)
