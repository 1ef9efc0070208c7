"""Counts, means and percentiles of a sliding window of rows by a sorted block that follows the window.

A group is cut into chunks of consecutive rows, and the last rows of each chunk are copied in front of the next one,
as in ``ordered.rolling_window``.  A task walks over its chunks in order.  It holds the values of the last ``n`` rows, once in
order of arrival and once sorted: a row enters the sorted block and the one that falls out of the window leaves it, each by
binary search, and percentiles are read by position.  A row costs the logarithm of the window plus one short move of memory, not a
gathered and sorted array of ``n`` values, and the state is ``n`` values whatever the size of the group.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho.operators.ordered import ROWS_PER_PART, with_sequence
from tallyho.operators.stats import _by


def percentile_of(ordered: Sequence[float], p: float) -> float | None:
    """Linear interpolation between the neighbours of position p * (size - 1)."""
    if not ordered:
        return None
    at = (len(ordered) - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    return ordered[lo] if lo == hi else (hi - at) * ordered[lo] + (at - lo) * ordered[hi]


class SlidingBlock:
    """The last ``n`` rows: values that count (None: a row without one), and flags."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.clear()

    def clear(self) -> None:
        self.rows: deque[tuple[float | None, int]] = deque()
        self.ordered: list[float] = []
        self.flags, self.total, self.moves = 0, 0.0, 0

    def push(self, value: float | None, flag: int) -> None:
        if len(self.rows) == self.n:
            old, old_flag = self.rows.popleft()
            self.flags -= old_flag
            if old is not None:
                del self.ordered[bisect_left(self.ordered, old)]
                self.total -= old
        self.rows.append((value, flag))
        self.flags += flag
        if value is not None:
            insort(self.ordered, value)
            self.total += value
        self.moves += 1
        if self.moves >= self.n:  # a fresh sum now and then, so that rounding does not pile up
            self.total, self.moves = math.fsum(self.ordered), 0

    def mean(self) -> float | None:
        return self.total / len(self.ordered) if self.ordered else None


def sliding_statistics(df: DataFrame, n: int, by, order: Sequence[str], value: str, flag: str, percentiles: dict[str, float],
                       chunk_rows: int = 100_000, rows_per_part: int | None = ROWS_PER_PART) -> DataFrame:
    """Adds ``seq`` (place in the group from 0), and of the last ``n`` rows: ``window_n``, ``n_flagged`` (sum of ``flag``),
    ``mean`` and the named percentiles of ``value`` (NULL and NaN do not count; NULL when none does)."""
    keys = _by(by)
    chunk_rows = max(chunk_rows, n)
    seq = with_sequence(df, keys, list(order), "seq", rows_per_part=rows_per_part)
    seq = seq.withColumn("_chunk", F.floor(F.col("seq") / F.lit(int(chunk_rows))))
    halo = (seq.where(F.col("seq") % F.lit(int(chunk_rows)) >= F.lit(int(chunk_rows - (n - 1))))
            .withColumn("_chunk", F.col("_chunk") + 1).withColumn("_halo", F.lit(True)))
    rows = seq.withColumn("_halo", F.lit(False)).unionByName(halo)
    rows = rows.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "seq")
    own = [c for c in rows.columns if c not in ("_chunk", "_halo")]
    added = [("window_n", pa.int64()), ("n_flagged", pa.int64()), ("mean", pa.float64()), *((p, pa.float64()) for p in percentiles)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chunk, last = SlidingBlock(n), None, None
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            columns = [batch.column(at[c]).to_pylist() for c in ("_chunk", "seq", value, flag)]
            found = []
            for c, s, v, f in zip(*columns, strict=True):
                if c != chunk or s != last + 1:  # chunks of different groups never go on from each other
                    block.clear()
                chunk, last = c, s
                block.push(None if v is None or v != v else v, f or 0)
                found.append((len(block.rows), block.flags, block.mean(), *(percentile_of(block.ordered, p) for p in percentiles.values())))
            new = [pa.array(v, t) for v, (_, t) in zip(zip(*found, strict=True), added, strict=True)] if found else [
                pa.array([], t) for _, t in added]
            out = pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in own), *new], names=[*own, *(c for c, _ in added)])
            yield out.filter(pc.invert(batch.column(at["_halo"])))

    kinds = {"window_n": T.LongType(), "n_flagged": T.LongType()}
    schema = T.StructType([*(rows.schema[c] for c in own), *(T.StructField(c, kinds.get(c, T.DoubleType())) for c, _ in added)])
    return rows.mapInArrow(run, schema)
