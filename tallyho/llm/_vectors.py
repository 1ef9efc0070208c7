"""Embeddings as rows of raw floats, without those that take no part, and classes of equal vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, dim, vec): ``vec`` is the vector's doubles as binary.

    Left out are rows whose id or vector is null, and vectors that are empty or zero or hold
    null, NaN or infinite components.  A zero with a minus sign counts as zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            edge = np.concatenate([[0], np.cumsum(size)])
            flat = flat[:edge[-1]]
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            size_of = np.concatenate([[0], np.cumsum(np.where(np.isfinite(flat), flat, 0) != 0)])
            good = np.flatnonzero((np.diff(bad[edge]) == 0) & (np.diff(size_of[edge]) > 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(good)), pa.array(size[good].astype(np.int32)),
                 pa.array([flat[edge[i]:edge[i + 1]].tobytes() for i in good], pa.binary())], names=["id", "dim", "vec"])

    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null").mapInArrow(run, "id bigint, dim int, vec binary")


def classes(rows: DataFrame) -> DataFrame:
    """(id, dim, vec, size) with one row per distinct vector and its smallest id."""
    return rows.groupBy("dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("size")).select("id", "dim", "vec", "size")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles from binary cells of one dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one.  The largest component is taken out first, so no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
