"""Bounded groups of rows inside mapInArrow tasks: rows that were shuffled and sorted by integer key columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _keys(batch: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(width)], axis=1)


def whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, edges): tables that hold only whole groups of the first ``width`` columns.

    ``edges[g]:edges[g + 1]`` are the rows of group g.  A group that reaches into the next batch
    is kept back until it is whole.
    """
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        key = _keys(table, width)
        new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        return table, np.concatenate([[0], new, [len(key)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = _keys(batch, width)
        differ = np.flatnonzero((key != key[-1]).any(axis=1))
        last = int(differ[-1]) + 1 if len(differ) else 0
        if held and (last or (_keys(held[-1].slice(held[-1].num_rows - 1), width) != key[:1]).any()):
            if last:
                held.append(batch.slice(0, last))
            yield out()
            held = []
        elif last:
            held.append(batch.slice(0, last))
            yield out()
            held = []
        held.append(batch.slice(last))
    if held:
        yield out()
