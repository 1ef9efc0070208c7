"""Memberships of signature keys that several ids share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_keys(members: DataFrame, key: str = "key", ident: str = "id") -> DataFrame:
    """Rows of ``members`` whose key belongs to two different ids at least.

    Smallest and largest id per key are partial aggregates, so a key of a third of all
    rows leaves each task as one row; the join back is an equi-join whose hot
    keys AQE splits.
    """
    several = (members.groupBy(key).agg(F.min(ident).alias("__lo"), F.max(ident).alias("__hi"))
               .where("__lo < __hi").select(key))
    return members.join(several, key)


def sorted_shared_keys(members: DataFrame) -> DataFrame:
    """Distinct (key, id) rows of ``members`` whose key belongs to two different ids at least, by one shuffle.

    Rows are dealt by key and sorted by (key, id); a task walks over them and holds back one row, the first of the
    key at hand, until a second id shows up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, bool] | None = None  # key and id of the last row, and whether its key is known to be shared
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ident = (batch.column(i).to_numpy() for i in (0, 1))
            if last is not None:
                key, ident = np.append(last[0], key), np.append(last[1], ident)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
            key, ident = key[new], ident[new]
            same = key[1:] == key[:-1]
            shared = np.append(same, False) | np.append(False, same)
            if last is not None and last[2]:
                shared[0] = True
                shared[1:2] |= same[:1]
            out = shared.copy()
            if last is not None and last[2]:
                out[0] = False  # handed on before
            last = (int(key[-1]), int(ident[-1]), bool(shared[-1]))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(ident[out])], names=["key", "id"])

    rows = members.select("key", "id").repartition("key").sortWithinPartitions("key", "id")
    return rows.mapInArrow(run, "key bigint, id bigint")
