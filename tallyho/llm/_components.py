"""Connected components of an edge table, wholly on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho.session import Scratch


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id that is not the smallest of its component; ``edges`` has columns u and v.

    Alternates large-star and small-star steps: every node hands its larger, then its
    smaller neighbours to the smallest id it sees, until each component is a star.
    Each step is a partial aggregate and an equi-join, so a node with any number of
    neighbours is never gathered.  The number of rounds grows with the logarithm of the
    longest path.  The result is read from a table of ``scratch``.
    """
    now = scratch.table(_distinct(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _distinct(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = scratch.table(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.table(_distinct(small.unionByName(least.select("u", F.col("m").alias("v")))))
        scratch.drop(now, large)
        now, before, state = small, state, _state(small)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
