"""Projections, guards, exact seeded samples, split union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho import spec


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "operation") -> None:
    """Raise at plan time when required columns are absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Required columns missing for {what}: {missing}")


def select_features(df: DataFrame, mode: str = "model") -> DataFrame:
    """Feature projections.

    ``mode='allow_list'``: allow-list order first, then every other column that
    is not the target or a leakage column.  ``mode='model'``: drop leakage,
    protected attributes and the target, keep the rest in order.
    """
    if mode == "allow_list":
        exclude = {spec.TARGET, *spec.LEAKAGE_COLUMNS}
        first = [c for c in spec.CLEAN_FEATURES if c in df.columns]
        rest = [c for c in df.columns if c not in exclude and c not in first]
        return df.select(*first, *rest)
    drop = [*spec.LEAKAGE_COLUMNS, *spec.PROTECTED_COLUMNS, spec.TARGET]
    return df.drop(*drop)


def feature_types(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Split columns into (categorical, numeric) by type; other types are ignored."""
    cat, num = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            num.append(f.name)
    return cat, num


def to_payload_json(df: DataFrame, keep: Sequence[str] = ("row_ix",), name: str = "payload") -> DataFrame:
    """Request payload per row: drop target/leakage/protected, NaN -> null, JSON text."""
    drop = {spec.TARGET, *spec.LEAKAGE_COLUMNS, *spec.PROTECTED_COLUMNS, *keep}
    fields = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
        fields.append(c.alias(f.name))
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(*[F.col(k) for k in keep if k in df.columns], payload.alias(name))


def sample_key(key_cols: Sequence[str], seed: int = spec.SEED):
    """Deterministic per-row sort key: md5 of the seed and the row key (hex text)."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") for k in key_cols]
    return F.md5(F.concat_ws(":", *parts))


def sample_n(df: DataFrame, n: int, key: Sequence[str] | str = "row_ix", seed: int = spec.SEED,
             by=None) -> DataFrame:
    """Exact-size seeded sample without replacement: the ``n`` rows with the smallest
    ``md5(seed:key)`` (L2).  ``n`` >= rows gives all rows.

    Invariant under repartitioning.  The hash value at the n-th place (per group) is
    found by radix selection on the hash alone, and rows up to it are kept by a filter.
    """
    from tallyho.operators.ordered import head_rows
    from tallyho.operators.stats import _by

    keys = [key] if isinstance(key, str) else list(key)
    # 13 hex digits are a whole number that a double holds exactly.
    x = df.withColumn("_h", sample_key(keys, seed))
    x = x.withColumn("_hn", F.conv(F.substring(F.col("_h"), 1, 13), 16, 10).cast("double"))
    return head_rows(x, int(n), by=_by(by), order=["_hn", "_h", *keys]).drop("_h", "_hn")


def union_splits(frames: dict[str, DataFrame], column: str = "split") -> DataFrame:
    """One table from per-split tables, tagged by a ``split`` column."""
    out = None
    for name, frame in frames.items():
        tagged = frame.withColumn(column, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
